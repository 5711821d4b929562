"""Search over imported text and latest claims, with consumer annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("all", "new", "shortlisted", "dismissed")
FLAGS = ("known", "contacted", "participated")
ANSWERS = ("yes", "no", "unknown")
SELECTIONS = ("none", "shortlisted", "dismissed")
IMPORTED = "Imported profile or supporting evidence"
ENRICHED = "Enriched source claim"
MEANING = ("New means no affirmative known/contacted/participated marker in this workspace; "
           "unknown history is not proof of novelty.")
#: Claims that a match shows beside their number; they are chosen before anything is gathered.
SHOWN_CLAIMS = 5
ANNOTATION = (
    "known string, contacted string, participated string, selection string, reviewer string, reason string, "
    "updated_at double"
)
ANNOTATIONS = "profile_id string, " + ANNOTATION


def matched_claims(matches: DataFrame) -> DataFrame:
    """(profile_id, claims, claims_digest, enriched_matches) over all claims of a profile.

    The count and the digest cover every claim, add up map-side and ignore order and times.
    ``enriched_matches`` shows the first claims by predicate, value and response; the rows
    of ``matches`` are the whole list.
    """
    code = F.xxhash64("predicate", "source", "value")
    totals = matches.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(code), F.sum(code.cast("decimal(38,0)"))).alias("claims_digest"))
    order = Window.partitionBy("profile_id").orderBy("predicate", "value", "response_id", "pos")
    kept = matches.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SHOWN_CLAIMS)
    entry = F.struct("_n", "predicate", "value", "source", "observed")
    shown = kept.groupBy("profile_id").agg(F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.struct(e["predicate"].alias("predicate"), e["value"].alias("value"),
                           e["source"].alias("source"), e["observed"].alias("observed"))).alias("enriched_matches"))
    return totals.join(shown, "profile_id")


def latest_annotations(log: DataFrame, names: list[str]) -> DataFrame:
    """The latest annotation per profile of an append-only log, and how often it was saved."""
    return log.groupBy("profile_id").agg(
        F.max_by(F.struct(*names), "sequence").alias("_latest"), F.count(F.lit(1)).alias("saved")).select(
        "profile_id", "_latest.*", "saved")


def shortlisted(annotations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Shortlisted annotations with their profile, NULL where it left the snapshot."""
    return annotations.filter("selection = 'shortlisted'").join(profiles, "profile_id", "left")


def in_mode(mode: str) -> Column:
    """The consumer filter over an outer-joined ``workspace`` struct."""
    chosen = F.coalesce(F.col("workspace.selection"), F.lit(""))
    if mode == "all":
        return F.lit(True)
    if mode == "new":
        touched = F.lit(False)
        for flag in FLAGS:
            touched = touched | F.coalesce(F.col(f"workspace.{flag}") == "yes", F.lit(False))
        return ~touched & (chosen != "dismissed")
    return chosen == mode


NO_CLAIMS = "array<struct<predicate:string,value:string,source:string,observed:double>>"


def combine(profiles: DataFrame, scores: DataFrame | None, claims: DataFrame | None, annotations: DataFrame | None,
            mode: str) -> DataFrame:
    """One row per match. Every join is on the unique ``profile_id``.

    ``scores`` is None for a blank query, which matches every profile. Otherwise
    ids are matched and filtered first and meet the profiles last, so documents of
    profiles that do not match are never shuffled for their sake.
    """
    spark = profiles.sparkSession
    states = annotations if annotations is not None else spark.createDataFrame([], ANNOTATIONS)
    names = [f for f in states.columns if f != "profile_id"]
    workspace = states.select("profile_id", F.struct(*names).alias("workspace"))
    empty = F.array().cast(NO_CLAIMS)
    if scores is None:
        matched = profiles.select(
            "profile_id", "payload", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("claims"),
            F.lit("").alias("claims_digest"), empty.alias("enriched_matches"))
        found = matched.join(workspace, "profile_id", "left").filter(in_mode(mode))
    else:
        nothing = f"profile_id string, claims bigint, claims_digest string, enriched_matches {NO_CLAIMS}"
        shown = spark.createDataFrame([], nothing) if claims is None else matched_claims(claims)
        ids = scores.join(shown, "profile_id", "full").withColumn(
            "enriched_matches", F.coalesce("enriched_matches", empty)).na.fill(0, ["claims"]).na.fill("", ["claims_digest"])
        chosen = ids.join(workspace, "profile_id", "left").filter(in_mode(mode))
        found = profiles.select("profile_id", "payload").join(chosen, "profile_id")
    return found.withColumn("match_basis", F.when(F.col("score").isNotNull(), IMPORTED).otherwise(ENRICHED))


def match_order() -> list[Column]:
    """Imported matches by relevance, then claim-only matches, ids breaking ties."""
    return [F.desc_nulls_last("score"), F.col("profile_id")]
