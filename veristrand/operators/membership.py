"""Saved-query results: semantic fingerprints, membership changes and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from .claims import identifier_tasks

REASON = "Qualification under the saved query changed; not proof of a real-world move or departure."
MEMBERS = "profile_id string, fingerprint string, payload string"
# Why a task is in a plan.
EXISTING_JOB = "Existing eligible job in the subscription cohort"
ORIGIN_TASK = "Origin cohort needs affiliation evidence"
QUERY_TASK = "Matching source record has no enrichment job"


def fingerprinted(items: DataFrame) -> DataFrame:
    """Members of a result: a digest without acquisition details, and the full item.

    Observation times, claim times, annotation times and movement sources are in
    the item but not in the digest, so refetching alone changes nothing.
    """
    kept = [F.col(f"workspace.{n}").alias(n) for n in items.select("workspace.*").columns if n != "updated_at"]
    movement = lambda m: F.struct(*[m[n].alias(n) for n in (
        "subject", "name", "status", "prior", "later", "limitation")])
    semantic = P.key_of(
        P.without_fields(P.variant(F.col("payload")), "observed_at"), F.col("match_basis"),
        F.col("claims_digest"),
        F.to_json(F.when(F.col("workspace").isNotNull(), F.struct(*kept))),
        F.to_json(F.transform("movement_candidates", movement)))
    item = F.to_json(F.struct(
        F.col("profile_id").alias("id"), F.col("payload").alias("record"), "match_basis", "workspace",
        "claims", "enriched_matches", "movement_candidates"))
    return items.select("profile_id", semantic.alias("fingerprint"), item.alias("payload"))


def attach_movement(items: DataFrame, candidates: DataFrame | None, links: DataFrame) -> DataFrame:
    """With origins given, only profiles linked to a movement candidate qualify."""
    shape = ("array<struct<subject:string,name:string,status:string,prior:array<string>,later:array<string>,"
             "limitation:string,source:struct<url:string,observed:double,sha256:string>>>")
    if candidates is None:
        return items.withColumn("movement_candidates", F.array().cast(shape))
    entry = F.struct("subject", "name", "status", "prior", "later", "limitation",
                     F.struct("url", "observed", "sha256").alias("source"))
    per_profile = (
        candidates.join(links.filter("provider = 'openalex-author'").select("profile_id", "subject"), "subject")
        .groupBy("profile_id").agg(F.array_sort(F.collect_set(entry)).alias("movement_candidates"))
    )
    return items.join(per_profile, "profile_id")


def membership_changes(members: DataFrame, current: DataFrame) -> DataFrame:
    """(profile_id, kind, before, after) for profiles that entered, changed or left."""
    old = members.select("profile_id", F.col("fingerprint").alias("old"), F.col("payload").alias("before"))
    new = current.select("profile_id", F.col("fingerprint").alias("new"), F.col("payload").alias("after"))
    return (
        old.join(new, "profile_id", "full")
        .filter(~F.col("old").eqNullSafe(F.col("new")))
        .select("profile_id", F.when(F.col("old").isNull(), "entered").when(F.col("new").isNull(), "exited")
                .otherwise("updated").alias("kind"), "before", "after")
    )


def origin_cohort(profiles: DataFrame, institutions: list[str]) -> DataFrame:
    """Profiles that name one of the institutions as a whole token anywhere in the record."""
    tokens = F.regexp_extract_all(P.canonical_text(F.col("payload")), F.lit(r"\b(I\d+)\b"), 1)
    return profiles.filter(F.arrays_overlap(tokens, F.array(*[F.lit(i) for i in institutions])))


def plan_tasks(cohort: DataFrame, jobs: DataFrame, links: DataFrame, now: float, limit: int | None,
               origin: bool) -> tuple[DataFrame, dict]:
    """The identifier tasks of a cohort, all or the first ``limit``, and counts over the whole cohort.

    A task counts once per (provider, subject), at its first record. A linked job
    is planned only when pending and due; a known job that is not linked yet is
    planned whatever its state, because linking needs no refetch.
    """
    listed = identifier_tasks(cohort)
    first = (
        listed.filter("provider IS NOT NULL").groupBy("provider", "subject")
        .agg(F.min(F.struct("profile_id", "position")).alias("first"))
        .select("provider", "subject", "first.profile_id", "first.position")
    )
    known = jobs.select("provider", "subject", "status", "due", F.lit(True).alias("known"))
    linked = links.select("profile_id", "provider", "subject", F.lit(True).alias("linked"))
    settled = F.col("known") & F.col("linked") & ((F.col("status") != "pending") | (F.col("due") > now))
    reason = F.when(F.col("known"), EXISTING_JOB).otherwise(ORIGIN_TASK if origin else QUERY_TASK)
    tasks = (
        first.join(known, ["provider", "subject"], "left")
        .join(linked, ["profile_id", "provider", "subject"], "left")
        .filter(~F.coalesce(settled, F.lit(False)))
        .select("profile_id", "position", "provider", "subject", reason.alias("reason"))
    )
    if limit is not None:
        tasks = tasks.orderBy("profile_id", "position").limit(limit)
    counts = listed.filter("position IS NULL OR position = 0").agg(
        F.count_if("missing").alias("missing"), F.count_if("invalid").alias("invalid")).first()
    return (
        tasks.select("profile_id", "provider", "subject", "reason"),
        {"records_without_supported_ids": counts.missing, "invalid_identifier_records": counts.invalid},
    )
