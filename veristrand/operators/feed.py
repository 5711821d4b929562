"""Changes between consecutive successful responses of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import successful_responses
from .paging import CHUNK, neighbour, number_rows

MEANING = "Difference between fetched provider claims, not verified real-world change or withdrawal."


def claim_groups(claims: DataFrame) -> DataFrame:
    """(response_id, predicate, values): the sorted set of values; bounded by one response."""
    return claims.groupBy("response_id", "predicate").agg(F.array_sort(F.collect_set("value")).alias("values"))


def pending_responses(responses: DataFrame, claims: DataFrame, heads: DataFrame) -> DataFrame:
    """Successful responses past the head of their job, heads included as ``is_head``.

    A response below the head arrived late and is ignored; one without claims is
    in flight and does not move the head.
    """
    done = successful_responses(responses.select("response_id", "job_id"), claims)
    joined = done.join(heads.withColumnRenamed("response_id", "head"), "job_id", "left")
    return joined.filter(F.col("head").isNull() | (F.col("response_id") >= F.col("head"))).select(
        "response_id", "job_id", F.coalesce(F.col("response_id") == F.col("head"), F.lit(False)).alias("is_head"))


def claim_changes(responses: DataFrame, claims: DataFrame, jobs: DataFrame, pending: DataFrame) -> DataFrame:
    """One row per predicate of a pending response whose value set differs from the response before.

    Each group of claims is sent twice: to its own response as "after" and to the
    next response of the job as "before". Both keys are response ids, so the
    comparison groups on unique keys and no job is too large for a task.
    """
    following = neighbour(pending, "job_id", "response_id", forward=True)
    groups = claim_groups(claims).join(
        pending.join(following.drop("job_id"), "response_id"), "response_id")
    after = groups.filter("NOT is_head").select(
        "response_id", "predicate", F.col("values").alias("after"), F.lit(None).cast("array<string>").alias("before"))
    before = groups.filter("next_id IS NOT NULL").select(
        F.col("next_id").alias("response_id"), "predicate", F.lit(None).cast("array<string>").alias("after"),
        F.col("values").alias("before"))
    compared = after.unionByName(before).groupBy("response_id", "predicate").agg(
        F.max("before").alias("before"), F.max("after").alias("after"))
    changed = compared.filter(~F.col("before").eqNullSafe(F.col("after")))
    previous = following.filter("next_id IS NOT NULL").select(
        F.col("next_id").alias("response_id"), F.col("response_id").alias("previous_response_id"))
    sources = responses.select("response_id", "job_id", F.col("url").alias("source"),
                               F.col("observed").alias("observed_at"), "sha256")
    return (
        changed.join(sources, "response_id")
        .join(previous, "response_id", "left")
        .join(jobs.select("job_id", "provider", "subject"), "job_id")
        .select(
            "job_id", "response_id", "predicate",
            F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "absent_from_latest")
            .otherwise("changed").alias("kind"),
            "provider", "subject", F.coalesce("before", F.array().cast("array<string>")).alias("before"),
            F.coalesce("after", F.array().cast("array<string>")).alias("after"),
            "source", "observed_at", "previous_response_id", "sha256", F.lit(MEANING).alias("meaning"))
    )


def sequenced(changes: DataFrame, start: int = 0, width: int = CHUNK) -> DataFrame:
    """Stable increasing sequence numbers in (response, predicate) order."""
    return number_rows(changes, F.floor(F.col("response_id") / width), [F.col("response_id"), F.col("predicate")], start)


def new_heads(pending: DataFrame) -> DataFrame:
    """Heads that moved: the newest successful response per job past its old head."""
    return (
        pending.groupBy("job_id")
        .agg(F.max("response_id").alias("response_id"), F.max_by("is_head", "response_id").alias("_still"))
        .filter("NOT _still").drop("_still")
    )
