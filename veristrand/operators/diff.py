"""Semantic differences between two versions of keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _copies(rows: DataFrame, before: int) -> DataFrame:
    return rows.select(
        "kind", "record_key", "fingerprint",
        F.lit(before).alias("_before"), F.lit(1 - before).alias("_after"))


def as_of(versions: DataFrame, snapshot_id, name: str = "snapshot_id") -> DataFrame:
    """The rows of one snapshot; its folder or column value is pushed into the scan."""
    return versions.filter(F.col(name) == F.lit(snapshot_id)).drop(name)


def diff_versions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, record_key, change_type, before_rows, after_rows) for keys that differ.

    A key differs when the multiset of its fingerprints differs, so order never
    matters and lost duplicates do. Copies are counted, never gathered: both
    steps combine map-side and a key with a third of all rows stays cheap.
    """
    counted = (
        _copies(previous, 1).unionByName(_copies(current, 0))
        .groupBy("kind", "record_key", "fingerprint")
        .agg(F.sum("_before").alias("_before"), F.sum("_after").alias("_after"))
    )
    return (
        counted.groupBy("kind", "record_key")
        .agg(F.sum("_before").alias("before_rows"), F.sum("_after").alias("after_rows"),
             F.max(F.col("_before") != F.col("_after")).alias("_differs"))
        .filter("_differs")
        .select(
            "kind", "record_key",
            F.when(F.col("before_rows") == 0, "added").when(F.col("after_rows") == 0, "removed")
            .otherwise("changed").alias("change_type"),
            "before_rows", "after_rows")
    )


def change_rows(changes: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """The rows behind each change, one per row with ``side`` before or after."""
    both = previous.withColumn("side", F.lit("before")).unionByName(
        current.withColumn("side", F.lit("after")), allowMissingColumns=True)
    return both.join(changes.select("kind", "record_key", "change_type"), ["kind", "record_key"])


def change_counts(changes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """added / changed / removed per kind, zeros included."""
    spine = changes.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counted = changes.groupBy("kind").agg(*[
        F.count_if(F.col("change_type") == t).alias(t) for t in ("added", "changed", "removed")])
    return spine.join(counted, "kind", "left").na.fill(0)
