"""Proportional stratified interleaving: every shard holds the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranking is done in this many chunks of a uniform key, so no stratum is sorted by one task.
CHUNKS = 4096


def _numbered(frame: DataFrame, group: list[str], chunk: str, order: list[Column], name: str) -> DataFrame:
    """``frame`` plus a gapless number from 0 within ``group`` in the order (chunk, order), and the group's size.

    Rows are numbered inside (group, chunk); chunks are counted apart and their running
    sum, one row per group and chunk, is joined back. Null groups are groups.
    """
    keys = [*group, chunk]
    sums = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_llm_count"))
    before = counts.select(
        *[F.col(k).alias(f"_llm_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_llm_count").over(sums), F.lit(0)).alias("_llm_before"),
        F.sum("_llm_count").over(Window.partitionBy(*group)).alias("_llm_total"))
    inside = frame.withColumn(
        "_llm_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    joined = inside.join(before, [F.col(k).eqNullSafe(F.col(f"_llm_k{i}")) for i, k in enumerate(keys)])
    return joined.select(
        *frame.columns, (F.col("_llm_inside") + F.col("_llm_before")).alias(name), F.col("_llm_total").alias(f"{name}_total"))


def interleave(
    docs: DataFrame, shards: int, *, key: str = "doc_id", stratum: str = "source", seed: int = 17,
    chunks: int = CHUNKS,
) -> DataFrame:
    """``docs`` plus ``shard`` (0 up to ``shards``) and ``slot`` (gapless from 0 in each shard).

    Rows of a stratum are put in a seeded random order by the MD5 digest of seed and key;
    row *r* of *n* gets the fraction (r + 1/2) / n, all rows are sorted by fraction, and the
    line is cut into shards whose counts differ by one at most. So every run of the line,
    and every shard, holds each stratum in its share of the whole, to a row or two.

    Null strata form a stratum, null keys share one random place, and repeated keys are
    ordered by the other columns, so equal rows alone are interchangeable. An empty table
    gives an empty result. Every other column passes unchanged; columns named ``shard`` and
    ``slot`` are replaced. Three shuffles of the rows given: pass narrow rows and join texts
    later, or use ``write``.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    lead = F.conv(F.substring("_llm_digest", 1, 8), 16, 10).cast("long")
    ties = [F.col(c).asc_nulls_first() for c in kept]
    dealt = docs.select(*kept, digest.alias("_llm_digest")).withColumn(
        "_llm_chunk", F.floor(lead * chunks / 2**32).cast("int"))
    ranked = _numbered(dealt, [stratum], "_llm_chunk", [F.col("_llm_digest"), *ties], "_llm_rank")
    fraction = (F.col("_llm_rank") + F.lit(0.5)) / F.col("_llm_rank_total")
    lined = ranked.select(*kept, "_llm_digest", fraction.alias("_llm_fraction")).withColumn(
        "_llm_part", F.floor(F.col("_llm_fraction") * chunks).cast("int"))
    order = [F.col("_llm_fraction"), F.col(stratum).asc_nulls_first(), F.col("_llm_digest"), *ties]
    return _cut(_numbered(lined, [], "_llm_part", order, "_llm_place"), kept, shards)


def _cut(placed: DataFrame, kept: list[str], shards: int) -> DataFrame:
    """Places to shards: the first shards take the rows that do not divide evenly."""
    small, larger = F.floor(F.col("_llm_place_total") / shards), F.col("_llm_place_total") % shards
    edge = larger * (small + 1)
    in_larger = F.col("_llm_place") < edge
    shard = F.when(in_larger, F.floor(F.col("_llm_place") / (small + 1))).otherwise(
        larger + F.floor((F.col("_llm_place") - edge) / F.greatest(small, F.lit(1))))
    slot = F.when(in_larger, F.col("_llm_place") % (small + 1)).otherwise(
        (F.col("_llm_place") - edge) % F.greatest(small, F.lit(1)))
    return placed.select(*kept, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write(sharded: DataFrame, path: str, parts: int) -> None:
    """One folder per shard, rows in slot order; ``parts`` tasks share the work by (shard, slot)."""
    (sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
