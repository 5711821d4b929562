"""Offset pages, cursor pages and dense numbering without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1_000_000


def check_page(limit: int, offset: int = 0) -> None:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset must be nonnegative")


def page(frame: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    check_page(limit, offset)
    return frame.orderBy(*order).offset(offset).limit(limit)


def cursor_rows(events: DataFrame, after: int, limit: int) -> DataFrame:
    """The next rows after a sequence number, in order."""
    return events.filter(F.col("sequence") > after).orderBy("sequence").limit(limit)


def after_cursor(events: DataFrame, after: int = 0, limit: int = 100) -> dict:
    """Rows after a sequence number. Reading the same cursor again gives the same rows."""
    if type(after) is not int or after < 0 or type(limit) is not int or limit < 1:
        raise ValueError("Use a nonnegative cursor and a positive limit")
    rows = cursor_rows(events, after, limit + 1).collect()
    kept = rows[:limit]
    return {
        "events": [row.asDict(recursive=True) for row in kept],
        "cursor": kept[-1].sequence if kept else after,
        "has_more": len(rows) > limit,
    }


def number_rows(frame: DataFrame, chunk: Column, order: list[Column], start: Column | int = 0,
                name: str = "sequence", keys: tuple[str, ...] = ()) -> DataFrame:
    """Dense numbers in (chunk, order) sequence, over all rows or per key.

    ``chunk`` must grow with the wanted order. Rows are numbered inside their
    chunk; only one count per chunk meets in the prefix sum, so no task ever
    sees more than one chunk of rows, even of a key that holds most of them.
    """
    chunked = frame.withColumn("_chunk", chunk)
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        chunked.withColumn("_inside", inside)
        .join(starts, [*keys, "_chunk"])
        .withColumn(name, (base + F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_chunk", "_inside", "_before")
    )


def neighbour(frame: DataFrame, key: str, order: str, forward: bool = True, parts: int | None = None) -> DataFrame:
    """For unique ``order``: the next (or previous) one of the same key.

    A window over the bare key would put a hot key into one task, and chunks of equal
    width would put sparse values into chunks of one row. Rows are dealt by range of
    (key, order) instead, so a task holds its share whatever the keys and gaps are; every
    key is scanned within its part, and only the first and last row of each part, at most
    two per key and part, meet in a second window that carries over the borders.
    Rows without a key have no neighbours and do not come back.
    """
    rows = frame.select(key, order).filter(F.col(key).isNotNull())
    by = [F.col(key), F.col(order)]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    inner = Window.partitionBy(key, "_part").orderBy(order)
    scanned = dealt.withColumn("_part", F.spark_partition_id()).withColumns(
        {"_next": F.lead(order).over(inner), "_previous": F.lag(order).over(inner)})
    # Rows inside a part stay with it; those at an edge make one group per key.
    edge = F.col("_next").isNull() | F.col("_previous").isNull()
    outer = Window.partitionBy(key, "_group").orderBy(order)
    step, near, name = (F.lead, "_next", "next_id") if forward else (F.lag, "_previous", "previous_id")
    return scanned.withColumn("_group", F.when(edge, -1).otherwise(F.col("_part"))).withColumn(
        "_border", step(order).over(outer)).select(key, order, F.coalesce(near, "_border").alias(name))
