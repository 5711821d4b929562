"""Content addresses of row sets of any size."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_digest(rows: DataFrame, *columns: str) -> tuple[str, int]:
    """(digest, row count): the SHA-256 of each row, added up in eight 32-bit lanes.

    One aggregate with map-side sums, whatever the number of rows. Put a position
    among the columns where order matters.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    lanes = [
        F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
        for i in range(8)
    ]
    found = rows.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", *lanes).alias("sums")).first()
    return hashlib.sha256(f"{found.n}:{found.sums}".encode()).hexdigest(), found.n


def distinct_contents(files: DataFrame, content: Column, name: str) -> DataFrame:
    """(sha256, first, copies) of every distinct content; only digests and names are shuffled."""
    return files.select(F.sha2(content, 256).alias("sha256"), F.col(name).alias("_name")).groupBy("sha256").agg(
        F.min("_name").alias("first"), F.count(F.lit(1)).alias("copies"))


def json_string(value: Column) -> Column:
    """A JSON string; only text with characters that need escaping takes the long way."""
    return F.when(value.rlike(r"[\x00-\x1f\"\\]"), F.to_json(value.cast("variant"))).otherwise(
        F.concat(F.lit('"'), value, F.lit('"')))
