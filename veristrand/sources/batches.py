"""Work batches: works, contributions, a manifest and the raw files behind them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from .exports import json_lines


def read_manifest(spark: SparkSession, directory: str) -> dict:
    row = spark.read.text(f"{directory}/manifest.json", wholetext=True).first()
    manifest = json.loads(row.value) if row else None
    if not isinstance(manifest, dict):
        raise ValueError("Manifest must be a JSON object")
    return manifest


def read_rows(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """(pos, payload, doc) of one stream, the document as written."""
    return json_lines(spark, f"{directory}/{name}.jsonl").select("pos", "payload", "doc")


def clean_path(path: Column) -> Column:
    """Path segments without ``.`` and ``..``; NULL when the path leaves its root."""
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        F.split(path, "/"), empty,
        lambda seen, part: F.when(part.isin("", "."), seen)
        .when((part == "..") & (F.size(seen) > 0), F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .when(part == "..", F.lit(None).cast("array<string>"))
        .otherwise(F.concat(seen, F.array(part))))
    return F.when(~F.startswith(path, F.lit("/")), F.array_join(walked, "/"))


def read_artifacts(spark: SparkSession, directory: str) -> DataFrame:
    """(path, sha256, content) of every file in the batch, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory).toUri().getPath()
    relative = F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(root.rstrip("/") + "/"), F.lit("\\E")), 2), -1)
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), "content")


def text_field(doc: Column, name: str) -> Column:
    """A member only when it is a string, else NULL."""
    value = P.part(doc, name)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
