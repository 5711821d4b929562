"""Complete three-stream exports and their content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.text import casefold
from ..functions.urls import url_key
from ..operators.content import content_digest

# The streams of a complete export and what each row must carry.
STREAMS = {
    "profiles": ("people.jsonl", ("record_id", "name", "source_url", "regional_evidence")),
    "observations": ("evidence.jsonl", ("record_id", "name", "source_url", "regional_evidence")),
    "relationships": ("connections.jsonl", ("subject_name", "relation", "source_url", "evidence")),
}

#: An export made from archived works also has the credits of its profiles, one per row.
CREDITS = "credits.jsonl"


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, pos, value): every line with its dense place in all files, in name order.

    Names are ordered by their first number, then as text. Inside a split lines are numbered
    as they are read; only one count per split meets in the prefix sum, and that table, about
    a hundred bytes for each split of the input, goes to every task.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_block"),
        number.alias("_number"), "value")
    digits = F.lpad(F.regexp_extract("file_name", r"(\d{1,30})", 1), 30, "0")
    before = Window.orderBy(digits, "file_name", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file_name", "_block").agg(
        F.count(F.lit(1)).alias("_lines"), F.min("_number").alias("_first")).select(
        "file_name", "_block", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(F.broadcast(starts), ["file_name", "_block"]).select(
        "file_name", (F.col("_number") + F.col("_shift")).alias("pos"), "value")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with ``pos``, unique and in file order over any number of files, and the parsed ``doc``."""
    line = F.regexp_replace(F.col("value"), r"^\uFEFF", "")
    lines = placed_lines(spark, path).select("file_name", "pos", line.alias("payload"))
    return P.once(lines.filter(F.trim("payload") != ""), "doc", P.variant(F.col("payload")))


def _reason(required: tuple[str, ...], doc: Column) -> Column:
    missing = [F.when(~P.is_present(doc, name), F.lit(name)) for name in required]
    lost = F.concat_ws(", ", *missing)
    return (
        F.when(doc.isNull(), F.lit("not valid JSON"))
        .when(~P.is_object(doc), F.lit("not an object"))
        .when(lost != "", F.concat(F.lit("missing required fields: "), lost))
        .when(url_key(P.field(doc, "source_url")).isNull(), F.lit("invalid source_url"))
    )


def read_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One stream with its comparison keys; ``reason`` is NULL on accepted rows."""
    required = STREAMS[kind][1]
    rows = json_lines(spark, path).withColumn("reason", _reason(required, F.col("doc")))
    return stream_columns(rows, kind).drop("doc")


def stream_columns(rows: DataFrame, kind: str) -> DataFrame:
    """Promote the fields the engine joins on; the document itself stays as read."""
    doc = F.col("doc")
    link = "subject_url" if kind == "relationships" else "profile_url"
    name = "subject_name" if kind == "relationships" else "name"
    own_id = "subject_record_id" if kind == "relationships" else "record_id"
    rows = (
        rows.withColumn("record_id", F.nullif(P.field(doc, own_id), F.lit("")))
        .withColumn("collector", F.coalesce(P.field(doc, "collector"), F.lit("")))
        .withColumn("link_key", url_key(P.field(doc, link)))
        .withColumn("name_source_key", F.concat_ws(
            "\n", casefold(F.trim(P.field(doc, name))), url_key(P.field(doc, "source_url"))))
        .withColumn("record_key", P.record_key(kind, doc))
    )
    if "reason" in rows.columns:
        rows = rows.withColumn("reason", F.coalesce(
            F.col("reason"), F.when(F.col("link_key").isNull(), F.lit(f"invalid {link}"))))
    return rows


def read_credits(spark: SparkSession, path: str) -> DataFrame:
    """The credits of an export's profiles: their place, the profile, the document; ``reason`` is NULL on accepted rows."""
    doc = F.col("doc")
    own = F.nullif(P.field(doc, "record_id"), F.lit(""))
    reason = F.when(doc.isNull(), "not valid JSON").when(~P.is_object(doc), "not an object").when(
        own.isNull(), "missing required fields: record_id")
    return json_lines(spark, path).select("file_name", "pos", "payload", own.alias("record_id"), reason.alias("reason"))


def has_credits(spark: SparkSession, directory: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{CREDITS}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def content_hashes(spark: SparkSession, directory: str) -> dict[str, str]:
    """A content address per stream: its lines with their places, however they are split into files."""
    names = [file_name for file_name, _ in STREAMS.values()] + [CREDITS] * has_credits(spark, directory)
    return {
        file_name: content_digest(placed_lines(spark, f"{directory}/{file_name}"), "pos", "value")[0]
        for file_name in names}
