"""The contract all lanes share."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty

WORK = ("id", "title", "kind", "source_url", "observed_at", "work_date", "organization", "regional_evidence",
        "geography_scope", "description", "raw_path", "raw_sha256")
CREDIT = ("work_id", "name", "role", "person_url", "identifiers", "evidence", "source_url")
UNRESOLVED = ("work_id", "name", "source_url", "reason")
NO_IDENTIFIERS = "map<string,string>"


@dataclass(frozen=True)
class Lane:
    works: DataFrame = field(repr=False)
    credits: DataFrame = field(repr=False)
    unresolved: DataFrame | None = field(default=None, repr=False)


def keep(frame: DataFrame, keys: list[str], order: str, last: bool) -> DataFrame:
    """One row per key, the first or the last by ``order``; combines map-side."""
    rest = [c for c in frame.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return frame.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_kept")).select(*keys, "_kept.*")


def accumulate(works: DataFrame, credits: DataFrame, unresolved: DataFrame | None = None, last: bool = False,
               credit_key: tuple[str, ...] = ("work_id", "name", "role")) -> Lane:
    """Works once per id and credits once per key. Which row stays is the lane's rule."""
    kept_works = keep(works, ["id"], "ord", last).select(*WORK)
    kept_credits = keep(credits, list(credit_key), "ord", last).select(*CREDIT)
    names = None if unresolved is None else keep(unresolved, ["work_id", "name"], "ord", True).select(*UNRESOLVED)
    return Lane(kept_works, kept_credits, names)


def identifiers(**values: Column) -> Column:
    """A map of the identifiers that are there."""
    pairs = [piece for name, value in values.items() for piece in (F.lit(name), value.cast("string"))]
    whole = F.create_map(*pairs) if pairs else F.create_map().cast(NO_IDENTIFIERS)
    return F.map_filter(whole, lambda _, v: v.isNotNull() & (v != ""))


def no_identifiers() -> Column:
    return F.create_map().cast(NO_IDENTIFIERS)


def hashed_id(source: str, external: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(source + "\0"), external), 256), 1, 24)


def page_id(url: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(url, F.lit("|"), key), 256), 1, 24)


def public_id(url: Column, identifier: Column) -> Column:
    return F.concat(F.lit("CPW-"), F.substring(F.sha2(F.concat(url, F.lit("#"), identifier), 256), 1, 20))


def with_artifacts(works: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Attach the archived file of each work's page, looked up by ``raw_url``."""
    files = artifacts.select(F.col("url").alias("raw_url"), "raw_path", "raw_sha256")
    joined = works.drop("raw_path", "raw_sha256").join(files, "raw_url", "left")
    return joined.withColumn("raw_path", or_empty(F.col("raw_path"))).withColumn(
        "raw_sha256", or_empty(F.col("raw_sha256"))).drop("raw_url")


def coverage(expected: DataFrame, works: DataFrame, credits: DataFrame) -> DataFrame:
    """Works and credits per source family; attempted but empty families stay visible.

    ``expected(source)`` names the families, ``works`` and ``credits`` carry ``source``.
    """
    counted = lambda frame, name: frame.groupBy("source").agg(F.count(F.lit(1)).alias(name))
    return (
        expected.select("source").distinct()
        .join(counted(works, "records"), "source", "left")
        .join(counted(credits, "contributions"), "source", "left")
        .na.fill(0, ["records", "contributions"])
    )


def write_batch(lane: Lane, name: str, scope: str, path: str, sources: DataFrame | None = None,
                limitations: tuple[str, ...] = (), errors: tuple[str, ...] = (), started_at: str = "") -> dict:
    """Sorted works and credits as JSON lines, then a manifest with their counts."""
    spark = lane.works.sparkSession
    line = lambda frame: frame.select(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}).alias("value"))
    line(lane.works.select(*WORK).orderBy("id")).write.mode("errorifexists").text(f"{path}/works.jsonl")
    line(lane.credits.select(*CREDIT).orderBy("work_id", "name", "role")).write.mode("errorifexists").text(
        f"{path}/contributions.jsonl")
    count = lambda stream: spark.read.text(f"{path}/{stream}.jsonl").count()
    manifest = {
        "lane": name, "complete": False, "scope": scope, "works": count("works"), "contributions": count("contributions"),
        "started_at": started_at, "completed_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "sources": [] if sources is None else [r.asDict() for r in sources.orderBy("source").collect()],
        "limitations": list(limitations), "errors": list(errors),
    }
    if lane.unresolved is not None:
        manifest["unresolved_name_count"] = lane.unresolved.count()
        line(lane.unresolved.orderBy("work_id", "name")).write.mode("errorifexists").text(f"{path}/unresolved.jsonl")
    text = spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string")
    text.coalesce(1).write.mode("errorifexists").text(f"{path}/manifest.json")
    return manifest
