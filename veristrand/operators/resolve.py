"""Attach relationships to profiles, only where exactly one profile qualifies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tagged(tag: str, value: Column) -> Column:
    return F.concat(F.lit(tag), value)


def alias_keys(profiles: DataFrame, observations: DataFrame) -> DataFrame:
    """(alias, profile) pairs: record ids, profile URLs, and names at a source.

    Inputs carry ``record_id, link_key, name_source_key``. Source URLs identify
    nothing on their own; they only qualify a name.
    """
    sightings = profiles.select("record_id", "link_key", "name_source_key").unionByName(
        observations.select("record_id", "link_key", "name_source_key"))
    seen = sightings.select("record_id", F.explode(F.array(
        F.when(F.col("link_key") != "", _tagged("u:", F.col("link_key"))),
        _tagged("n:", F.col("name_source_key")),
    )).alias("alias")).filter("alias IS NOT NULL")
    own = profiles.select("record_id", _tagged("i:", F.col("record_id")).alias("alias"))
    return seen.unionByName(own)


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """One row per alias; the owner is NULL when several profiles share it.

    min and max combine map-side, so an alias on a third of all rows still
    shuffles one row per task.
    """
    return aliases.groupBy("alias").agg(F.min("record_id").alias("_low"), F.max("record_id").alias("_high")).select(
        "alias", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("profile_id"))


def resolve(relationships: DataFrame, profiles: DataFrame, observations: DataFrame) -> DataFrame:
    """Relationships with ``profile_id`` (NULL = unresolved) and ``unknown_subject``.

    Every row looks up exactly one alias: its explicit record id, else its subject
    URL, else its name at that source. One join serves all three, and no row joins
    on an empty key.
    """
    wanted = (
        F.when(F.col("record_id").isNotNull(), _tagged("i:", F.col("record_id")))
        .when(F.col("link_key") != "", _tagged("u:", F.col("link_key")))
        .otherwise(_tagged("n:", F.col("name_source_key")))
    )
    keyed = relationships.withColumn("alias", wanted)
    owners = unique_aliases(alias_keys(profiles, observations))
    return (
        keyed.join(owners, "alias", "left")
        .withColumn("unknown_subject", F.col("record_id").isNotNull() & F.col("profile_id").isNull())
        .drop("alias")
    )


def orphans(observations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Observations whose profile is not in the export."""
    return observations.join(profiles.select("record_id"), "record_id", "left_anti")


def duplicate_keys(frame: DataFrame, key: str) -> DataFrame:
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def collector_counts(profiles: DataFrame, name: str = "collector") -> DataFrame:
    """Profiles per collector."""
    return profiles.groupBy(F.col(name).alias("collector")).agg(F.count(F.lit(1)).alias("count"))


def kind_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows per kind, and those that belong to no profile."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("profile_id").isNull()).alias("unresolved"))
