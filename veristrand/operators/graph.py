"""Short sourced paths between profiles through documented entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from ..session import checkpointed

MAX_HOPS, MAX_VISITED = 4, 10_000
SAME = "Same source record"
SHARED = "Shared documented entities; not proof of acquaintance or an available introduction."
EXHAUSTED = "Search budget exhausted; no absence conclusion."
NO_PATH = "No path in the imported resolved evidence within this hop limit."


@dataclass(frozen=True)
class Path:
    steps: list[dict]
    found: bool
    truncated: bool
    meaning: str


def edges(relationships: DataFrame) -> DataFrame:
    """(relationship_id, profile_id, entity_url, payload): resolved rows with an HTTP(S) object."""
    url = P.field(P.variant(F.col("payload")), "object_url")
    return (
        relationships.filter("profile_id IS NOT NULL")
        .select(F.col("pos").alias("relationship_id"), "profile_id", url.alias("entity_url"), "payload")
        .filter(F.col("entity_url").rlike(r"(?i)^\s*https?:"))
    )


def next_level(frontier: DataFrame, links: DataFrame, visited: DataFrame, here: str, there: str,
               budgeted: bool = True) -> DataFrame:
    """(node, trail) first reached from the frontier.

    ``trail`` is the list of relationship ids walked. Breadth-first order is the
    order of these lists: by parent, then by the first relationship between two
    nodes. Under the visit budget the frontier never exceeds 10,000 rows, a proven
    bound, so it is broadcast and the relationship table is not shuffled. Without
    a budget it may be any size and Spark chooses the join.
    """
    small = F.broadcast if budgeted else lambda frame: frame
    reached = (
        links.join(small(frontier.withColumnRenamed("node", here)), here)
        .select(F.col(there).alias("node"), F.concat("trail", F.array("relationship_id")).alias("trail"))
        .groupBy("node").agg(F.min("trail").alias("trail"))
    )
    return reached.join(small(visited), "node", "left_anti")


def shortest_path(relationships: DataFrame, source: str, target: str, max_hops: int = 4,
                  max_visited: int | None = 5000) -> Path:
    """Breadth-first search; the caller has checked that both profiles exist.

    ``max_visited`` is the visit budget; with None every node within the hops is visited.
    """
    budgeted = max_visited is not None
    if not 1 <= max_hops <= MAX_HOPS or budgeted and not 1 <= max_visited <= MAX_VISITED:
        raise ValueError("Paths support 1–4 hops and at most 10000 visited nodes")
    if source == target:
        return Path([], True, False, SAME)
    spark = relationships.sparkSession
    links = edges(relationships)
    frontier = spark.createDataFrame([(source, [])], "node string, trail array<bigint>")
    seen = {"profile_id": frontier.select("node"), "entity_url": spark.createDataFrame([], "node string")}
    visited = 0
    for hop in range(max_hops):
        here, there = ("profile_id", "entity_url") if hop % 2 == 0 else ("entity_url", "profile_id")
        level = checkpointed(next_level(frontier, links.select("relationship_id", "profile_id", "entity_url"),
                                        seen[there], here, there, budgeted))
        goal = level.filter(F.col("node") == target).first() if there == "profile_id" else None
        if goal:
            trail = F.array(*[F.lit(i) for i in goal.trail])
            if not budgeted or visited + level.filter(F.col("trail") < trail).count() < max_visited:
                return Path(_steps(links, source, goal.trail), True, False, SHARED)
            return Path([], False, True, EXHAUSTED)
        arrived = level.count()
        visited += arrived
        if budgeted and visited >= max_visited:
            return Path([], False, True, EXHAUSTED)
        if not arrived:
            break
        frontier, seen[there] = level, seen[there].unionByName(level.select("node"))
    return Path([], False, False, NO_PATH)


def _steps(links: DataFrame, source: str, trail: list[int]) -> list[dict]:
    """The relationship behind each step of a found path, at most four rows."""
    doc = P.variant(F.col("payload"))
    get = lambda name: P.field(doc, name).alias(name)
    rows = {
        r.relationship_id: r.asDict() for r in links.filter(F.col("relationship_id").isin(trail)).select(
            "relationship_id", "profile_id", "entity_url", get("object_name"), get("relation"), get("source_url"),
            get("evidence_date"), get("evidence")).collect()
    }
    steps, node = [], f"profile:{source}"
    for number, relationship_id in enumerate(trail):
        row = rows[relationship_id]
        reached = f"entity:{row['entity_url']}" if number % 2 == 0 else f"profile:{row['profile_id']}"
        steps.append({"from": node, "to": reached, "evidence": row})
        node = reached
    return steps
