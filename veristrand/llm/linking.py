"""From shared keys to connected classes without listing the pairs inside a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import concluded, discard, staged

Admissible = Callable[[str, str], Column]
#: Holders of a key that its others are compared with in the second round unless told otherwise, and the factor of every round after it.
STRANGERS, WIDER = 16, 8


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every id in the links ``a``, ``b``.

    Distributed union-find by alternating stars: every id hands its larger neighbours to its
    smallest neighbour, then its smaller ones, until each id points to one root. Minima combine
    before they are shuffled, and the joins back on a busy id can be split, so a hub costs no
    task more than its share. Each round is cut off on shared storage.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _flat(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select("u", F.col("m").alias("v")).unionByName(
            met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _flat(edges: DataFrame) -> bool:
    """Whether every id points to one other at most, which itself points nowhere."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter("out > 1 OR out = 1 AND into = 1").isEmpty()


def shared(postings: DataFrame) -> DataFrame:
    """The postings, ``key`` and ``id``, whose key at least two ids hold."""
    # A window deals the postings once; counted and joined, they were dealt twice.
    own = Window.partitionBy("key")
    ends = postings.select("key", "id", F.min("id").over(own).alias("_least"), F.max("id").over(own).alias("_most"))
    return ends.filter("_least < _most").select("key", "id")


def classes(
    postings: DataFrame, verify: Callable[[DataFrame], DataFrame], admissible: Admissible | None = None, hubs: int = 1,
    met: Admissible | None = None, strangers: int = STRANGERS,
) -> DataFrame:
    """``id`` and ``root`` of all ids that verified links connect.

    ``postings``, a stored table, has key, id, rank and what ``admissible`` needs; a pair is a candidate when it
    shares a key and is admissible. First every key's holders are compared with the few
    (``hubs``) of lowest rank alone. What that connects needs no further comparison; every key
    that still holds several classes then compares some holders outside its largest class with
    all holders of other classes, ``WIDER`` times as many each round, until a round compared all
    that were left. So no link between classes is lost, and a group of near copies, most of
    which join a class in the first rounds, costs a few comparisons per member instead of one per pair.

    A key whose holders outside its largest class were all compared in a round is done: it is not read again.

    ``met`` may tell that two postings of a key also share another key, at which they are admissible
    too and not ``met``. The rounds then list the pair there alone: the last compares all
    classes at every key, so it misses none.
    """
    admissible = admissible or (lambda x, y: F.lit(True))
    afresh = (lambda x, y: admissible(x, y) & ~met(x, y)) if met else admissible
    order = Window.partitionBy("key").orderBy("rank", "id")
    lowest = lambda rows, most: rows.withColumn(
        "_place", F.row_number().over(order)).filter(F.col("_place") <= most).drop("_place")
    compared = staged(_pairs(postings, lowest(postings, hubs), admissible, F.col("x.id") != F.col("y.id")))
    links = staged(verify(compared))
    width = max(hubs, strangers)
    spark = postings.sparkSession
    first = postings
    while True:
        # What a round stages on its way goes as soon as its result is written.
        roots = concluded(spark, lambda: components(links))
        placed = postings.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_n"))
        mixed = staged(sizes.groupBy("key").agg(
            F.max_by("root", F.struct("_n", "root")).alias("_top"), F.count(F.lit(1)).alias("_roots"),
            (F.sum("_n") - F.max("_n")).alias("_strangers")).filter("_roots > 1"))
        left = mixed.agg(F.max("_strangers")).first()[0]
        if left is None:
            return roots
        rest = concluded(spark, lambda: _unmet(placed, mixed, lowest, width, afresh).join(compared, ["a", "b"], "left_anti"))
        more = staged(verify(rest))
        if left > width:
            # What is left to compare are the keys with more strangers than this round took.
            more_keys = mixed.filter(F.col("_strangers") > width).select("key")
            before, postings = postings, staged(postings.join(more_keys, "key", "left_semi"))
            if before is not first:
                discard(spark, before)
        else:
            return roots if more.isEmpty() else components(links.unionByName(more))
        compared, links, width = compared.unionByName(rest), links.unionByName(more), width * WIDER


def _pairs(left: DataFrame, right: DataFrame, admissible: Admissible, further: Column) -> DataFrame:
    """The distinct pairs (a < b) of both sides' ids that share a key."""
    met = left.alias("x").join(right.alias("y"), (F.col("x.key") == F.col("y.key")) & further & admissible("x", "y"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _unmet(placed: DataFrame, mixed: DataFrame, lowest, width: int, admissible: Admissible) -> DataFrame:
    """The pairs of each mixed key's lowest strangers with its postings of other classes."""
    open_rows = staged(placed.join(mixed.select("key", "_top"), "key"))
    centres = lowest(open_rows.filter("root <> _top"), width)
    return _pairs(centres, open_rows, admissible, F.col("x.root") != F.col("y.root"))
