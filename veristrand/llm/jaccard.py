"""Documents whose sets of word n-grams are similar, by vertical partitioning of one global n-gram order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .linking import classes, shared
from .staging import concluded, staged, told

#: The global order of n-grams is cut into this many fragments.
FRAGMENTS = 8
#: At most so many frequent n-grams are told to every task (9 bytes each); the order is right with any choice.
FREQUENT = 1 << 18
#: N-grams that one task counts at a time.
COUNTED = 1 << 20
#: Tables of up to so many rows (of some fifty bytes) are sent to every task; beyond, both sides are shuffled.
TOLD = 1 << 18
#: N-grams before a posting's own that it carries, to tell whether a pair also meets at one of them.
BEFORE = 3


def ngram_sets(texts: list, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram codes of each text; empty without words."""
    for block in words.blocks(texts):
        codes, counts = words.word_codes(block)
        grams, number = words.windows(codes, counts, size)
        ends = np.cumsum(number)
        for end, count in zip(ends, number):
            yield np.unique(grams[end - count : end])


def frequent_ngrams(docs: DataFrame, size: int, *, text: str = "text", most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Codes and order classes of n-grams that many documents hold.

    Every task counts the n-grams of all its texts, in runs of bounded size, and hands on
    those it met in two texts or more; the sums of these counts rank them, and the ``most``
    frequent are returned, in classes of doubling frequency. They only shape the global
    order (rare first), so that rare n-grams name the candidates; results do not depend on it.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = [], 0
        for frame in batches:
            # Copies inside a batch count once: they meet as one set anyway.
            for own in ngram_sets(frame["text"].drop_duplicates().tolist(), size):
                held.append(own)
                total += len(own)
                if total >= COUNTED:
                    yield _repeated(held)
                    held, total = [], 0
        if held:
            yield _repeated(held)

    rows = (
        docs.select(F.col(text).alias("text")).mapInPandas(counted, "code long, n int")
        .groupBy("code").agg(F.sum("n").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "code").limit(most).toPandas())
    codes = rows["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], np.log2(rows["n"].to_numpy(np.float64, na_value=1))[order].astype(np.int8)


def _repeated(held: list[np.ndarray]) -> pd.DataFrame:
    codes, counts = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"code": codes[counts > 1].view(np.int64), "n": counts[counts > 1].astype(np.int32)})


def _classed(codes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, classes_ = frequent
    if not len(known):
        return np.zeros(len(codes), np.int8)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, classes_[at], 0)


def signatures(docs: DataFrame, size: int, percent: int, frequent, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ``doc_id``, ``text_digest``, ``set_digest`` (null: empty set), ``n``, ``prefix`` and ``parity``.

    The prefix holds the first n-grams of the set in the global order, as many as two sets of
    the wanted similarity cannot all differ in. The parities tell, for twice as many places as
    there are n-grams or more, whether an odd number of n-grams falls on each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = dict(docs.dtypes)[key]

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            texts = frame["text"].tolist()
            for value, own in zip(texts, ngram_sets(texts, size)):
                n = len(own)
                order = np.lexsort((own, _classed(own, sent.value)))[: n - -(-percent * n // 100) + 1]
                rows.append((
                    hashlib.md5((value or "").encode("utf-8", "surrogatepass")).hexdigest(),
                    hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if n else None, n,
                    own[order].view(np.int64) if n else own.view(np.int64), parities(own)))
            found = pd.DataFrame(rows, columns=["text_digest", "set_digest", "n", "prefix", "parity"])
            found.insert(0, "doc_id", frame["doc_id"].array)
            yield found

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        signed, f"doc_id {kind}, text_digest string, set_digest string, n long, prefix array<long>, parity array<long>")


def parities(own: np.ndarray) -> np.ndarray:
    """One bit for each of a power of two of places, by the lowest bits of the codes."""
    places = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differ(x: Column, y: Column) -> Column:
    """The number of places whose parities differ; null where one has more than twice the places of the other."""
    xor = lambda a, b: a.bitwiseXOR(b)
    half = lambda a: F.floor(F.size(a) / 2).cast("int")
    folded = lambda a: F.zip_with(F.slice(a, F.lit(1), half(a)), F.slice(a, half(a) + 1, half(a)), xor)
    as_few = lambda a, b: F.when(F.size(a) > F.size(b), folded(a)).otherwise(a)
    return F.aggregate(F.zip_with(as_few(x, y), as_few(y, x), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda n, m: n + m)


def segments(texts: DataFrame, size: int, frequent) -> DataFrame:
    """The sets of ``id``, ``text`` cut at the same points of the global order: id, fragment, grams.

    Rare n-grams are cut by the range of their code, frequent ones make the last fragment.
    """
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for own_id, own in zip(frame["id"], ngram_sets(frame["text"].tolist(), size)):
                rare = _classed(own, sent.value) == 0
                span = np.where(rare, (own >> np.uint64(32)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32), FRAGMENTS - 1)
                for fragment in np.unique(span):
                    rows.append((own_id, int(fragment), own[span == fragment].view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "fragment", "grams"])

    return texts.select("id", "text").mapInPandas(cut, "id long, fragment int, grams array<long>")


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` with ``overlap``: partial overlaps counted per fragment, then summed."""
    dealt = cut.repartition("id", "fragment")
    left = dealt.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("_left"))
    right = dealt.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("_right"))
    asked = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    partial = asked.join(left, ["a", "fragment"]).join(right, ["b", "fragment"]).select(
        "a", "b", F.size(F.array_intersect("_left", "_right")).alias("_partial"))
    return partial.groupBy("a", "b").agg(F.sum("_partial").alias("overlap"))


def similar(
    docs: DataFrame, *, size: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_digest``, ``n_shingles``, ``class``, ``component_id``.

    Two documents link when ``100 * overlap >= percent * union`` of their sets of word n-grams;
    linked documents have one ``class``, and a component's id is the smallest document id in it. Equal sets are one vertex, so copies
    are never compared. A null or blank text has an empty set and links with nothing: its
    component is its own id. Rows that repeat an id are rows of their own; a null id
    never names a component that has another. An empty table gives no rows.
    """
    frequent = frequent_ngrams(docs, size, text=text)
    signed = staged(signatures(docs, size, percent, frequent, key=key, text=text).withColumn(
        "row", F.monotonically_increasing_id()))
    # A set is named by one of its rows, so its prefix is read from there and not carried along.
    sets = staged(
        signed.filter("set_digest IS NOT NULL").groupBy("set_digest").agg(
            F.min("row").alias("id"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"),
            F.min("text_digest").alias("text_digest")))
    named = told(sets.select(F.col("id").alias("row")), TOLD)
    prefixes = signed.join(named, "row", "left_semi").select(F.col("row").alias("id"), "n", "prefix")

    def placed() -> DataFrame:
        own = staged(shared(prefixes.select("id", F.explode("prefix").alias("key"))))
        # What else a posting tells is in its prefix; few prefixes and postings are left to be joined.
        told_ = prefixes.join(own, "id").withColumn("at", (F.array_position("prefix", F.col("key")) - 1).cast("int")).withColumn(
            "before", F.slice("prefix", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE))))
        # A hub's shared n-grams come early in its order: it has few of its own before them.
        return told_.drop("prefix").withColumn("rank", (F.col("at").cast("long") * 1_000_000 / F.col("n")).cast("long"))

    spark = docs.sparkSession
    postings = concluded(spark, placed)

    def admissible(x: str, y: str):
        n, m, i, j = (F.col(f"{s}.{c}") for s, c in ((x, "n"), (y, "n"), (x, "at"), (y, "at")))
        needed = F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
            F.least(n - i, m - j) >= needed)

    def met(x: str, y: str):
        # An n-gram before in both: the pair meets there too, with more of both sets to come.
        return F.arrays_overlap(f"{x}.before", f"{y}.before")

    numbers = sets.select("id", "n")

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs that can be similar: no more parities differ than n-grams do."""
        ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        known = staged(signed.select(F.col("row").alias("id"), "n", "parity").join(told(ids, TOLD), "id", "left_semi"))
        both = pairs.join(known.withColumnsRenamed({"id": "a", "n": "_n", "parity": "_x"}), "a").join(
            known.withColumnsRenamed({"id": "b", "n": "_m", "parity": "_y"}), "b")
        differ = F.coalesce(_differ(F.col("_x"), F.col("_y")), F.lit(0))
        return both.filter((100 + percent) * differ <= (100 - percent) * (F.col("_n") + F.col("_m"))).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = staged(close(pairs))
        # Only texts in a pair are cut again; no n-gram of another text is ever shuffled.
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = _texts_of(docs, sets.select("id", "text_digest").join(wanted, "id", "left_semi"), text)
        cut = staged(segments(texts, size, frequent))
        sized = overlaps(pairs, cut).join(numbers.withColumnsRenamed({"id": "a", "n": "_n"}), "a").join(
            numbers.withColumnsRenamed({"id": "b", "n": "_m"}), "b")
        return sized.filter(100 * F.col("overlap") >= percent * (F.col("_n") + F.col("_m") - F.col("overlap"))).select("a", "b")

    # Pairs, parities and n-grams of a round go once its links are written.
    verified = lambda pairs: concluded(spark, lambda: verify(pairs))
    roots = concluded(spark, lambda: classes(postings, verified, admissible, met=met))
    rooted = sets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    decided = rooted.join(first, "root").select("set_digest", F.col("root").alias("class"), "component_id")
    return signed.join(decided, "set_digest", "left").select(
        "doc_id", "text_digest", F.col("n").alias("n_shingles"), "class",
        F.when(F.col("set_digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, then the smallest digest.

    Documents without words stay; rows that repeat both id and text are one document.
    """
    found = similar(docs, size=size, percent=percent, key=key, text=text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_digest")
    chosen = found.filter("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("o")).select("o.doc_id", "o.text_digest")
    stay = chosen.unionByName(found.filter("class IS NULL").select("doc_id", "text_digest"))
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.withColumn("_llm_own", _identity(F.col(key), digest)).join(
        stay.select(_identity(F.col("doc_id"), F.col("text_digest")).alias("_llm_own")), "_llm_own", "left_semi"
    ).dropDuplicates(["_llm_own"]).drop("_llm_own")


def _identity(key: Column, digest: Column) -> Column:
    """One value for an id, null or not, and a text: spreads copies of a text over all tasks."""
    return F.md5(F.concat_ws(":", key.isNull().cast("string"), key.cast("string"), digest))


def _texts_of(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``id`` and ``text`` of the wanted digests, one text each."""
    digested = docs.select(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_digest"), F.col(text).alias("text"))
    return digested.join(told(staged(wanted), TOLD), "text_digest").dropDuplicates(["id"])
