"""Phrases whose words belong together, from stripes: per prefix, one counter of the words that follow it."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .staging import staged

#: Words of the longest phrase.
LONGEST = 5
#: Occurrences from which a phrase is a candidate.
LEAST = 100
#: Runs of up to so many words are counted by their codes before any words are written.
CODED = 3
#: Characters between pieces, and between words of a piece.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: The counter of a prefix whose first word comes this many times as often as a phrase must, is dealt
#: over so many rows by the word that follows, so that no prefix is one group.
HEAVY, SLICES = 1000, 8
#: Entries that a task holds before it hands them on, and strings of those that it writes out.
HELD, HELD_STRINGS = 1 << 20, 1 << 19
#: Bytes of a block from which words are written: the larger, the fewer runs come twice.
WORD_BYTES = 1 << 21
#: The best of each language are chosen among so many parts first.
PARTS = 64
_TABLE = spans.table(BLANKS, BREAKS, lower=True)


def _blocks(batches: Iterator[pa.RecordBatch], size: int = spans.BLOCK_BYTES) -> Iterator[tuple[spans.Words, list[bytes]]]:
    """The words of a block, coded with their language, and the language of every word."""
    for batch in batches:
        langs = [lang.as_py().encode() for lang in batch.column(0)]
        texts = (t.as_py().translate(_TABLE) if t.is_valid else b"" for t in batch.column(1))
        salts = {lang: np.uint64(zlib.crc32(lang)) * spans.BASE for lang in set(langs)}
        for block, numbers, starts in spans.blocks(texts, size):
            found = spans.Words(block)
            if not len(found):
                continue
            own = numbers[np.searchsorted(starts, found.starts, side="right") - 1]
            found.codes = spans.mixed(found.codes ^ np.array([salts[lang] for lang in langs], np.uint64)[own])
            yield found, [langs[i] for i in own]


class _Tally:
    """Codes with counts, in bounded memory: equal ones meet, the rest is handed on."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > HELD:
            merged = self._merged()
            if len(merged[0]) > HELD // 2:
                yield merged
                self.parts, self.size = [], 0
            else:
                self.parts, self.size = [merged], len(merged[0])

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.size:
            yield self._merged()

    def _merged(self) -> tuple[np.ndarray, ...]:
        *keys, counts = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort(keys[::-1])
        keys, counts = [k[order] for k in keys], counts[order]
        first = np.ones(len(counts), bool)
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return *[k[first] for k in keys], np.add.reduceat(counts, np.flatnonzero(first))


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of words with their counts, and per language the number of all words."""
    tally, totals = _Tally(), defaultdict(int)
    shape = lambda lang, code, n: pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])
    for found, langs in _blocks(batches):
        for lang in set(langs):
            totals[lang] += langs.count(lang)
        codes, counts = np.unique(found.codes, return_counts=True)
        for held, n in tally.add(codes, counts):
            yield shape([None] * len(n), held.view(np.int64), n)
    for held, n in tally.rest():
        yield shape([None] * len(n), held.view(np.int64), n)
    if totals:
        yield shape([lang.decode() for lang in totals], [None] * len(totals), list(totals.values()))


def _stripes(prefix: np.ndarray, cut: np.ndarray, nexts: pa.Array, counts: np.ndarray, more: dict) -> pa.RecordBatch:
    """One row for each run of equal prefix and slice, sorted before."""
    offsets = pa.array(np.append(cut, len(counts)).astype(np.int32))
    columns = more | {
        "prefix": prefix, "nexts": pa.ListArray.from_arrays(offsets, nexts),
        "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _half(codes: np.ndarray) -> np.ndarray:
    """The part of a word's code that is shuffled for a word that follows."""
    return codes >> np.uint64(32)


def _frequent(found: spans.Words, filters: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each size that has a filter: the codes of the words from a place on, and whether they may be frequent."""
    codes, open_ = [found.codes], [filters[0].value.has(found.codes)]
    for size, known in enumerate(filters[1:], 2):
        longer, last = codes[-1].copy(), len(found) - size + 1
        allowed = np.zeros(len(found), bool)
        if last > 0:
            longer[:last] = spans.followed(codes[-1][:last], _half(found.codes[size - 1 :]))
            allowed[:last] = open_[-1][:last] & open_[-1][1 : last + 1]
            at = np.flatnonzero(allowed & found.together(size))
            allowed[:] = False
            allowed[at] = known.value.has(longer[at])
        codes.append(longer)
        open_.append(allowed)
    return codes, open_


def _code_stripes(filters: list, heavy):
    """Stripes of codes over all runs of words, one longer than the filters know, whose parts may all be frequent."""

    def shaped(prefix: np.ndarray, following: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (following & np.uint64(SLICES - 1)).astype(np.int32)
        order = np.lexsort((part, prefix))
        prefix, part = prefix[order], part[order]
        cut = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])))
        nexts = (following >> np.uint64(32)).astype(np.uint32).view(np.int32)[order]
        return _stripes(pa.array(prefix[cut].view(np.int64)), cut, pa.array(nexts), counts[order], {"slice": pa.array(part[cut])})

    def striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, size = _Tally(), len(filters) + 1
        for found, _ in _blocks(batches):
            codes, open_ = _frequent(found, filters)
            first = np.flatnonzero(found.together(size)[:-1] & open_[-1][:-1] & open_[-1][1:])
            if len(first):
                following = _half(found.codes[first + size - 1])
                part = np.where(heavy.value.has(found.codes[first]), following % np.uint64(SLICES), np.uint64(0))
                for held in tally.add(codes[-1][first], following << np.uint64(32) | part, np.ones(len(first), np.int32)):
                    yield shaped(*held)
        for held in tally.rest():
            yield shaped(*held)

    return striped


def _word_stripes(filters: list, heavy, useful, longest: int):
    """Stripes of the words themselves, over all prefixes whose parts may all be frequent.

    What follows a prefix and cannot make a candidate (a piece's end, a rare run) is counted under
    an empty word, so the sum of a stripe is the count of its prefix. Words of no frequent pair are left out.
    """

    def shaped(held: dict, gone: list[bytes], names: list[bytes]) -> pa.RecordBatch:
        rows = []
        for key in gone:
            tag, _, run = key.partition(b"\n")
            prefix, _, word = run[1:].rpartition(b" ")
            rows.append((names[int(tag)], prefix, sum(word) % SLICES if run[:1] == b"+" else 0, word, held.pop(key)))
        rows.sort()
        cut = [i for i, r in enumerate(rows) if not i or r[:3] != rows[i - 1][:3]]
        text = lambda column: [rows[i][column].decode("utf-8", "replace") for i in cut]
        return _stripes(
            pa.array(text(1)), np.array(cut), pa.array([r[3].decode("utf-8", "replace") for r in rows]),
            np.array([r[4] for r in rows]), {"lang": pa.array(text(0)), "slice": pa.array([rows[i][2] for i in cut], pa.int32())})

    def striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A language's number, a line feed, + for a heavy prefix, the prefix, a blank, the word that follows (or none).
        held: dict[bytes, int] = defaultdict(int)
        tags: dict[bytes, bytes] = {}
        for found, langs in _blocks(batches, WORD_BYTES):
            codes, number = found.codes, len(found)
            for lang in set(langs) - tags.keys():
                tags[lang] = b"%d\n" % len(tags)
            _, known = _frequent(found, filters)
            own, open_ = codes, known[0] & useful.value.has(_half(codes))
            signs = [b"-", b"+"]
            for size in range(1, longest):
                first = np.flatnonzero(open_)
                if not len(first):
                    break
                # The longest run that the filters know and that ends with the next word tells whether it may follow.
                reach = min(size + 1, len(filters))
                goes_on = known[reach - 1][first + size + 1 - reach]
                # A word that makes a rare run is no word at all here.
                after = np.where(goes_on, codes[np.minimum(first + size, number - 1)], np.uint64(0))
                _, at, counts = np.unique(spans.followed(own[first], after), return_index=True, return_counts=True)
                begin, more = first[at], goes_on[at]
                ends = found.ends[begin + size - 1 + more]
                dealt = heavy.value.has(codes[begin])
                for i, a, e, m, d, n in zip(
                    begin.tolist(), found.starts[begin].tolist(), ends.tolist(), more.tolist(), dealt.tolist(), counts.tolist()):
                    run = found.block[a:e]
                    if b"  " in run:
                        run = b" ".join(run.split())
                    held[tags[langs[i]] + signs[d] + run + (b"" if m else b" ")] += n
                if len(held) > HELD_STRINGS:  # the rarer half goes, what comes often stays
                    middle = sorted(held.values())[len(held) // 2]
                    yield shaped(held, [k for k, n in held.items() if n <= middle], list(tags))
                longer = np.zeros(number, bool)
                longer[first[goes_on]] = True
                ends = np.minimum(np.arange(number) + size, number - 1)
                own, open_ = spans.followed(own, codes[ends]), longer
        if held:
            yield shaped(held, list(held), list(tags))

    return striped


def _merged(stripes: DataFrame, *key: str) -> DataFrame:
    """Stripes summed elementwise: ``next`` and ``n`` per prefix. Only stripes are shuffled, once."""
    dealt = stripes.repartition(*key, "slice")
    entries = dealt.select(*key, "slice", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    return entries.groupBy(*key, "slice", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("n"))


def _told(codes: DataFrame):
    return codes.sparkSession.sparkContext.broadcast(spans.Filter.of(codes.select("code")))


def _exact(number: Column) -> Column:
    return number.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, *, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST,
) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of all phrases that are not part of an equally frequent one.

    A text is lower-cased (A-Z), split at ``BREAKS`` into pieces and these into words. Phrases are
    2 to ``longest`` neighbouring words of a piece with ``a >= least`` occurrences in all texts of
    a language. The score is the lowest over all cuts into two parts of ``1000 a n / (l r)``, rounded
    down, with the counts ``l`` and ``r`` of the parts and ``n`` of all words; the first such cut counts.

    One table of stripes answers everything: its entries are the phrases, its sums the counts of
    the parts, its largest entry says whether a prefix is always followed by one word. An equally
    frequent longer phrase implies one that is a single word longer, so no others are looked at.

    Passes over codes before, one for each length up to ``CODED``, only choose what is counted: a phrase
    can reach ``least`` only if all its parts do. What they find is told as filters of fixed size, which
    may let more through, never less, and the words themselves are counted in the end.

    A null language is ``und``; null and empty texts hold no words. Repeated rows count each
    time. An empty table gives no rows; other columns are not looked at.
    """
    given = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    words = staged(given.mapInArrow(_counted_words, "lang string, code long, n long").groupBy("lang", "code").agg(
        F.sum("n").alias("n")).filter(F.col("code").isNull() | (F.col("n") >= least)))
    totals = words.filter("code IS NULL").select("lang", "n")
    single = words.filter("code IS NOT NULL")
    filters, heavy, useful = [_told(single)], _told(single.filter(F.col("n") >= HEAVY * least)), None
    while len(filters) < min(CODED, longest):
        coded = given.mapInArrow(_code_stripes(filters, heavy), "slice int, prefix long, nexts array<int>, counts array<int>")
        runs = staged(_merged(coded, "prefix").filter(F.col("n") >= least).select("prefix", "next"))
        useful = useful or _told(runs.select(F.explode(F.array(
            F.shiftrightunsigned("prefix", 32), F.col("next").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("code")))
        filters.append(_told(runs.select(_followed(F.col("prefix"), F.col("next")).alias("code"))))
    striped = given.mapInArrow(_word_stripes(filters, heavy, useful, longest),
                               "lang string, slice int, prefix string, nexts array<string>, counts array<int>")
    # A stripe's slices are summed each for itself; what they add up to are few rows per prefix.
    stripes = staged(_merged(striped, "lang", "prefix").select("lang", "prefix", "slice", "next", "n"))
    prefixes = staged(stripes.groupBy("lang", "prefix").agg(
        F.sum("n").alias("f"), F.max(F.when(F.col("next") != "", F.col("n"))).alias("extended")).filter(F.col("f") >= least))
    found = stripes.filter((F.col("next") != "") & (F.col("n") >= least)).select(
        "lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a"))
    return _scored(staged(found.withColumn("words", F.split("phrase", " "))), prefixes, totals)


def _followed(prefix: Column, following: Column) -> Column:
    """The code of a run and the word that follows it, as the filters have it."""

    @F.pandas_udf("long")
    def paired(a, b):
        import pandas as pd

        both = spans.followed(a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int32).view(np.uint32).astype(np.uint64))
        return pd.Series(both.view(np.int64))

    return paired(prefix, following)


def _scored(found: DataFrame, prefixes: DataFrame, totals: DataFrame) -> DataFrame:
    size = F.size("words")
    # A phrase without its first word is extended to the left by it.
    left = found.filter(size > 2).select("lang", F.array_join(F.slice("words", F.lit(2), size - 1), " ").alias("phrase"), "a")
    right = prefixes.filter("extended IS NOT NULL").select("lang", F.col("prefix").alias("phrase"), F.col("extended").alias("a"))
    longer = left.unionByName(right).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = found.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    cuts = alone.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("tail"))
    heads = prefixes.select("lang", F.col("prefix").alias("head"), F.col("f").alias("l"))
    tails = prefixes.select("lang", F.col("prefix").alias("tail"), F.col("f").alias("r"))
    # One row per language: at most as many as there are languages.
    met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    scored = met.withColumn("_over", _exact(1000 * F.col("a")) * _exact(F.col("n"))).withColumn(
        "_under", _exact(F.col("l")) * _exact(F.col("r"))).withColumn("score", F.expr("_over div _under"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    return lowest.select("lang", "phrase", *[f"c.{x}" for x in ("a", "l", "r", "n", "score")])


def best(scored: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language with their ``rank``: by score, then ``a``, then phrase."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parted = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = parted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(
        F.col("_rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= most).drop("_part", "_rank")
