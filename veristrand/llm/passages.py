"""Passages that an earlier document holds too, found by doubling windows of words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .staging import staged

#: Words of a window, and of the windows from which doubling begins.
WINDOW, FIRST = 50, 25
#: Windows that a task holds before equal ones meet in it and the rest is handed on.
HELD = 1 << 19
_TABLE = spans.table(b" \t\n\x0b\x0c\r")
#: A document without an id comes after all others.
_LATE = np.iinfo(np.int64).max
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def doubled(codes: np.ndarray, size: int) -> np.ndarray:
    """The code of the ``size`` words from every place on, doubled up from those of half the length."""
    if size == 1 or len(codes) < size:
        return codes
    half = doubled(codes, size // 2)
    whole, step = half.copy(), size // 2
    whole[: len(half) - step] = spans.followed(half[: len(half) - step], half[step:])
    if size % 2:
        whole[: len(codes) - size + 1] = spans.followed(whole[: len(codes) - size + 1], codes[size - 1 :])
    return whole


def _over(values: np.ndarray, size: int, choose) -> np.ndarray:
    """The least or largest of the ``size`` values from each place on, as far as there are any."""
    out, reach = values.copy(), 1
    while reach < size and reach < len(values):
        step = min(reach, size - reach)
        out[: len(out) - step] = choose(out[: len(out) - step], out[step:])
        reach += step
    return out


def _anchors(found: spans.Words, short: np.ndarray, span: int, window: int) -> np.ndarray:
    """Whether the short window at a place is the least of the first ``span`` in some whole window.

    That depends on the words of the whole window alone: texts that share one share an anchor in it.
    """
    least = np.where(found.together(window), _over(short, span, np.minimum), np.uint64(0))
    before = np.concatenate((np.zeros(span - 1, np.uint64), least))
    return (_over(before, span, np.maximum)[: len(short)] == short) & (short != 0)


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    """Words of a block, and of each the document, the row and the place in its text."""
    for batch in batches:
        docs, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        texts = (t.as_py().translate(_TABLE) if t.is_valid else b"" for t in batch.column(2))
        for block, numbers, starts in spans.blocks(texts):
            found = spans.Words(block)
            if len(found) >= window:
                at = np.searchsorted(starts, found.starts, side="right") - 1
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                yield found, docs[numbers[at]], rows[numbers[at]], place


def _lasting(found: spans.Words, filters: list, lengths: list[int], window: int) -> np.ndarray:
    """Anchors whose windows were repeated at every length so far."""
    short = doubled(found.codes, lengths[0])
    last = _anchors(found, short, window - lengths[-1] + 1, window)
    for length, known in zip(lengths, filters):
        last &= known.value.has(doubled(found.codes, length))
    return last


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _level(filters: list, lengths: list[int], window: int):
    """Windows of the next length at the anchors that lasted: code, least and largest document."""

    def met(held: list[tuple]) -> tuple[np.ndarray, ...]:
        codes, least, most = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(codes, kind="stable")
        codes, least, most = codes[order], least[order], most[order]
        cut = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[cut], np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)

    def leveled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found, docs, _, _ in _blocks(batches, window):
            at = np.flatnonzero(_lasting(found, filters, lengths, window))
            if len(at):
                held.append((doubled(found.codes, lengths[len(filters)])[at], docs[at], docs[at]))
                size += len(at)
            if size > HELD:
                codes, least, most = met(held)
                held, size = [(codes, least, most)], len(codes)
                if size > HELD // 2:
                    yield _batch({"code": codes.view(np.int64), "least": least, "most": most})
                    held, size = [], 0
        if held:
            codes, least, most = met(held)
            yield _batch({"code": codes.view(np.int64), "least": least, "most": most})

    return leveled


def _whole_windows(filters: list, lengths: list[int], window: int):
    """All whole windows around lasting anchors; of equal ones in a task only those of its first document are open.

    The windows of its later documents are known to be repeated: they need no comparison, and a
    passage that very many documents hold comes from each task a few times at most.
    """
    columns = ("code", "other", "doc", "row", "place")

    def decided(held: list[tuple]) -> pa.RecordBatch:
        code, other, doc, row, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, row, doc, other, code))
        code, other, doc, row, place = (c[order] for c in (code, other, doc, row, place))
        fresh = np.append(True, (code[1:] != code[:-1]) | (other[1:] != other[:-1]))
        known = doc > doc[np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))]
        again = np.append(False, ~fresh[1:] & (row[1:] == row[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]))
        # What is known meets nothing, so it is dealt by its place instead of its words.
        code = np.where(known, spans.mixed(row.view(np.uint64) + place.astype(np.uint64)), code)
        keep = ~again
        back = np.lexsort((place[keep], row[keep]))
        values = (code.view(np.int64), other, doc, row, (2 * place + known).astype(np.int64))
        return _batch({n: v[keep][back] for n, v in zip(columns, values)})

    def found_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found, docs, rows, place in _blocks(batches, window):
            last = _lasting(found, filters, lengths, window)
            at = np.flatnonzero(found.together(window) & _over(last, window - lengths[-1] + 1, np.logical_or))
            if len(at):
                code = doubled(found.codes, window)[at]
                other = (doubled(spans.mixed(found.codes ^ _OTHER), window)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                held.append((code, other, docs[at], rows[at], place[at]))
                size += len(at)
            if size > HELD:
                yield decided(held)
                held, size = [], 0
        if held:
            yield decided(held)

    return found_whole


def repeated_windows(docs: DataFrame, *, window: int = WINDOW, first: int = FIRST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``row``, ``place`` of every window of ``window`` words that begins in a document with a smaller id too.

    Lengths double from ``first`` to at least half a window. At each, only windows at anchors are
    counted (the least code of those in a whole window, so texts that share the window share the
    anchor), and only those that two documents hold are doubled; the survivors are told as a filter
    of fixed size, which may let more through, never less. The last doubling gives whole windows around the anchors that
    survived; these are compared by 96 bits. When no candidates survive nothing is left to compare.
    """
    spark = docs.sparkSession
    lengths = [min(first, window)]
    while 2 * lengths[-1] < window:
        lengths.append(2 * lengths[-1])
    given = _given(docs, key, text).select("doc", "row", F.col(text).cast("binary").alias("text"))
    filters: list = []
    for _ in lengths:
        level = given.mapInArrow(_level(filters, lengths, window), "code long, least long, most long")
        survivors = level.groupBy("code").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most")
        filters.append(spark.sparkContext.broadcast(spans.Filter.of(survivors.select("code"))))
        if not filters[-1].value:
            break
    kinds = "code long, other int, doc long, row long, place long"
    if not filters[-1].value:
        return spark.createDataFrame([], kinds).select("doc", "row", "place")
    # One row per task and open window: many documents with one passage are no large group here.
    holders = Window.partitionBy("code", "other")
    whole = given.mapInArrow(_whole_windows(filters, lengths, window), kinds).withColumn("earliest", F.min("doc").over(holders))
    return whole.filter("place % 2 = 1 OR earliest < doc").select("doc", "row", F.shiftright("place", 1).cast("int").alias("place"))


def _given(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return docs.select(
        *more, F.coalesce(F.col(key).cast("long"), F.lit(_LATE)).alias("doc"),
        F.xxhash64(F.col(key).cast("long"), F.col(text)).alias("row"), *([] if text in more else [F.col(text)]))


def dedup_passages(docs: DataFrame, *, window: int = WINDOW, first: int = FIRST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one blank).

    A word goes when a window of ``window`` words over it also begins in a document with a smaller id;
    windows are judged on the given texts. The id must be integral. A null id comes after all
    others; rows with one id never remove anything from each other, so repeated rows keep their words alike.
    Null, blank and short texts lose nothing. Columns named like a result are replaced, all
    others pass unchanged; an empty table gives no rows.
    """
    added = {"n_words": "long", "n_removed": "long", "kept": "string"}
    passed = [c for c in docs.columns if c not in added]
    gone = repeated_windows(docs, window=window, first=first, key=key, text=text).groupBy("doc", "row").agg(
        F.collect_list("place").alias("_llm_places")).withColumnsRenamed({"doc": "_llm_doc", "row": "_llm_row"})
    own = [(F.coalesce(F.col(key).cast("long"), F.lit(_LATE)) == F.col("_llm_doc")),
           F.xxhash64(F.col(key).cast("long"), F.col(text)) == F.col("_llm_row")]
    joined = docs.select(*passed).join(gone, own[0] & own[1], "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def rest(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_rest(t, p, window) for t, p in zip(texts, places)], columns=list(added))

    taken = joined.withColumn("_llm_rest", rest(F.col(text), F.col("_llm_places")))
    return taken.select(*passed, *[F.col(f"_llm_rest.{c}").alias(c) for c in added])


def _rest(text: str | None, places, window: int) -> tuple[int, int, str]:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if places is None:
        return len(words), 0, b" ".join(words).decode("utf-8", "replace")
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    stays = (np.cumsum(change)[: len(words)] == 0).tolist()
    kept = list(compress(words, stays))
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")


def digest(kept: str | Column) -> Column:
    return F.sha2(F.col(kept) if isinstance(kept, str) else kept, 256)
