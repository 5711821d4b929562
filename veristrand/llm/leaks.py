"""Benchmark passages inside documents: q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Bytes of a q-gram, which is then one machine word.
GRAM = 8
#: Items are looked for by windows of so many bytes of UTF-8, and the next one begins so many bytes later.
WINDOW, STEP = 100, 10
#: Share of a window's bytes that may differ: its edit budget.
EDITS = 0.08
#: Diagonals by which bands advance; each also covers the first ones of the next, as many as the budget.
ADVANCE = 16
#: Characters of items that are searched in one pass over the documents; more items take more passes.
BLOCK_CHARS = 4_000_000
#: Hits that are counted, and regions that are aligned, at a time.
HITS, REGIONS = 2_000_000, 4_096

# Letters and digits stand for themselves, A-Z for a-z, all else of ASCII for a space; 0 is kept for borders.
_TABLE = np.array([
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 0 else 32 for b in range(256)],
    np.uint8)


def lowered(text: str | None) -> str:
    """Lower case, letter by letter, so that places in the text stay what they are."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in the form they are compared in, runs of spaces as one, and where each came from."""
    mapped = _TABLE[data]
    space = mapped == 32
    keep = np.ones(len(mapped), bool)
    keep[1:] = ~(space[1:] & (space[:-1] | (mapped[:-1] == 0)))
    return mapped[keep], np.flatnonzero(keep)


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each byte, as one number."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    codes = data.astype(np.uint64)
    for size in (1, 2, 4):
        codes = codes[:-size] | (codes[size:] << np.uint64(8 * size))
    return codes


class Index:
    """The windows of one block of items and the q-grams in them."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, edits: float = EDITS):
        self.owner, self.at, self.tiny, parts = [], [], [], []
        for number, text in items:
            data = lowered(text).encode("utf-8", "surrogatepass").replace(b"\0", b" ").strip()
            form = normal(np.frombuffer(data, np.uint8))[0]
            if len(form) < GRAM:
                # Without a q-gram; looked for as it is.
                if form.tobytes().strip():
                    self.tiny.append((number, form.tobytes()))
                continue
            last = max(0, len(form) - window)
            for start in sorted({*range(0, last, STEP), last}):
                self.owner.append(number)
                self.at.append(start)
                parts.append(form[start : start + window])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.budget = np.minimum((self.sizes * edits).astype(np.int64), (self.sizes - GRAM) // GRAM)
        self.least = self.sizes - GRAM + 1 - GRAM * self.budget
        self.letters = np.zeros((len(parts), window), np.uint8)
        for i, part in enumerate(parts):
            self.letters[i, : len(part)] = part
        self.widest = int(self.budget.max(initial=0))
        codes = [grams(p) for p in parts]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.window = np.repeat(np.arange(len(parts)), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.arange(len(c)) for c in codes] or [np.zeros(0, np.int64)])[order]
        # For windows of like size: the least q-grams shared, and the most letters they lie within.
        like = self.sizes // 16
        self.dense = [
            (int(self.least[like == g].min()), int((self.sizes + self.budget)[like == g].max())) for g in np.unique(like)]
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.codes))))) + 6)
        self.shift = np.uint64(64 - min(bits, 26))
        self.seen = np.zeros(1 << min(bits, 26), bool)
        self.seen[self._slots(self.codes)] = True

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * words.BASE) >> self.shift

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram is indexed, and its number."""
        at = np.flatnonzero(self.seen[self._slots(codes)])
        number = np.searchsorted(self.codes, codes[at])
        number = np.minimum(number, len(self.codes) - 1)
        same = self.codes[number] == codes[at]
        return self._crowded(at[same], number[same])

    def _crowded(self, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hits among as many neighbours as a leak has."""
        marks = np.zeros(len(at) + 1, np.int64)
        for least, span in self.dense:
            if len(at) >= least:
                first = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < span)
                np.add.at(marks, first, 1)
                np.add.at(marks, first + least, -1)
        keep = np.cumsum(marks[:-1]) > 0
        return at[keep], number[keep]

    def regions(self, form: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, window and first diagonal of the bands with as many shared q-grams as the budget asks for."""
        if not len(self.codes):
            return (np.zeros(0, np.int64),) * 3
        at, number = self.hits(grams(form))
        count = self.first[number + 1] - self.first[number]
        found = []
        bound = np.cumsum(count)
        begin = 0
        while begin < len(at):
            # Whole texts at a time, so that no band is counted in two parts.
            stop = int(np.searchsorted(bound, (bound[begin - 1] if begin else 0) + HITS, side="right"))
            stop = max(stop, begin + 1)
            if stop < len(at):
                text_end = ends[np.searchsorted(ends, at[stop - 1], side="right")]
                stop = int(np.searchsorted(at, text_end))
            found.append(self._bands(at[begin:stop], number[begin:stop], count[begin:stop], len(form), ends))
            begin = stop
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3

    def _bands(self, at, number, count, length, ends) -> tuple[np.ndarray, ...]:
        place = np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(self.first[number], count) + np.arange(int(count.sum())) - place
        where = np.repeat(at, count)
        window = self.window[entry]
        diagonal = where - self.place[entry] + WINDOW  # from 0 on
        text = np.searchsorted(ends, where, side="right")
        band, rest = diagonal // ADVANCE, diagonal % ADVANCE
        again = (rest < self.budget[window]) & (band > 0)
        n_bands = (length + WINDOW) // ADVANCE + 2
        key = (window.astype(np.int64) * len(ends) + text) * n_bands
        key = np.concatenate((key + band, key[again] + band[again] - 1))
        keys, shared = np.unique(key, return_counts=True)
        window, text, band = keys // n_bands // len(ends), keys // n_bands % len(ends), keys % n_bands
        enough = shared >= self.least[window]
        return text[enough], window[enough], band[enough] * ADVANCE - WINDOW

    def align(self, form, begins, ends, text, window, diagonal) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each window within its band of its text, and where that alignment ends.

        A free start, then all windows advance together: a cell (letter of the window, diagonal)
        comes from the same diagonal, from the next with a letter left out, or from the one
        before with a letter too many.
        """
        edge = self.widest
        width = ADVANCE + 3 * edge + 1
        low = diagonal - edge
        cells = np.arange(width)
        cost = np.zeros((len(text), width), np.int32)
        best = np.full(len(text), np.iinfo(np.int32).max, np.int64)
        stop = np.zeros(len(text), np.int64)
        sizes = self.sizes[window]
        for j in range(int(sizes.max(initial=0)) + 1):
            done = sizes == j
            if done.any():
                end = cost[done].argmin(axis=1)
                best[done] = cost[done][np.arange(len(end)), end]
                stop[done] = low[done] + end + j
            if j == sizes.max(initial=0):
                break
            where = low[:, None] + cells + j
            inside = (where >= begins[text][:, None]) & (where < ends[text][:, None])
            letter = np.where(inside, form[np.clip(where, 0, len(form) - 1)], 0)
            step = cost + (letter != self.letters[window, j][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = (np.minimum.accumulate(step - cells, axis=1) + cells).astype(np.int32)
        return best, stop

    def search(self, block: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each lowered text its leaks: item, begin and end in characters of the text, and edits."""
        found: list[dict] = [{} for _ in block]
        data = np.frombuffer(b"\0".join(b.replace(b"\0", b" ") for b in block) + b"\0", np.uint8)
        form, origin = normal(data)
        ends = np.flatnonzero(form == 0)
        begins = np.concatenate(([0], ends[:-1] + 1))
        text, window, diagonal = self.regions(form, ends)
        starts = np.cumsum([0] + [len(b) + 1 for b in block])
        for part in range(0, len(text), REGIONS):
            rows = slice(part, part + REGIONS)
            edits, stop = self.align(form, begins, ends, text[rows], window[rows], diagonal[rows])
            for i in np.flatnonzero(edits <= self.budget[window[rows]]):
                t, w = int(text[rows][i]), int(window[rows][i])
                end = int(np.clip(stop[i], begins[t] + 1, ends[t]))
                begin = int(np.clip(stop[i] - self.sizes[w], begins[t], end - 1))
                span = [int(origin[begin]), int(origin[end - 1]) + 1]
                chars = [int(np.count_nonzero((data[starts[t] : o] & 0xC0) != 0x80)) for o in span]
                have = found[t].get(self.owner[w])
                chars.append(int(edits[i]))
                found[t][self.owner[w]] = chars if have is None else [
                    min(have[0], chars[0]), max(have[1], chars[1]), min(have[2], chars[2])]
        for item, letters in self.tiny:
            for t, (first, last) in enumerate(zip(begins, ends)):
                own = form[first:last].tobytes()
                at = own.find(letters)
                if at >= 0:
                    begin, end = first + at, first + own.rfind(letters) + len(letters)
                    span = [int(origin[begin]), int(origin[end - 1]) + 1]
                    found[t][item] = [int(np.count_nonzero((data[starts[t] : o] & 0xC0) != 0x80)) for o in span] + [0]
        return [[(item, *where) for item, where in sorted(f.items())] for f in found]


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, edits: float = EDITS, name: str = "leaks",
) -> DataFrame:
    """``docs`` plus ``leaks``: an array of (item, begin, end, edits), empty for a clean text.

    A text leaks an item when one of the item's windows occurs in it with at most ``edits`` of
    its bytes changed, left out or added; case, punctuation and runs of white space make no
    difference. No occurrence of a window is missed: within the budget a window keeps a known
    number of q-grams on neighbouring diagonals. Windows have ``WINDOW`` bytes and begin every
    ``STEP``, so an unchanged excerpt of ``WINDOW + STEP - 1`` = 109 bytes (without what makes no
    difference) is always found, a shorter one only if it is within the edits of a window;
    items shorter than a window are searched whole, those of fewer bytes than a q-gram without
    edits. ``begin`` and ``end`` are characters of the text, exact but for the edits. Null and
    empty texts, and items without a letter or digit, leak nothing; repeated items are reported
    each. Other columns pass unchanged.

    Documents are only mapped. Items go to the tasks in blocks of bounded size, one pass each.
    """
    passages = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    total = passages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // BLOCK_CHARS))
    kind = dict(passages.dtypes)["item"]
    shape = f"array<struct<item: {kind}, begin: int, end: int, edits: int>>"
    columns = []
    for part in range(parts):
        rows = passages.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        sent = docs.sparkSession.sparkContext.broadcast(([r["item"] for r in rows], [r["text"] for r in rows]))
        columns.append(_search(sent, shape, window, edits)(F.col(text)))
    return docs.withColumn(name, F.concat(*columns))


def _search(sent, shape: str, window: int, edits: float):
    @F.pandas_udf(shape)
    def searched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, texts = sent.value
        index = Index(list(enumerate(texts)), window, edits)
        for series in batches:
            yield pd.Series([
                [{"item": names[i], "begin": b, "end": e, "edits": d} for i, b, e, d in own]
                for block in words.blocks([lowered(t) for t in series]) for own in index.search(block)], dtype=object)

    return searched
