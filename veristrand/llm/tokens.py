"""Whole texts to BPE tokens and back, and token counts without moving a pre-token."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary

#: Most words a worker remembers, as pieces or as lengths alone, which need less room; beyond it the
#: memory is emptied, results stay the same.
CACHED_WORDS, CACHED_LENGTHS = 300_000, 700_000
#: Most words that a task counts at a time for the table of the frequent.
COUNTED_WORDS = 200_000
#: Words longer than this are encoded each time, so the memory has a bound in bytes too.
CACHED_LETTERS = 64
_encoders: dict[str, Encoder] = {}
_caches: dict[str, dict] = {}
_lengths: dict[str, _Lengths] = {}


def _encoder(path: str, vocabulary) -> Encoder:
    """One encoder and one cache per worker process and vocabulary; workers outlive their tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(vocabulary.value)
    return _encoders[path]


def _remembered(key: str, kind: type) -> dict:
    cache = _caches.setdefault(key, kind())
    if len(cache) > CACHED_WORDS:
        cache.clear()
    return cache


def encode(docs: DataFrame, path: str, text: str = "text", *, ids: str = "ids", batch: int = 256) -> DataFrame:
    """``docs`` plus ``ids`` (array of token ids, special strings inside texts included).

    A null or empty text has no tokens. A column already called like the result is replaced;
    all others, whatever their names, pass unchanged. Rows never leave their partition.
    """
    return _mapped(docs, path, text, batch, "ids_only", {ids: "array<int>"})


def digests(docs: DataFrame, path: str, text: str = "text", *, batch: int = 256) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each encoded and decoded text.

    The digest of ids is over their decimal forms joined by one space, that of the decoded
    text over its UTF-8 bytes; both of nothing for a null or empty text.
    """
    return _mapped(docs, path, text, batch, "digests", {
        "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def _mapped(docs: DataFrame, path: str, text: str, batch: int, form: str, added: dict[str, str]) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("struct<" + ", ".join(f"{n}: {t}" for n, t in added.items()) + ">")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, vocabulary)
        shape = _digest if form == "digests" else _ids
        for series in batches:
            texts = series.tolist()
            # Few texts at a time: a batch of very long ones must not hold all their words at once.
            rows = [row for at in range(0, len(texts), batch) for row in _encoded(encoder, path, texts[at : at + batch], shape)]
            yield pd.DataFrame(rows, columns=list(added))

    # The function runs once per row: fields of its struct are read from a stored column.
    found = docs.withColumn("_llm_encoded", encoded(F.col(text)))
    return found.withColumns({n: F.col(f"_llm_encoded.{n}") for n in added}).drop("_llm_encoded")


class _Runs(dict):
    """Pieces by run; asked for a run it has not, it notes that and gives nothing."""

    def __init__(self):
        super().__init__()
        self.unknown: set[str] = set()

    def __missing__(self, run: str) -> None:
        self.unknown.add(run)


def _encoded(encoder: Encoder, path: str, texts: list, shape) -> list[tuple]:
    """Speculate, verify and merge for the words not met before, then assemble each text.

    White space separates words and is dropped, so a run between spaces has its own tokens
    whatever stands around it, and is remembered as a whole.
    """
    runs, words = _remembered(path, _Runs), _remembered(f"{path} words", dict)
    special, split = encoder.vocabulary.special, []
    for text in texts:
        for piece in encoder.pieces(text or ""):
            own = piece in special
            names = [piece] if own else encoder.runs(piece)
            split.append((False, names, [_piece(encoder, (special[piece],))] if own else list(map(runs.__getitem__, names))))
        split.append((True, None, None))
    unknown = {r: encoder.words(r) for r in runs.unknown}
    runs.unknown.clear()
    fresh = list({w for ws in unknown.values() for w in ws if w not in words})
    found = dict(zip(fresh, (_piece(encoder, t) for t in encoder.encode_words(fresh)[0]))) if fresh else {}
    built = {r: _joined([words[w] if w in words else found[w] for w in ws]) for r, ws in unknown.items() if ws}
    words.update((w, p) for w, p in found.items() if len(w) <= CACHED_LETTERS)
    rows, parts = [], []
    for ended, names, pieces in split:
        if ended:
            rows.append(shape(parts))
            parts = []
        elif None in pieces:  # runs of white space alone are in no table and add nothing
            parts += [p or built[n] for n, p in zip(names, pieces) if p or n in built]
        else:
            parts += pieces
    runs.update((r, p) for r, p in built.items() if len(r) <= CACHED_LETTERS)
    return rows


def _joined(parts: list[tuple[str, str]]) -> tuple[str, str]:
    return parts[0] if len(parts) == 1 else (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))


def _piece(encoder: Encoder, tokens: tuple[int, ...]) -> tuple[str, str]:
    return " ".join(map(str, tokens)), encoder.decode(tokens)


def _digest(parts: list[tuple[str, str]]) -> tuple[int, str, str]:
    ids, decoded = map(" ".join, zip(*parts)) if parts else ("", "")
    return (
        ids.count(" ") + 1 if ids else 0,
        hashlib.sha256(ids.encode()).hexdigest(),
        hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def _ids(parts: list[tuple[str, str]]) -> tuple[list[int]]:
    return (np.fromstring(" ".join([p[0] for p in parts]), np.int32, sep=" "),)


def decode(frame: DataFrame, path: str, ids: str = "ids", *, text: str = "decoded") -> DataFrame:
    """``frame`` plus the text of each array of ids; unknown ids and nulls add nothing."""
    vocabulary = frame.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path, vocabulary)
        for series in batches:
            yield pd.Series([encoder.decode(x if x is not None else ()) for x in series], dtype=object)

    return frame.withColumn(text, decoded(F.col(ids)))


def frequent_lengths(
    docs: DataFrame, path: str, text: str = "text", *, entries: int = 32_768, per_task: int = 4_096,
) -> dict[str, int]:
    """Token counts of the most frequent space-led words of all texts, at most ``entries``.

    Each task counts its own words in bounded memory (the rarer half goes whenever
    there are too many) and hands on one summary of at most ``per_task`` rows; only the
    summaries meet, so no pre-token of a text is shuffled. The table only saves time: a
    word that is missing here gets its length from its worker's cache.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        special = _encoder(path, vocabulary).special
        counts: Counter[str] = Counter()
        for frame in batches:
            for value in frame["text"]:
                counts.update((special.sub(" ", value) if special else value).split(" ") if value else ())
                if len(counts) > COUNTED_WORDS:
                    counts = Counter(dict(counts.most_common(COUNTED_WORDS // 2)))
        top = [(w, n) for w, n in counts.most_common(per_task) if len(w) <= CACHED_LETTERS]
        if top:
            yield pd.DataFrame({"word": [w for w, _ in top], "n": [n for _, n in top]})

    words = [r["word"] for r in (
        docs.select(F.col(text).alias("text")).mapInPandas(summaries, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries).collect())]
    lengths = _Lengths(Encoder(vocabulary.value), {})
    return {w: lengths[w] for w in words}


class _Lengths(dict):
    """Lengths of a space and what follows up to the next one: the frequent always, others while there is room.

    A space before another character begins a pre-token, so such a run is whole pre-tokens,
    whatever stands around it.
    """

    def __init__(self, encoder: Encoder, frequent: dict[str, int]):
        super().__init__(frequent)
        self.encoder, self.frequent = encoder, frequent
        self.own: dict[str, int] = {}

    def __missing__(self, run: str) -> int:
        length = sum(map(self._length, self.encoder.words(" " + run)))
        if len(run) <= CACHED_LETTERS and "\n" not in run:
            if len(self) > CACHED_LENGTHS + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[run] = length
        return length

    def _length(self, word: str) -> int:
        length = self.own.get(word)
        if length is None:
            length = len(self.encoder.merge(word))
            if len(word) <= CACHED_LETTERS:
                if len(self.own) > CACHED_LENGTHS:
                    self.own.clear()
                self.own[word] = length
        return length

    def of(self, text: str) -> int:
        """The tokens of a text without special strings."""
        if "  " in text or text.endswith(" "):  # spaces in a row make pre-tokens of their own
            return sum(map(self._length, self.encoder.words(text)))
        first, *runs = text.split(" ")
        return sum(map(self.__getitem__, runs), sum(map(self._length, self.encoder.words(first))))


def token_counts(docs: DataFrame, path: str, text: str = "text", *, count: str = "n_tokens", **bounds: int) -> DataFrame:
    """``docs`` plus the number of tokens of each whole text; a null or empty text has none.

    ``bounds`` go to ``frequent_lengths``. No row leaves its partition and no text is cut.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text, **bounds))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path, vocabulary)
        lengths = _lengths.get(path)
        if lengths is None or lengths.frequent is not table.value:
            lengths = _lengths[path] = _Lengths(encoder, table.value)
        special = encoder.vocabulary.special
        for series in batches:
            yield pd.Series([
                sum(1 if p in special else lengths.of(p) for p in encoder.pieces(t or ""))
                for t in series], dtype="int64")

    return docs.withColumn(count, counted(F.col(text)))


def utf8_bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
