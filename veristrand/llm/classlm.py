"""Brown class-based bigrams: exchange clustering, smoothed transitions and emissions, log10 scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import concluded, staged

#: The end of a text, a token of its own; no word can hold white space.
END = b"\n"
#: So many of the most frequent words, with their counts and classes, go to every task; those of all others are joined.
TOLD_WORDS = 1 << 17
#: Places for told words and the end among the units that every task knows.
OWN_UNITS = TOLD_WORDS + 1
#: Hash values of word endings; with three kinds of closing marks they make the shapes of words unseen in training.
ENDINGS = 96
UNITS = OWN_UNITS + 3 * ENDINGS
CLASSES = 64
ROUNDS = 10
#: So many of the most frequent words are dealt to classes by rank at first, all others by number.
DEALT = 64 * (CLASSES - 1)
#: Weight of a class's own share among the successors of another class.
PRIOR = 20.0
#: Tokens that a task holds before it hands their pairs on, pairs that it holds for other parts, and texts cut at a time.
HELD_TOKENS, HELD_PAIRS, HELD_TEXTS = 3_000_000, 2_000_000, 1000
#: Words are dealt into so many parts by the upper bits of their codes.
PART_BITS = 10
PARTS = 1 << PART_BITS
#: A chain's mark for a word that is not told.
OPEN = 255
#: Rows between the steps of ``word_contexts``: packed arrays of one part.
PACKED = "part int, kind int, codes binary, spans binary, others binary, times binary, words binary"
CONTEXTS = ("part int, words binary, sizes binary, before_spans binary, before binary, before_times binary, "
            "after_spans binary, after binary, after_times binary")


def shape(word: bytes) -> int:
    """The unit of a word unseen in training: its last letters and its closing mark."""
    stem = word.rstrip(b".,;:!?\"')")
    mark = 0 if len(stem) == len(word) else 1 if word.endswith(b".") else 2
    return OWN_UNITS + mark * ENDINGS + zlib.crc32(stem[-2:]) % ENDINGS


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``tokens`` of all texts, without the ends, and how many each text has."""
    # Taken, not sliced: Arrow splits texts that begin inside their buffers at the wrong places.
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    # White space at either end of a text leaves an empty word there.
    there = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    return words.filter(there).cast(pa.large_binary()), np.diff(before[ends])


def _numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as places among the distinct ones."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _codes(words: list[bytes]) -> np.ndarray:
    """64 bits of each word; they depend on the word alone, so tasks agree."""
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def _packed(part: int, kind: int, codes=b"", spans=b"", others=b"", times=b"", words=b"") -> tuple:
    return (int(part), kind, *[x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in (codes, spans, others, times)], words)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.binary()) for c in ddl.split(", ")])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows that come sorted by part, part by part."""
    part, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != part:
                yield part, held
                held = []
            part = row["part"]
            held.append(row)
    if held:
        yield part, held


def _joined(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts, lengths = _runs(parts)
    for a, n in zip(starts.tolist(), lengths.tolist()):
        yield parts[a], slice(a, a + n)


def _cut(held: list[pa.Array], counts: np.ndarray) -> list[tuple]:
    """The distinct pairs of some texts, given as words and their number in each text, dealt by the part of the second word."""
    places, names = _numbered(pa.concat_arrays(held))
    names = [*names.to_pylist(), END]
    codes = _codes(names)
    order = np.argsort(codes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = codes[order]
    # The end of a text leads the next one.
    line = np.full(len(places) + len(counts) + 1, rank[-1])
    line[np.arange(1, len(places) + 1) + np.repeat(np.arange(len(counts)), counts)] = rank[places]
    pairs, times = np.unique(line[1:] << 32 | line[:-1], return_counts=True)
    second, first = pairs >> 32, pairs & 0xFFFFFFFF
    rows = []
    for part, own in _by_part((codes[second] >> np.uint64(64 - PART_BITS)).astype(np.int64)):
        starts, spans = _runs(second[own])
        seen = second[own][starts]
        rows.append(_packed(
            part, 1, codes[seen], spans.astype(np.uint32), codes[first[own]], times[own].astype(np.uint32),
            b" ".join([names[i] for i in order[seen]])))
    return rows


def word_contexts(texts: DataFrame) -> DataFrame:
    """A stored table of all words and of how often each word stands before and after each: one row per part.

    Words are dealt into parts by their codes. In a part they are sorted by code, and word ``j`` of part ``p`` has
    the number ``j * PARTS + p``. ``words`` (blank between) and ``sizes`` (long) are aligned;
    ``before`` holds the numbers of the words that stand before each word, ``before_spans`` how many these are
    per word, ``before_times`` how often; ``after`` likewise. Pairs travel as packed arrays: to the second word's part,
    where they are summed and that word gets its number, to the first word's part, and back.
    """
    schema, final = _schema(PACKED), _schema(CONTEXTS)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, total = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, HELD_TEXTS):
                words, number = _split(batch.column(0).slice(at, HELD_TEXTS))
                held.append(words)
                counts.append(number)
                total += len(words) + len(number)
                if total >= HELD_TOKENS:
                    yield _batch(_cut(held, np.concatenate(counts)), schema)
                    held, counts, total = [], [], 0
        if held:
            yield _batch(_cut(held, np.concatenate(counts)), schema)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a second word are summed, it is numbered; pairs go on to the first word's part."""
        def sent():
            code, number, n = (np.concatenate(x) for x in zip(*out))
            order = np.argsort(code, kind="stable")
            code, number, n = code[order], number[order], n[order]
            for part, own in _by_part((code >> np.uint64(64 - PART_BITS)).astype(np.int64)):
                starts, spans = _runs(code[own])
                yield _packed(part, 1, code[own][starts], spans.astype(np.uint32), number[own], n[own])

        out, total = [], 0
        for part, rows in _groups(batches):
            seen, spans = _joined(rows, "codes", np.uint64), _joined(rows, "spans", np.uint32)
            codes, at, place = np.unique(seen, return_index=True, return_inverse=True)
            names = b" ".join(r["words"] for r in rows).split(b" ")
            second, first, n = np.repeat(place, spans), _joined(rows, "others", np.uint64), _joined(rows, "times", np.uint32)
            order = np.lexsort((first, second))
            second, first, n = second[order], first[order], n[order].astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (second[1:] != second[:-1]) | (first[1:] != first[:-1]))))
            second, first, n = second[starts], first[starts], np.add.reduceat(n, starts)
            sizes = np.bincount(second, n, len(codes)).astype(np.int64)
            yield _batch([_packed(part, 0, codes, b"", b"", sizes, b" ".join([names[i] for i in at]))], schema)
            out.append((first, (second * PARTS + part).astype(np.uint32), n.astype(np.uint32)))
            total += len(n)
            if total >= HELD_PAIRS:
                yield _batch(list(sent()), schema)
                out, total = [], 0
        if total:
            yield _batch(list(sent()), schema)

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First words are numbered too, and what follows each is settled; pairs go back to the second word's part."""
        def sent():
            number, other, n = (np.concatenate(x) for x in zip(*out))
            key = (number % PARTS).astype(np.int64) << 32 | number // PARTS
            order = np.argsort(key, kind="stable")
            key, other, n = key[order], other[order], n[order]
            for part, own in _by_part(key >> 32):
                starts, spans = _runs(key[own])
                yield _packed(part, 3, (key[own][starts] & 0xFFFFFFFF).astype(np.uint64), spans.astype(np.uint32), other[own], n[own])

        out, total = [], 0
        for part, rows in _groups(batches):
            (own,), rows = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]
            codes = np.frombuffer(own["codes"], np.uint64)
            place = np.repeat(np.searchsorted(codes, _joined(rows, "codes", np.uint64)), _joined(rows, "spans", np.uint32))
            other, n = _joined(rows, "others", np.uint32), _joined(rows, "times", np.uint32)
            order = np.argsort(place, kind="stable")
            place, other, n = place[order], other[order], n[order]
            spans = np.bincount(place, minlength=len(codes)).astype(np.uint32)
            yield _batch([_packed(part, 0, b"", b"", b"", own["times"], own["words"]), _packed(part, 2, b"", spans, other, n)], schema)
            out.append((other, (place * PARTS + part).astype(np.uint32), n))
            total += len(n)
            if total >= HELD_PAIRS:
                yield _batch(list(sent()), schema)
                out, total = [], 0
        if total:
            yield _batch(list(sent()), schema)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches):
            (own,), (after,) = [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 2]
            rows = [r for r in rows if r["kind"] == 3]
            place = np.repeat(_joined(rows, "codes", np.uint64).astype(np.int64), _joined(rows, "spans", np.uint32))
            order = np.argsort(place, kind="stable")
            spans = np.bincount(place, minlength=len(own["times"]) // 8).astype(np.uint32)
            yield _batch([(
                part, own["words"], own["times"], spans.tobytes(), _joined(rows, "others", np.uint32)[order].tobytes(),
                _joined(rows, "times", np.uint32)[order].tobytes(), after["spans"], after["others"], after["times"])], final)

    def steps() -> DataFrame:
        dealt = lambda rows: rows.repartition("part").sortWithinPartitions("part")
        found = staged(dealt(texts.select("text").mapInArrow(paired, PACKED)).mapInArrow(numbered, PACKED))
        found = staged(dealt(found).mapInArrow(followed, PACKED))
        return dealt(found).mapInArrow(settled, CONTEXTS)

    return concluded(texts.sparkSession, steps)


def word_counts(contexts: DataFrame) -> DataFrame:
    """``word`` (bytes), ``n`` and the word's ``number`` of all words, stored."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["words"].split(b" ")
                yield pa.RecordBatch.from_arrays([
                    pa.array(words, pa.binary()), pa.array(np.frombuffer(row["sizes"], np.int64)),
                    pa.array(np.arange(len(words)) * PARTS + row["part"])], names=["word", "n", "number"])

    return staged(contexts.select("part", "words", "sizes").mapInArrow(listed, "word binary, n long, number long"))


def follows(contexts: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each; ``[c, d]`` is d after c. ``classes`` are by word number."""
    sent = contexts.sparkSession.sparkContext.broadcast(classes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            for row in batch.to_pylist():
                spans = np.frombuffer(row["before_spans"], np.uint32)
                own = sent.value[np.arange(len(spans)) * PARTS + row["part"]].astype(np.int64)
                cell = sent.value[np.frombuffer(row["before"], np.uint32)].astype(np.int64) * CLASSES + np.repeat(own, spans)
                found += np.bincount(cell, np.frombuffer(row["before_times"], np.uint32), CLASSES * CLASSES).reshape(found.shape)
        cell = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(found.ravel()[cell])], names=["cell", "n"])

    rows = contexts.select("part", "before_spans", "before", "before_times").mapInArrow(summed, "cell long, n double")
    found = np.zeros(CLASSES * CLASSES)
    for cell, n in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        found[cell] = n
    return found.reshape(CLASSES, CLASSES)


def _moved(contexts: DataFrame, classes: np.ndarray, between: np.ndarray, turn: int) -> np.ndarray:
    """Classes after the words whose turn it is moved to the class under which their contexts are most likely."""
    first, second = between.sum(axis=1), between.sum(axis=0)
    step = np.log(between + 0.05) - np.log(first + 0.05 * CLASSES)[:, None]
    # What a class before a word says for each class of the word, and a class after it.
    gains = np.concatenate((step - np.log(second + 1.0)[None, :], step.T))
    # The end of a text keeps its class, which no word enters.
    gains[:, 0] = -1e9
    once = (gains[:CLASSES, None, :] + gains[None, CLASSES:, :]).argmax(axis=2).astype(np.uint8)
    sent = contexts.sparkSession.sparkContext.broadcast((classes, gains, once))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, gains, once = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                spans = [np.frombuffer(row[f"{side}_spans"], np.uint32) for side in ("before", "after")]
                others = [classes[np.frombuffer(row[side], np.uint32)] for side in ("before", "after")]
                times = [np.frombuffer(row[f"{side}_times"], np.uint32) for side in ("before", "after")]
                starts = [np.cumsum(s, dtype=np.int64) - s for s in spans]
                old = classes[np.arange(len(spans[0])) * PARTS + row["part"]]
                # A word that occurs once has one class on either side; all others have sums.
                single = (spans[0] == 1) & (times[0][starts[0]] == 1)
                new = once[others[0][starts[0]], others[1][starts[1]]]
                place = np.cumsum(~single) - 1
                sums = np.zeros((int((~single).sum()), 2 * CLASSES))
                for side in (0, 1):
                    more = np.repeat(~single, spans[side])
                    cell = np.repeat(place * CLASSES, np.where(single, 0, spans[side])) + others[side][more]
                    sums[:, side * CLASSES : (side + 1) * CLASSES] = np.bincount(
                        cell, times[side][more], len(sums) * CLASSES).reshape(-1, CLASSES)
                new[~single] = (sums @ gains).argmax(axis=1)
                new[old == 0] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]], pa.int32()), pa.array([new.tobytes()], pa.binary())], names=["part", "classes"])

    found = classes.copy()
    whose = F.lit(True) if turn <= 1 else F.col("part") % 2 == turn % 2
    rows = contexts.drop("words", "sizes").filter(whose).mapInArrow(moved, "part int, classes binary")
    for part, own in rows.toPandas().itertuples(index=False):
        own = np.frombuffer(own, np.uint8)
        found[np.arange(len(own)) * PARTS + part] = own
    return found


def exchange(contexts: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words by number, and how often each class follows each.

    From the given classes, each round lets half of the words (all in the first two, then by turns of their parts) move to the
    class under which their own contexts are most likely, the classes of the others staying; contexts are counted anew by Spark.
    The end of a text keeps class 0, its own. The best round by class likelihood is returned.
    """
    best = (-np.inf, classes, np.zeros((CLASSES, CLASSES)))
    for turn in range(rounds + 1):
        between = follows(contexts, classes)
        likely = _xlogx(between) - _xlogx(between.sum(axis=1)) - _xlogx(between.sum(axis=0))
        if likely > best[0]:
            best = (likely, classes, between)
        if turn < rounds:
            classes = _moved(contexts, classes, between, turn)
    return best[1], best[2]


def _xlogx(values: np.ndarray) -> float:
    positive = values[values > 0]
    return float((positive * np.log(positive)).sum())


@dataclass
class ClassModel:
    """Everything scoring needs but the counts and classes of the less frequent words, which stay a table."""

    own: list[bytes]
    told: dict[bytes, int]
    counts: DataFrame
    train_tokens: int
    train_types: int
    #: log10 probability of each class after each, by class.
    step: np.ndarray = field(repr=False)
    #: By unit, which is a word's place in ``own`` or the shape of an unseen one.
    classes: np.ndarray = field(repr=False)
    #: By unit: log10 of its probability in its class; no unit of an unused place has any.
    emission: np.ndarray = field(repr=False)
    #: By class: log10 of the smoothed count of all its words.
    mass: np.ndarray = field(repr=False)


def train(texts: DataFrame) -> ClassModel:
    """Learns from the ``text`` column of all rows; an empty table gives a model of the end alone.

    Every word of the texts has a class by its contexts, however rare it is. A word unseen has the
    class that most of the words of its shape have.
    """
    result = {}

    def learnt() -> DataFrame:
        contexts = word_contexts(texts)
        counts = word_counts(contexts)
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("number"), F.lit(0))).first()
        most = max(TOLD_WORDS, DEALT)
        # Only words as frequent as the last that can be told are sorted, or every task would hand that many to the driver.
        often, words = np.array(sorted(counts.groupBy("n").count().collect(), reverse=True)).reshape(-1, 2).T
        least = often[np.searchsorted(np.cumsum(words), min(most + 1, words.sum()))] if len(often) else 0
        top = counts.filter((F.col("word") != END) & (F.col("n") >= int(least))).orderBy(F.desc("n"), "word").limit(most).collect()
        ended = counts.filter(F.col("word") == END).first()
        numbers = np.arange(-(-(total[2] + 1) // PARTS) * PARTS)
        first = (1 + numbers % (CLASSES - 1)).astype(np.uint8)
        for rank, row in enumerate(top[:DEALT]):
            first[row["number"]] = 1 + rank % (CLASSES - 1)
        if ended:
            first[ended["number"]] = 0
        seen, between = exchange(contexts, first)
        types, shapes = _class_types(counts, seen)
        result.update(total=total, top=top, ended=ended, seen=seen, between=between, types=types, shapes=shapes)
        return _classed(counts, seen)

    # The contexts go once the classes are written.
    counts = concluded(texts.sparkSession, learnt)
    total, top, ended, seen, between, types, shapes = result.values()
    top = top[:TOLD_WORDS]
    told = {bytes(r["word"]): r["n"] for r in top} | {END: ended["n"] if ended else 0}
    own = [END, *[bytes(r["word"]) for r in top]]
    types[0] += not ended  # the end has a place even if it was never seen
    classes = np.zeros(UNITS, np.int64)
    classes[1 : len(own)] = seen[[r["number"] for r in top]] if top else 0
    classes[OWN_UNITS:] = shapes
    sizes = between.sum(axis=0)
    share = (sizes + 1) / (sizes.sum() + CLASSES)
    step = np.log10((between + PRIOR * share[None, :]) / (between.sum(axis=1) + PRIOR)[:, None])
    # Each word seen and each shape of unseen words has one place more than it was counted.
    mass = np.log10(np.maximum(sizes + types + np.bincount(shapes, minlength=CLASSES), 1))
    emission = np.full(UNITS, -np.inf)
    emission[: len(own)] = np.log10(np.array([told[w] for w in own]) + 1) - mass[classes[: len(own)]]
    emission[OWN_UNITS:] = -mass[shapes]
    return ClassModel(own, told, counts, int(total[0]), int(total[1]), step, classes, emission, mass)


def _classed(counts: DataFrame, seen: np.ndarray) -> DataFrame:
    """``word``, ``n`` and ``class`` of all words."""
    sent = counts.sparkSession.sparkContext.broadcast(seen)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = sent.value[batch.column(2).to_numpy()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of)], names=["word", "n", "class"])

    return counts.select("word", "n", "number").mapInArrow(classed, "word binary, n long, class int")


def _class_types(counts: DataFrame, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each class, and the class that most words of each shape have."""
    sent = counts.sparkSession.sparkContext.broadcast(seen)

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((UNITS - OWN_UNITS + 1) * CLASSES, np.int64)
        for batch in batches:
            # The end has no shape: its class is no other word's.
            of = [UNITS - OWN_UNITS if w == END else shape(w) - OWN_UNITS for w in batch.column(0).to_pylist()]
            found += np.bincount(np.array(of) * CLASSES + sent.value[batch.column(1).to_numpy()], minlength=len(found))
        cell = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(found[cell])], names=["cell", "n"])

    found = np.zeros((UNITS - OWN_UNITS + 1) * CLASSES)
    rows = counts.select("word", "number").mapInArrow(shaped, "cell long, n long")
    for cell, n in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        found[cell] = n
    found = found.reshape(-1, CLASSES)
    usual = 1 + found[:-1, 1:].sum(axis=0).argmax()
    return found.sum(axis=0), np.where(found[:-1].any(axis=1), found[:-1].argmax(axis=1), usual)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """The pieces of some bytes that end at the given places."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class _Told(dict):
    """Place of a told word; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def score(docs: DataFrame, model: ClassModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus n_tokens, n_known, base_score, score (log10) and perplexity of each whole text.

    The base counts words alone, smoothed by one. The model multiplies, for each token, the
    probabilities of its class after the last one's and of the word in its class, smoothed by one.
    A null text is empty: its end alone.
    Other columns (those of ``keep``, if given) pass unchanged; columns named like a result are replaced.

    Told words have their classes at once. Of all others each text's distinct words are joined
    with their counts and classes; then these fill the chain of the text's classes.
    """
    results = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    floor = float(np.log10(model.train_tokens + model.train_types + 1))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((model.own, np.array([model.told[w] for w in model.own]), model.classes))
    known = context.broadcast((model.step, model.mass))

    def chained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, told, classes = sent.value
        find = _Told(zip(own, range(len(own)))).__getitem__
        # One entry more, which -1 finds.
        chain_of = np.append(classes[: len(own)], OPEN).astype(np.uint8)
        gain_of = np.append(np.log10(told + 1.0), 0.0)
        for batch in batches:
            made = [cut(batch.slice(at, HELD_TEXTS), find, told[0], classes, chain_of, gain_of)
                    for at in range(0, len(batch), HELD_TEXTS)]
            yield pa.concat_arrays(made) if made else pa.array([], chain_type)

    def cut(texts: pa.Array, find, ended: int, classes: np.ndarray, chain_of: np.ndarray, gain_of: np.ndarray) -> pa.Array:
        words, counts = _split(texts)
        places, names = _numbered(words)
        listed = names.to_pylist()
        found = np.fromiter(map(find, listed), np.int64, len(listed))
        of, doc = found[places], np.repeat(np.arange(len(counts)), counts)
        chain = np.zeros(len(of) + len(counts), np.uint8)
        chain[np.arange(len(of)) + doc] = chain_of[of]
        told = np.bincount(doc, gain_of[of], len(counts)) + gain_of[0]
        # The distinct words of each text that are not told, and where each stands in it.
        rare = np.flatnonzero(of < 0)
        pairs, slots, times = np.unique(doc[rare] << 32 | places[rare], return_inverse=True, return_counts=True)
        holds, word = pairs >> 32, pairs & 0xFFFFFFFF
        begins = np.searchsorted(holds, np.arange(len(counts) + 1))
        open_ = np.bincount(doc[rare], minlength=len(counts))
        shapes = np.zeros(len(listed), np.uint8)
        shapes[found < 0] = [classes[shape(listed[i])] for i in np.flatnonzero(found < 0)]
        known = counts + 1 - open_ - (ended == 0)
        lists = pa.array(begins.astype(np.int32))
        return pa.StructArray.from_arrays([
            pa.array(counts + 1), pa.array(known), pa.array(told), _binary(np.cumsum(counts + 1), chain),
            pa.ListArray.from_arrays(lists, names.take(pa.array(word)).cast(pa.binary())),
            pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
            _binary(np.cumsum(open_) * 4, (slots - begins[doc[rare]]).astype(np.int32)), _binary(begins[1:], shapes[word])],
            fields=list(chain_type))

    chained = F.arrow_udf(chained, "tokens long, known long, told double, chain binary, words array<binary>, times array<int>, "
                          "slots binary, shapes binary")
    chain_type = pa.struct([
        ("tokens", pa.int64()), ("known", pa.int64()), ("told", pa.float64()), ("chain", pa.binary()),
        ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("slots", pa.binary()), ("shapes", pa.binary())])

    @F.pandas_udf("double")
    def walked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        step, mass = known.value
        for chains, slots, shapes, places, seen in batches:
            lines = np.zeros(len(chains))
            for i, (chain, slot, classes, at, own) in enumerate(zip(chains, slots, shapes, places, seen)):
                chain = np.frombuffer(chain, np.uint8)
                if slot:
                    classes, chain = np.frombuffer(classes, np.uint8).copy(), chain.copy()
                    if at is not None and len(at):
                        classes[np.asarray(at, np.int64)] = np.asarray(own, np.int64)
                    chain[chain == OPEN] = classes[np.frombuffer(slot, np.int32)]
                # The last class is the end's, 0, as is the one before the first.
                lines[i] = step[np.append(chain[-1:], chain[:-1]), chain].sum() - mass[chain].sum()
            yield pd.Series(lines)

    first = staged(
        docs.select(*kept, chained(F.col(text)).alias("_llm_scored")).withColumn("_llm_row", F.monotonically_increasing_id()))
    part = F.col("_llm_scored")
    rare = first.select("_llm_row", F.posexplode(F.arrays_zip(part["words"].alias("word"), part["times"].alias("times"))).alias("at", "r"))
    added = staged(rare.select("_llm_row", "at", F.col("r.word").alias("word"), F.col("r.times").alias("times")).join(
        model.counts.filter(F.col("word") != END), "word").groupBy("_llm_row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_llm_gain"), F.sum("times").alias("_llm_met"),
        F.collect_list(F.struct("at", "class")).alias("_llm_found")))
    whole = first.join(added, "_llm_row", "left").na.fill(0, ["_llm_gain", "_llm_met"])
    found = F.col("_llm_found")
    line = walked(part["chain"], part["slots"], part["shapes"], found["at"], found["class"])
    valued = whole.select(*kept, part["tokens"].alias("_llm_tokens"), part["known"].alias("_llm_known"),
                          (part["told"] + F.col("_llm_gain")).alias("_llm_gained"), "_llm_met", line.alias("_llm_line"))
    count, value = F.col("_llm_tokens"), F.col("_llm_line") + F.col("_llm_gained")
    return valued.select(
        *kept, count.alias("n_tokens"), (F.col("_llm_known") + F.col("_llm_met")).alias("n_known"),
        (F.col("_llm_gained") - count * floor).alias("base_score"), value.alias("score"),
        F.pow(F.lit(10.0), -value / count).alias("perplexity"))


def in_training(key: Column, folds: int = 7, held: int = 2) -> Column:
    """Whether a row is learnt from: its key's checksum leaves another remainder than the held-out one."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds != held
