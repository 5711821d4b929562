"""Every word of the training texts has a class by its contexts, told or not; scores against a plain version."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veristrand.llm import classlm


def texts(rng, n):
    made = []
    for _ in range(n):
        side = rng.choice("ab")
        made.append(" ".join(w for _ in range(rng.randint(3, 15)) for w in (
            f"{side}det{rng.randrange(4)}", f"{side}noun{rng.randrange(40)}", f"{side}verb{rng.randrange(30)}")))
    return made


def test_every_seen_word_is_classed_by_its_contexts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(5), 120) + ["", None, "new words", "adet0 new anoun1"])]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learnt = docs.filter("doc_id < 100").select("text")
    monkeypatch.setattr(classlm, "HELD_TOKENS", 500)
    monkeypatch.setattr(classlm, "HELD_PAIRS", 50)

    contexts = classlm.word_contexts(learnt)
    words = {r["number"]: bytes(r["word"]) for r in classlm.word_counts(contexts).collect()}
    expected = Counter()
    for i, t in rows:
        if i < 100:
            line = [classlm.END, *classlm.tokens(t)]
            expected.update(zip(line, line[1:]))
    for side in ("before", "after"):
        found = Counter()
        for r in contexts.collect():
            spans = np.frombuffer(r[f"{side}_spans"], np.uint32)
            own = np.repeat(np.arange(len(spans)) * classlm.PARTS + r["part"], spans)
            for w, o, n in zip(own.tolist(), np.frombuffer(r[side], np.uint32).tolist(), np.frombuffer(r[f"{side}_times"], np.uint32).tolist()):
                found[(words[o], words[w]) if side == "before" else (words[w], words[o])] += n
        assert found == expected

    # Pairs of classes are summed from all pairs of words.
    number = {w: i for i, w in words.items()}
    classes = np.array([i * 7 % 64 for i in range(max(words) + classlm.PARTS)], np.uint8)
    plain = np.zeros((classlm.CLASSES, classlm.CLASSES))
    for (a, b), n in expected.items():
        plain[classes[number[a]], classes[number[b]]] += n
    assert np.array_equal(classlm.follows(contexts, classes), plain)

    whole = {(r["doc_id"], r["n_tokens"]): r for r in classlm.score(docs, classlm.train(learnt)).collect()}
    monkeypatch.setattr(classlm, "TOLD_WORDS", 20)
    model = classlm.train(learnt)
    counts = {bytes(r["word"]): (r["n"], r["class"]) for r in model.counts.collect()}
    assert len(model.own) == 21 < len(counts) == model.train_types
    joined = classlm.score(docs, model).collect()
    assert len(joined) == len(rows)
    for r in joined:
        assert r["score"] == pytest.approx(whole[r["doc_id"], r["n_tokens"]]["score"])
        line, before = 0.0, 0
        for w in classlm.tokens(r["text"]):
            n, c = counts.get(w, (0, None))
            c = int(model.classes[classlm.shape(w)]) if c is None else c
            line += model.step[before, c] + math.log10(n + 1) - model.mass[c]
            before = c
        assert r["score"] == pytest.approx(line)
    # In each class the words seen and the shapes of unseen words share all probability.
    total = np.zeros(classlm.CLASSES)
    for n, c in counts.values():
        total[c] += (n + 1) / 10 ** model.mass[c]
    shapes = np.bincount(model.classes[classlm.OWN_UNITS :], minlength=classlm.CLASSES)
    total += shapes / 10**model.mass
    assert np.allclose(total[total > 0], 1)
    # Words of the same shape that stand in different contexts have classes of their own.
    of = {w: c for w, (n, c) in counts.items()}
    alike = [(w, b"b" + w[1:]) for w in of if w.startswith(b"anoun") and b"b" + w[1:] in of and w not in model.told]
    assert alike and all(classlm.shape(a) == classlm.shape(b) for a, b in alike)
    assert sum(of[a] == of[b] for a, b in alike) < 0.3 * len(alike)


def test_words_are_split_as_bytes_are():
    odd = ["", None, " a  B\tc\n", "\x0b\x0c\rX", "É é\u00a0z\u2003y", "".join(f"q{chr(i)}" for i in range(128)), "\x1c\x85 \x1f"]
    words, counts = classlm._split(pa.array(odd, pa.string()))
    assert words.to_pylist() == [w for t in odd for w in classlm.tokens(t)[:-1]]
    assert counts.tolist() == [len(classlm.tokens(t)) - 1 for t in odd]
    assert classlm._split(pa.array([], pa.string()))[1].tolist() == []


def test_texts_behind_others_are_split_alike():
    rng = random.Random(2)
    made = [" ".join(rng.choices(["One", "two", "three.", " "], k=rng.randrange(400))) for _ in range(2500)]
    whole = pa.array(made, pa.string())
    for at in range(0, 2500, 1000):
        words, counts = classlm._split(whole.slice(at, 1000))
        assert words.to_pylist() == [w for t in made[at : at + 1000] for w in classlm.tokens(t)[:-1]]
        assert counts.tolist() == [len(classlm.tokens(t)) - 1 for t in made[at : at + 1000]]


def test_batches_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(classlm, "HELD_TEXTS", 7)
    made = texts(random.Random(9), 60)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").coalesce(1)
    model = classlm.train(docs.select("text"))
    assert model.train_tokens == sum(len(classlm.tokens(t)) for t in made)
    counts = {bytes(r["word"]): (r["n"], r["class"]) for r in model.counts.collect()}
    for r in classlm.score(docs, model).collect():
        line, before = 0.0, 0
        for w in classlm.tokens(r["text"]):
            n, c = counts[w]
            line += model.step[before, c] + math.log10(n + 1) - model.mass[c]
            before = c
        assert r["n_tokens"] == r["n_known"] == len(classlm.tokens(r["text"])) and r["score"] == pytest.approx(line)
