"""Phrases, repairs and passages against plain brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veristrand.llm import collocations, passages, repair, spans

EMPTY = hashlib.sha256(b"").hexdigest()


def brute_phrases(rows, least, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {}
    kept = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, words), a in kept.items():
        inside = any(
            other == lang and len(longer) > len(words) and b >= a
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
            for (other, longer), b in kept.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found[lang, " ".join(words)] = (a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score)
    return found


def test_collocations_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(collocations, "HELD", 64)
    monkeypatch.setattr(collocations, "HELD_STRINGS", 16)
    monkeypatch.setattr(collocations, "HEAVY", 4)
    vocabulary = ["new", "York", "city", "hall", "é", "ß", "The", "of", "x\x85y", "\x1f"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(
        rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",\t", "\n", "?!"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "in New York City hall"), ("en", None), ("fr", ""), (None, " . ,"), ("und", "of of of of of of of")] * 8
    rows += [("de", "so weiter " * 20000)]
    table = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "lang string, text string, phrase int, n int")
    for least in (3, 8):
        found = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"])
                 for r in collocations.collocations(table, least=least).collect()}
        assert found == brute_phrases(rows, least)
    scored = collocations.collocations(table, least=3)
    ranked = collocations.best(scored, 4).collect()
    for lang in ("en", "fr", "und"):
        own = sorted(((-r["score"], -r["a"], r["phrase"].encode()) for r in scored.filter(f"lang = '{lang}'").collect()))[:4]
        assert [(-r["score"], -r["a"], r["phrase"].encode()) for r in sorted(ranked, key=lambda r: r["rank"]) if r["lang"] == lang] == own
    assert collocations.collocations(table.limit(0)).isEmpty()


def test_blocks_deal_long_texts_at_breaks():
    texts = [b"a b\n" * 50, b"", b"c" * 90, b"d\n" + b"e" * 40 + b"\nf"]
    seen = []
    for block, numbers, starts in spans.blocks(iter(texts), 30):
        found = spans.Words(block)
        own = numbers[np.searchsorted(starts, found.starts, side="right") - 1] if len(found) else []
        seen += [(int(n), found.block[a:b]) for n, a, b in zip(own, found.starts, found.ends)]
    assert seen == [(i, w) for i, t in enumerate(texts) for w in t.split()]


def test_filter_never_says_no_wrongly(spark):
    codes = [random.Random(1).getrandbits(64) - (1 << 63) for _ in range(500)] + [-1, 0, 1]
    told = spans.Filter.of(spark.createDataFrame([(c,) for c in codes], "code long"), 1 << 12)
    assert told.has(np.array(codes, np.int64).view(np.uint64)).all() and told
    assert not spans.Filter.of(spark.createDataFrame([], "code long"), 1 << 12)


def brute_repair(rows):
    """Cheapest repair of (role, text, fault) by plain strings: cost, audit, lines."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, lines) in list(states.items()):
                for i, name in names.items():
                    if (s, i) in moves:
                        new = (cost + 2, audit + "I", [*lines, f"{name}:"])
                        states[moves[s, i]] = min(states.get(moves[s, i], new), new)
        return states

    states = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for s, (cost, audit, lines) in states.items():
            offers = [(s, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (s, role[:1]) in moves:
                    offers.append((moves[s, role[:1]], (cost + extra, audit + "K", [*lines, f"{role}:{text}"])))
                offers += [(moves[s, i], (cost + 2 + extra, audit + "R", [*lines, f"{name}:{text}"])) for i, name in names.items() if (s, i) in moves]
            for state, new in offers:
                after[state] = min(after.get(state, new), new)
        states = inserted(after)
    return min(states[s] for s in (0, 3) if s in states)


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


@pytest.mark.parametrize("unsettled", [1, 2, 5, 512])
def test_repair_equals_brute_force_and_settles(monkeypatch, unsettled):
    monkeypatch.setattr(repair, "UNSETTLED", unsettled)
    rng = random.Random(unsettled)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "unit", "User"]), rng.choice(["a.", "b!", "c", "", " \x85", "d?\n"]),
                 rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 14))]
        talk = repair.Conversation()
        for row in rows:
            talk.row(*row)
        *_, cost, audit, digest = talk.result()
        want = brute_repair(rows)
        assert (cost, audit, digest) == (want[0], want[1], hashlib.sha256("\n".join(want[2]).encode()).hexdigest())


def test_settled_rows_are_not_held():
    talk, most = repair.Conversation(), 0
    for i in range(6000):
        talk.row(["user", "assistant", "tool"][i % 3], f"{i}.", None)
        most = max(most, len(talk.rows))
    assert most <= 2 * repair.UNSETTLED and len(talk.result()[5]) >= 6000


def test_equal_hashes_of_unequal_audits_are_seen(monkeypatch):
    monkeypatch.setattr(repair, "PRIME", 2)
    nodes = {}
    for size in range(6):
        for word in itertools.product("DIKR", repeat=size):
            nodes[word] = repair.Node(nodes[word[:-1]], word[-1]) if word else repair.Node(None, "")
    rng = random.Random(0)
    words = list(nodes)
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        if a != b[: len(a)] or len(a) == len(b):
            assert repair.earlier(nodes[a], nodes[b]) == ("".join(a) < "".join(b))


def test_conversations_are_repaired_whole(spark):
    rng = random.Random(11)
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", None, "tool"]),
             rng.choice(["Yes.", "No", "", None, "Why?", "Yes. ", "a.b"])) for c in [*range(40), None, 1 << 60] for _ in range(rng.randint(1, 9))]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS cost", "2 AS gone")
    found = {r["conv_id"]: r for r in repair.repair(repair.damaged(table), gone="gone").collect()}
    assert set(found) == {r[0] for r in rows}
    for conv in found:
        left = []
        for key, turn, role, text in rows:
            if key == conv:
                lot = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
                role, text = " " if role is None else role, " " if text is None else text
                text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
                left += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        judged = faults_of(left)
        cost, audit, lines = brute_repair(judged)
        turns = [t for t, _, _ in left if t is not None]
        initials = [r[:1] for r, _, _ in judged]
        r = found[conv]
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [sum(x[2] == f for x in judged) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert repair.repair(table.limit(0)).isEmpty()
    dropped = spark.createDataFrame([(7, 1, "user", "x", True)], "conv_id long, turn int, role string, text string, gone boolean")
    assert [tuple(r) for r in repair.repair(dropped, gone="gone").collect()] == [(7, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def brute_passages(rows, window):
    words = [re.sub("[ \t\n\x0b\x0c\r]+", " ", t or "").strip(" ").split(" ") if (t or "").strip(" \t\n\x0b\x0c\r") else [] for _, t in rows]
    late = float("inf")
    first = {}
    for (doc, _), own in zip(rows, words):
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            first[key] = min(first.get(key, late), late if doc is None else doc)
    out = []
    for (doc, _), own in zip(rows, words):
        gone = {i + k for i in range(len(own) - window + 1) if first[tuple(own[i : i + window])] < (late if doc is None else doc) for k in range(window)}
        out.append((doc, len(own), len(gone), " ".join(w for p, w in enumerate(own) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, first, held", [(8, 4, 1 << 19), (8, 2, 40), (7, 3, 40), (1, 1, 40), (12, 3, 200)])
def test_passages_equal_brute_force(spark, monkeypatch, window, first, held):
    monkeypatch.setattr(passages, "HELD", held)
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "B", "é", "c\x85", "dd", "e."])
    common = [[word() for _ in range(rng.choice([7, 8, 9, 30]))] for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [w for _ in range(rng.randint(0, 4)) for w in (rng.choice(common) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 12))])]
        rows.append((rng.choice([i, i, i, None, i // 2]), rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(3, None), (4, ""), (None, " \n"), (200, "a " * 300), (201, "a " * 300), (200, "a " * 300), rows[0], rows[1]]
    table = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, n_words int, extra string")
    found = passages.dedup_passages(table.repartition(5), window=window, first=first)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()), key=str) == brute_passages(rows, window)
    assert found.columns == ["doc_id", "text", "extra", "n_words", "n_removed", "kept"]
    assert passages.dedup_passages(table.limit(0)).isEmpty()


def test_a_long_text_and_nothing_repeated(spark):
    long = " ".join(map(str, range(60_000)))
    table = spark.createDataFrame([(1, long), (2, "x " + long), (3, "alone")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in passages.dedup_passages(table).collect()}
    assert found == {1: (60_000, 0, long), 2: (60_001, 60_000, "x"), 3: (1, 0, "alone")}
    alone = passages.dedup_passages(table.filter("doc_id <> 2")).collect()
    assert {r["n_removed"] for r in alone} == {0}
