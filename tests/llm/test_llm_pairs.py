"""Line dedup, n-gram Jaccard join, classes and benchmark leaks against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrand.llm import jaccard, leaks, lines, linking, words


def classes_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def changed(rng, tokens_, times, pool):
    tokens_ = list(tokens_)
    for _ in range(times):
        tokens_[rng.randrange(len(tokens_))] = rng.choice(pool)
    return tokens_


def corpus(seed=7, groups=25):
    """Texts with exact copies, chains of near copies, a phrase shared by all, short and odd ones."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    made = [None, "", " \n", "one", "ONE", "two words", "one two three", "one two three four", "One  two\tthree FOUR"]
    for _ in range(groups):
        base = rng.choices(pool, k=rng.randint(20, 120)) + "all of these share this long phrase right here".split()
        made.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            base = changed(rng, base, rng.randint(0, 3), pool)
            made.append(rng.choice([" ", "\n", "  "]).join(base))
    made += made[10:14]
    rng.shuffle(made)
    return made


def brute_sets(texts, size):
    sets = []
    for text in texts:
        own = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (text or "").split()]
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        sets.append(grams or ({tuple(own)} if own else set()))
    return sets


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_ngram_jaccard_equals_brute_force(spark, size, percent):
    texts = corpus()
    sets = brute_sets(texts, size)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and
             100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = classes_of(len(texts), links)
    ids = [i * 3 + 100 for i in range(len(texts))]
    smallest = defaultdict(lambda: 10**9)
    for i, r in zip(ids, root):
        smallest[r] = min(smallest[r], i)
    want = {(i, len(s), smallest[r]) for i, s, r in zip(ids, sets, root)}
    docs = spark.createDataFrame(list(zip(ids, texts, ids)), "doc_id long, text string, n int").repartition(3)
    found = jaccard.similar(docs, size=size, percent=percent)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()} == want
    one = jaccard.one_of_each(docs, size=size, percent=percent)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {c for _, _, c in want}


def test_jaccard_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (2, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs).collect() if r["n_shingles"])
    assert found == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert sorted(r["doc_id"] or 0 for r in jaccard.one_of_each(docs).collect()) == [0, 1, 2]
    assert jaccard.similar(docs.limit(0)).collect() == [] and jaccard.one_of_each(docs.limit(0)).collect() == []


def test_word_codes_are_those_of_the_words():
    rng = random.Random(3)
    seen = {}
    for _ in range(100):
        texts = ["".join(rng.choice("abAB \n\té日\x0b") for _ in range(rng.choice([0, 1, 3, 10, 40]))) for _ in range(5)]
        for block in words.blocks(texts, 30):
            codes, counts = words.word_codes(block)
            grams, number = words.windows(codes, counts, 4)
            i = j = 0
            for text, n, m in zip(block, counts, number):
                own = text.lower().split()
                sets = [tuple(own[k : k + 4]) for k in range(len(own) - 3)] or ([tuple(own)] if own else [])
                assert (len(own), len(sets)) == (n, m)
                for key, code in [*zip(own, codes[i : i + n]), *zip(sets, grams[j : j + m])]:
                    assert seen.setdefault(key, int(code)) == int(code)
                i, j = i + n, j + m
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    links += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    frame = spark.createDataFrame(links + links[:5], "a long, b long")
    root = classes_of(360, links)
    smallest = {}
    for i, r in enumerate(root):
        smallest.setdefault(r, i)
    held = {x for a, b in links if a != b for x in (a, b)}
    assert {(r["id"], r["root"]) for r in linking.components(frame).collect()} == {(i, smallest[root[i]]) for i in held}
    assert linking.components(frame.limit(0)).collect() == []


def test_classes_of_a_key_that_all_hold(spark):
    """Whatever links are verified, and however many rounds it takes, no class stays apart."""
    rng = random.Random(9)
    for span in (1, 3, 40):
        linked = {(a, b) for a in range(150) for b in range(a + 1, 150) if a // span == b // span or rng.random() < 0.001}
        known = spark.createDataFrame(sorted(linked), "a long, b long")
        postings = spark.createDataFrame([(7, i, (i * 31) % 150) for i in range(150)], "key long, id long, rank long")
        asked = []

        def verify(pairs):
            asked.append(pairs.count())
            return pairs.join(known, ["a", "b"])

        root = classes_of(150, linked)
        found = {r["id"]: r["root"] for r in linking.classes(postings, verify).collect()}
        groups = lambda of: sorted(sorted(i for i in range(150) if of(i) == r) for r in {of(i) for i in range(150)})
        assert groups(lambda i: found.get(i, i)) == groups(lambda i: root[i])
        assert sum(asked) <= 150 * 149 / 2
    # Groups of forty need far fewer comparisons than all pairs.
    assert sum(asked) < 150 * 149 / 4


def test_line_dedup_odd_tables(spark):
    docs = spark.createDataFrame([(None, "same line here"), (None, "same line here"), (3, "same line here\n\nother"), (4, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["cleaned"] or "", r["n_dropped"]) for r in lines.dedup_lines(docs).collect())
    assert found == [(0, "same line here", 0), (0, "same line here", 0), (3, "\nother", 1), (4, "", 0)]
    assert lines.dedup_lines(docs.limit(0)).collect() == []


PASSAGE = "The keeper of the northern light wrote down the weather each evening, and in forty years he never missed a single day of it."


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        kind = rng.randrange(3)
        letters[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice("qxz")]
    return "".join(letters)


def edits_between(pattern, text):
    """Least edits of the pattern in any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for letter in text:
        last, row = row, [0]
        for j, p in enumerate(pattern, 1):
            row.append(min(last[j - 1] + (p != letter), last[j] + 1, row[j - 1] + 1))
        best = min(best, row[-1])
    return best


def test_leaks_are_those_within_the_edit_budget():
    rng = random.Random(11)
    pool = "the of and weather evening light keeper years day north single missed wrote each".split()
    index = leaks.Index([(0, PASSAGE)])
    texts = [f"{' '.join(rng.choices(pool, k=20))} {edited(rng, PASSAGE, rng.randint(0, 16))} {' '.join(rng.choices(pool, k=20))}" for _ in range(60)]
    texts += [" ".join(rng.choices(pool, k=60)) for _ in range(20)]
    found = index.search([leaks.lowered(t).encode() for t in texts])
    form = lambda t: leaks.normal(np.frombuffer(leaks.lowered(t).encode(), np.uint8))[0].tobytes().decode()
    item = form(PASSAGE)
    windows = [item[s : s + leaks.WINDOW] for s in index.at]
    for text, own in zip(texts, found):
        least = [edits_between(w, form(text)) for w in windows]
        assert bool(own) == any(e <= b for e, b in zip(least, index.budget)), least
    assert sum(map(bool, found)) > 20 and not any(found[60:])


def test_leaks_in_a_table(spark):
    rows = [(1, None), (2, ""), (3, f"Ça va. {PASSAGE.upper()} Fin."), (4, "nothing " * 5000 + PASSAGE), (5, PASSAGE[:50]), (None, f"\0{PASSAGE}\0")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, leaks int")
    items = spark.createDataFrame([("a", PASSAGE), ("b", PASSAGE), ("c", "too short"), ("d", None), (None, PASSAGE * 2)], "item_id string, text string")
    found = {r["doc_id"]: r["leaks"] for r in leaks.leaks(docs, items).collect()}
    assert [len(found[i]) for i in (1, 2, 3, 4, 5, None)] == [0, 0, 3, 3, 0, 3]
    hit = next(x for x in found[3] if x["item"] == "a")
    assert rows[2][1][hit["begin"] : hit["end"]] in (PASSAGE.upper(), PASSAGE.upper()[:-1]) and hit["edits"] == 0
    assert leaks.leaks(docs, items.limit(0)).filter(F.size("leaks") > 0).count() == 0
    assert leaks.leaks(docs.limit(0), items).collect() == []


def test_items_in_blocks_give_the_same_leaks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"x {PASSAGE} y")], "doc_id long, text string")
    items = spark.createDataFrame([(i, PASSAGE[: 60 + i]) for i in range(40)], "item_id long, text string")
    whole = {x["item"] for x in leaks.leaks(docs, items).first()["leaks"]}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 700)
    assert {x["item"] for x in leaks.leaks(docs, items).first()["leaks"]} == whole == set(range(40))
