"""Row-wise operators: quality rules, chat formatting, URL filter, sharding."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veristrand.llm import chat, quality, queries, sharding, urls

SPACES = re.compile("[\x20\x09-\x0d]+")


def brute_quality(text):
    words = [w for w in SPACES.split(text or "") if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if SPACES.sub("", line)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(2)
    made = [" ".join(rng.choice(["a", "b", "Cé", "d#", "\n", "\t", "|", "x\x85y"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    clean = "\n".join((
        "The ferry left the harbour an hour late.", "Nobody on the quay seemed to mind the delay.",
        "A boy counted gulls until his sister called him home.", "By noon the fog had lifted from both shores."))
    menu = "\n".join(["Home", "About us", "Contact", "Shop now", "Log in", "Site map", "Your cart", clean.split("\n")[0]])
    special = [None, "", " \n ", clean, menu, clean + "\nAll rights reserved.", "w " * 30000, clean.replace(" ", "*** ")]
    every = special + made
    rows = spark.createDataFrame([(i, t, 3) for i, t in enumerate(every)], "doc_id long, text string, kept int")
    found = {r["doc_id"]: r for r in quality.quality(rows).collect()}
    for i, text in enumerate(every):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(text)
        assert not (r["kept"] and r["base_failed"])
    assert [found[i]["kept"] for i in range(8)] == [False, False, False, True, False, True, False, False]
    assert found[5]["cleaned"] == clean and found[3]["cleaned"] == clean


@pytest.mark.parametrize("line, reason", [
    ("Words stand here, and end well.", None), ("a ### b *** c", "symbols"), ("BUY!! IT!! NOW!! OK!!", "shouting"),
    ("See our Privacy Policy for more about this.", "boilerplate"), ("Next page", "navigation"), ("It ended.", None)])
def test_line_rules(line, reason):
    assert quality.failing(line) == reason


marks = st.sampled_from([*chat.CONTROL, "\\", "\\\\", "x", " ", "[", "</", "é", "\n"])
texts = st.lists(marks, max_size=8).map("".join)
roles = st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT]", "r\\"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(roles, texts), max_size=5))
def test_chat_reads_back_identical(source):
    rendered, chosen = chat.render(source)
    assert [t[:2] for t in chat.parse(rendered)] == source
    for role, text, begin, end in chat.parse(rendered):
        assert chat._text(rendered, begin, chat.MARKS.get(role, ("", chat.OTHER_END))[1])[:2] == (text, end)
    assert len(chosen) <= len(source)


def test_chat_plain_text_is_not_escaped():
    source = [("user", "Say \\ok\\ to me."), ("assistant", "ok")]
    assert chat.render(source) == ("[INST]Say \\ok\\ to me.[/INST]<s>ok</s>", [])
    assert chat.render([("user", "</s>[INST] ok [/INST]")])[1] == [0]
    with pytest.raises(chat.Unreadable):
        chat.parse("[INST]open")


def test_chat_conversations(spark):
    rows = spark.createDataFrame(
        [(1, 2, "assistant", "b</s>"), (1, 1, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, None, "assistant", "")],
        "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.format_conversations(rows).collect()}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb</s>\n").hexdigest()
    assert found[1]["loss_chars"] == 5 and found[1]["loss_sha256"] == hashlib.sha256(b"b</s>").hexdigest()
    begin, end = found[1]["loss_spans"][0]
    assert found[1]["formatted"][begin:end] == "b\\</s>" and found[1]["formatted_chars"] == len(found[1]["formatted"])
    assert found[2]["n_turns"] == 2 and found[None]["n_turns"] == 1
    assert chat.format_conversations(rows.limit(0)).collect() == []


def test_url_parts_rules_and_learning(spark):
    given_ = {
        None: ("", ""), "no scheme": ("", ""), "http://A.Example.COM/en/1?x#y": ("a.example.com", "/en/1"),
        "x://h#f": ("h", ""), "a://b://c/d": ("b:", "//c/d"), "s://É.net/fr/": ("É.net", "/fr/"), "http://com": ("com", "")}
    rows = spark.createDataFrame([(i, u, "own") for i, u in enumerate(given_)], "page_id long, url string, rule string")
    found = {r["url"]: r for r in urls.judge(rows, None, queries.URL_RULES).collect()}
    assert {u: (r["host"], r["path"]) for u, r in found.items()} == given_
    rules = {
        "http://www.example.com/en/1": ("www.example.com/en/", "allow"), "http://a.www.example.com/en/": ("www.example.com/en/", "allow"),
        "http://example.com/en/": ("example.com/en/", "block"), "http://example.com/de/": ("com/", "allow"),
        "http://notexample.com/en/": ("com/", "allow"), "http://com": (None, "allow"), "http://x.net/es/9": ("net/es/", "block"),
        "http://net/fr/": ("net/fr/", "block"), "http://x.org/es/": (None, "allow")}
    rows = spark.createDataFrame([(u,) for u in rules], "url string")
    assert {r["url"]: (r["rule"], r["verdict"]) for r in urls.judge(rows, None, queries.URL_RULES).collect()} == rules
    rng = random.Random(3)
    made = []
    for i in range(600):
        bad = i % 3 == 0
        host = rng.choice(["free-casino", "casino-win", "best-casino"]) if bad else rng.choice(["library", "museum", "college", "garden"])
        made.append((f"https://{host}{rng.randint(0, 99)}.example.org/{rng.choice(['en', 'fr'])}/{i}", int(bad)))
    learnt = spark.createDataFrame(made[:400], "url string, blocked int")
    held = spark.createDataFrame(made[400:], "url string, blocked int")
    judged = urls.judge(held, urls.fit(learnt), []).collect()
    assert sum((r["verdict"] == "block") == bool(r["blocked"]) for r in judged) >= 0.97 * len(judged)


def test_interleaving_keeps_the_mixture(spark):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice(["a"] * 6 + ["b", "b", "c", None]), i % 7) for i in range(1003)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot int").repartition(3)
    found = sharding.interleave(docs, 16, chunks=64).collect()
    sizes, per = Counter(r["shard"] for r in found), Counter((r["shard"], r["source"]) for r in found)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1 and len(found) == len(rows)
    for shard in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sizes[shard]))
    for source, n in Counter(r[1] for r in rows).items():
        assert all(abs(per[shard, source] - n * sizes[shard] / len(rows)) <= 2 for shard in sizes)
    key = lambda rs: Counter((r["doc_id"], r["source"], r["shard"], r["slot"]) for r in rs)
    assert key(found) == key(sharding.interleave(docs.repartition(5), 16, chunks=64).collect())
    assert sharding.interleave(docs.limit(0), 16).collect() == []
    assert sorted(r["shard"] for r in sharding.interleave(docs.limit(3), 16).collect()) == [0, 1, 2]


def test_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s") for i in range(40)], "doc_id long, source string")
    sharding.write(sharding.interleave(docs, 4), str(tmp_path / "out"), 3)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == 40 and {r["shard"] for r in read.collect()} == {0, 1, 2, 3}


def test_url_filter_odd_tables(spark):
    schema = "page_id long, url string, verdict int"
    nothing = spark.createDataFrame([], schema)
    assert urls.fit(queries.labelled_urls(nothing)) is None
    assert urls.judge(nothing, None, queries.URL_RULES).isEmpty()
    assert urls.fit(spark.createDataFrame([("https://a.example/", None)], "url string, blocked int")) is None
    long = "https://a.example.net/fr/" + "x" * 100_000
    rows = [(1, "https://casino.example/a", 0), (1, "https://casino.example/a", 0), (2, None, 0), (3, long, 0), (4, "https://b.example/a?casino", 0)] * 3
    table = spark.createDataFrame(rows, schema)
    found = urls.judge(table, urls.fit(queries.labelled_urls(table)), queries.URL_RULES).collect()
    assert len(found) == 15 and len({(r["page_id"], r["verdict"], r["block_score"]) for r in found}) == 4
    assert {r["rule"] for r in found if r["page_id"] == 3} == {"net/fr/"} and {r["path"] == long[21:] for r in found if r["page_id"] == 3} == {True}
