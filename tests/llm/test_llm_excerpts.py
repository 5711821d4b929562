"""Excerpts of benchmark items and short items."""

import random

from veristrand.llm import leaks


def test_every_excerpt_of_a_window_and_a_step_is_found():
    rng = random.Random(2)
    pool = [a + b for a in ("lantern", "harbour", "winter", "copper", "meadow", "signal", "oak") for b in ("", "s", "ed", "ing", "ward")]
    item = " ".join(rng.choices(pool, k=45))
    size = leaks.WINDOW + leaks.STEP - 1
    assert size <= 110
    index = leaks.Index([(0, item)])
    texts = [f"qqqq zzzz {item[at : at + size]} xxxx vvvv" for at in range(len(item) - size + 1)]
    found = index.search([t.encode() for t in texts])
    assert len(texts) > 100 and all(found)


def test_short_items_are_searched_whole(spark):
    texts = ["we saw Nine Blue-Lanterns there", "nine green lanterns", "it is XJ-42, or so", "", "***"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("a", "nine blue lanterns"), ("b", "xj 42"), ("c", "*!"), ("d", "")], "item_id string, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["leaks"]] for r in leaks.leaks(docs, items).collect()}
    assert [[x[0] for x in found[i]] for i in range(5)] == [["a"], [], ["b"], [], []]
    assert texts[2][slice(*found[2][0][1:3])] == "XJ-42"
