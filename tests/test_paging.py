import random

from pyspark.sql import functions as F

from veristrand.operators import paging
from veristrand.plans.tables import Tables


def hot_rows():
    """One key holds most rows; ids have gaps larger than a chunk."""
    rng = random.Random(3)
    ids = rng.sample(range(5000), 400) + [20000, 20001, 30500]
    return [("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", i) for i in ids]


def test_neighbours_equal_a_plain_scan_across_chunk_borders(spark):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "key string, id bigint")
    by_key = {}
    for key, i in sorted(rows, key=lambda r: r[1]):
        by_key.setdefault(key, []).append(i)
    following = {i: b for ids in by_key.values() for i, b in zip(ids, [*ids[1:], None])}
    previous = {b: a for a, b in following.items() if b is not None}
    for parts in (1, 7, 40, None):
        found = {r.id: r.next_id for r in paging.neighbour(frame, "key", "id", parts=parts).collect()}
        assert found == following
        found = {r.id: r.previous_id for r in paging.neighbour(frame, "key", "id", forward=False, parts=parts).collect()}
        assert found == {i: previous.get(i) for _, i in rows}


def test_neighbours_of_sparse_ids_and_a_hot_key_are_dealt_evenly(spark):
    """Ids a million apart and a key with half of all rows: no task scans above twice its share."""
    rows = [("hot" if i % 2 else f"k{i % 50}", i * 1_000_000) for i in range(8000)]
    frame = spark.createDataFrame([*rows, (None, 5)], "key string, id bigint")
    found = paging.neighbour(frame, "key", "id", parts=8)
    assert {(r.id, r.next_id) for r in found.filter("key = 'hot'").collect()} == {
        (i * 1_000_000, (i + 2) * 1_000_000 if i < 7998 else None) for i in range(1, 8000, 2)}
    assert found.filter("key IS NULL").isEmpty()
    dealt = frame.filter("key IS NOT NULL").repartitionByRange(8, "key", "id").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in dealt.collect()) <= 2 * len(rows) / 8
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan


def test_numbers_are_dense_over_all_rows_and_per_key(spark):
    rows = hot_rows()
    frame = spark.createDataFrame(rows, "key string, id bigint")
    chunk = F.floor(F.col("id") / 100)
    numbered = paging.number_rows(frame, chunk, [F.col("id")], start=10)
    assert [r.sequence for r in numbered.orderBy("id").collect()] == list(range(11, 11 + len(rows)))
    per_key = paging.number_rows(frame, chunk, [F.col("id")], name="n", keys=("key",)).orderBy("key", "id").collect()
    seen = {}
    for row in per_key:
        seen[row.key] = seen.get(row.key, 0) + 1
        assert row.n == seen[row.key]


def test_sequenced_files_follow_the_order(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    names = [f"n{i:03}" for i in random.Random(1).sample(range(200), 200)]
    frame = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    tables.write_sequenced(frame, [F.col("name")], 7, "events", "run=1")
    rows = spark.read.parquet(str(tmp_path / "events" / "run=1")).orderBy("sequence").collect()
    assert [(r.sequence, r.name) for r in rows] == [(8 + i, n) for i, n in enumerate(sorted(names))]


def test_cursor_pages_repeat(spark):
    events = spark.range(1, 6).select(F.col("id").alias("sequence"))
    first = paging.after_cursor(events, 0, 2)
    assert first == paging.after_cursor(events, 0, 2) == {"events": [{"sequence": 1}, {"sequence": 2}], "cursor": 2, "has_more": True}
    assert paging.after_cursor(events, 5)["cursor"] == 5
