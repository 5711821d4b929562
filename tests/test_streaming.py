import json
from concurrent.futures import ThreadPoolExecutor

from test_consumers import build, job

from veristrand.plans.consumers import Subscriptions
from veristrand.plans.evidence import RESPONSES, ChangeFeed, Evidence
from veristrand.streaming.feed import response_stream, run_cycles, run_feed


def bodies(values):
    return [json.dumps({"login": "fixture", "id": 1, "bio": v}).encode() for v in values]


def drop(spark, path, first, raws):
    rows = [(first + i, 1, 1.0, "https://example.org", "h", bytearray(raw), "1") for i, raw in enumerate(raws)]
    spark.createDataFrame(rows, RESPONSES).coalesce(1).write.mode("append").parquet(path)


def contents(feed):
    rows = feed.events().orderBy("sequence").collect()
    return [(r.sequence, r.response_id, r.predicate, r.kind, r.before, r.after) for r in rows]


def test_streamed_feed_equals_the_batch_feed(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    streamed = Evidence(spark, str(tmp_path / "streamed"))
    job(streamed, 1, "github-profile", "fixture")
    feed = ChangeFeed(streamed)
    drop(spark, source, 1, bodies("ab"))
    run_feed(streamed, feed, response_stream(streamed, source), state).awaitTermination()
    drop(spark, source, 3, [*bodies("b"), b"not-json", *bodies("c")])
    run_feed(streamed, feed, response_stream(streamed, source), state).awaitTermination()
    batch = Evidence(spark, str(tmp_path / "batch"))
    job(batch, 1, "github-profile", "fixture")
    batch.archive(spark.read.schema(RESPONSES).parquet(source))
    whole = ChangeFeed(batch)
    whole.sync()
    assert contents(feed) == contents(whole) and len(contents(feed)) == 4
    feed.sync("stream-1", archived="stream-1")
    feed.sync()
    assert contents(feed) == contents(whole)


def test_plain_reads_beside_a_stream_lose_and_double_nothing(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    evidence = Evidence(spark, str(tmp_path / "e"))
    job(evidence, 1, "github-profile", "fixture")
    feed, first = ChangeFeed(evidence), bodies("xy")
    for number, raw in enumerate(first):
        evidence.archive(spark.createDataFrame([(number + 1, 1, 1.0, "https://example.org", "h", bytearray(raw), "1")], RESPONSES))
        feed.sync()
    drop(spark, source, 3, bodies("yz"))
    run_feed(evidence, feed, response_stream(evidence, source), state).awaitTermination()
    assert feed.read()["cursor"] == 4
    drop(spark, source, 5, bodies("w"))
    run_feed(evidence, feed, response_stream(evidence, source), state).awaitTermination()
    rows = contents(feed)
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
    assert [r[5] for r in rows if r[2] == "self_reported_bio"] == [['"x"'], ['"y"'], ['"z"'], ['"w"']]


def test_two_writers_give_every_number_once(spark, tmp_path, monkeypatch):
    evidence = Evidence(spark, str(tmp_path / "e"))
    job(evidence, 1, "github-profile", "fixture")
    slow, fast = ChangeFeed(evidence), ChangeFeed(evidence)
    add = lambda n, raw: evidence.archive(spark.createDataFrame(
        [(n, 1, 1.0, "https://example.org", "h", bytearray(raw), "1")], RESPONSES))
    add(1, bodies("x")[0])
    compared, tries = slow._compare, []

    def overtaken(*asked):
        found = compared(*asked)
        tries.append(found)
        if len(tries) == 1:  # another writer commits between the comparison and the claim
            add(2, bodies("y")[0])
            assert fast.sync("other") > 0
        return found

    monkeypatch.setattr(slow, "_compare", overtaken)
    assert slow.sync("own") == 0 and len(tries) == 2
    add(3, bodies("z")[0])
    assert slow.sync("own") == 1 and slow.sync("own") == 1 and fast.sync() == 0
    rows = contents(slow)
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    assert [r[5] for r in rows if r[2] == "self_reported_bio"] == [['"x"'], ['"y"'], ['"z"']]
    folders = {p.name for p in (tmp_path / "e" / "feed_events").iterdir() if p.name.startswith("folder=")}
    assert folders == {f"folder={r.folder}" for r in slow.commits().collect()}


def test_threads_claim_one_commit_each(spark, tmp_path):
    tables = Evidence(spark, str(tmp_path / "e")).tables
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: tables.claim(f"{i}\n", "log", f"{i % 4}.json"), range(32)))
    assert sum(won) == 4 and sorted(p.name for p in (tmp_path / "e" / "log").iterdir() if p.suffix == ".json") == [f"{i}.json" for i in range(4)]


def test_reading_without_a_sync_writes_nothing(spark, tmp_path):
    evidence = Evidence(spark, str(tmp_path / "e"))
    job(evidence, 1, "github-profile", "fixture")
    evidence.archive(spark.createDataFrame([(1, 1, 1.0, "https://example.org", "h", bytearray(bodies("x")[0]), "1")], RESPONSES))
    feed = ChangeFeed(evidence)
    assert feed.read(sync=False)["events"] == [] and not (tmp_path / "e" / "feed_commits").exists()
    assert feed.read()["events"] == feed.read(sync=False)["events"] != []


def test_streamed_cycles_evaluate_subscriptions(spark, tmp_path, write_jsonl):
    person = {"record_id": "p1", "name": "Fictional Person", "source_url": "https://example.org/person", "regional_evidence": "x"}
    store = build(spark, tmp_path, write_jsonl, [person])
    evidence, subs = Evidence(spark, str(tmp_path / "e")), Subscriptions(spark, str(tmp_path / "s"))
    job(evidence, 1, "github-profile", "fixture", "p1")
    sid = subs.create("a", "Robotics", {"query": "robotics"})["id"]
    source = str(tmp_path / "in")
    drop(spark, source, 1, bodies(["Robotics"]))
    drop(spark, source, 2, bodies(["Gardening"]))
    run_cycles(evidence, ChangeFeed(evidence), response_stream(evidence, source, 1), str(tmp_path / "state"), store, subs,
               [("a", sid)]).awaitTermination()
    assert [e["kind"] for e in subs.events("a")["events"]] == ["entered", "exited"]
