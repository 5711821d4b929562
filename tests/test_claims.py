import hashlib
import json

import pytest

from veristrand.operators import claims as C
from veristrand.operators import feed as feeds
from veristrand.plans.evidence import EVENTS, JOBS, LINKS, RESPONSES, ChangeFeed, Evidence


def author(latest="I2", later=2025, **extra):
    return {"id": "https://openalex.org/A1", "display_name": "Fictional Researcher",
            "affiliations": [
                {"institution": {"id": "https://openalex.org/I1", "display_name": "Origin"}, "years": [2018, 2020]},
                {"institution": {"id": "https://openalex.org/I2", "display_name": "Destination"}, "years": [later]}],
            "last_known_institutions": [{"id": "https://openalex.org/" + latest, "display_name": "Latest"}],
            "topics": [{"display_name": "Robotics", "id": "T1", "count": 3}], **extra}


@pytest.fixture
def evidence(spark, tmp_path):
    class Archive(Evidence):
        last = 0

        def job(self, job_id, provider, subject, profile=None):
            self.add("jobs", spark.createDataFrame([(job_id, provider, subject, "pending", 0, 0.0, 0.0, None)], JOBS))
            if profile:
                self.add("links", spark.createDataFrame([(profile, provider, subject)], LINKS))

        def respond(self, job_id, *bodies):
            rows = []
            for body in bodies:
                self.last += 1
                raw = body if isinstance(body, bytes) else json.dumps(body).encode()
                rows.append((self.last, job_id, 1000.0 + self.last, f"https://example.org/{job_id}",
                             hashlib.sha256(raw).hexdigest(), bytearray(raw), "1"))
            self.archive(spark.createDataFrame(rows, RESPONSES))

    return Archive(spark, str(tmp_path / "evidence"))


def values(evidence, response_id):
    rows = evidence.claims().filter(f"response_id = {response_id}").orderBy("pos").collect()
    return [(r.predicate, json.loads(r.value)) for r in rows]


def test_author_claims_and_follow_ups(evidence):
    evidence.job(1, "openalex-author", "A1", "p1")
    evidence.respond(1, author(), author(last_known_institutions=None, orcid="https://orcid.org/1"))
    assert values(evidence, 1) == [
        ("name", "Fictional Researcher"),
        ("publication_affiliation", {"institution_id": "I1", "name": "Origin", "years": [2018, 2020]}),
        ("publication_affiliation", {"institution_id": "I2", "name": "Destination", "years": [2025]}),
        ("latest_publication_institution", {"institution_id": "I2", "name": "Latest"}),
        ("research_topic", {"name": "Robotics", "id": "T1", "work_count": 3, "basis": C.TOPIC_BASIS})]
    assert ("provider_orcid", "https://orcid.org/1") in values(evidence, 2)
    parsed = C.parse_responses(evidence.responses(), evidence.jobs())
    assert [tuple(r) for r in C.follow_ups(parsed, evidence.jobs()).collect()] == [("openalex-institution", "I2")]


def test_account_repository_and_institution_claims(evidence):
    evidence.job(1, "github-profile", "demo")
    evidence.job(2, "github-repos", "demo")
    evidence.job(3, "openalex-institution", "I2")
    evidence.respond(1, {"login": "DEMO", "id": 7, "bio": "Robotics é", "name": ""})
    evidence.respond(2, [{"owner": {"login": "demo"}, "fork": False, "language": "Python", "name": "x"},
                         {"owner": {"login": "Demo"}, "fork": True}])
    evidence.respond(3, {"id": "https://openalex.org/I2", "geo": {"city": "Elsewhere"}})
    assert values(evidence, 1) == [("self_reported_bio", "Robotics é"), ("github_id", 7)]
    repos = values(evidence, 2)
    assert repos[0] == ("repository_coverage", {"limit": 100, "received": 2, "complete": True, "scope": C.REPOSITORY_SCOPE})
    assert [r[0] for r in repos] == ["repository_coverage", "public_repository"]
    assert repos[1][1] == {"html_url": None, "name": "x", "description": None, "language": "Python", "topics": None,
                           "pushed_at": None, "archived": None}
    assert values(evidence, 3) == [("institution_location", {"name": None, "ror": None, "geo": {"city": "Elsewhere"}})]


def test_unusable_responses_stay_archived_without_claims(evidence):
    evidence.job(1, "openalex-author", "A1")
    evidence.job(2, "github-repos", "demo")
    evidence.job(3, "github-profile", "demo")
    evidence.respond(1, b"{invalid", {**author(), "id": "https://openalex.org/A2"}, {**author(), "affiliations": [{}]})
    evidence.respond(2, {"not": "a list"}, [{"owner": {"login": "other"}}])
    evidence.respond(3, {"login": "other", "id": 1}, {"login": "demo"})
    errors = C.extraction_errors(C.parse_responses(evidence.responses(), evidence.jobs())).orderBy("response_id")
    assert [r.error for r in errors.collect()] == [
        "JSONDecodeError", "ValueError", "KeyError", "ValueError", "ValueError", "ValueError", "KeyError"]
    assert evidence.claims().count() == 0
    assert bytes(C.raw_response(evidence.responses(), 1).first().raw) == b"{invalid"
    with pytest.raises(KeyError):
        C.raw_response(evidence.responses(), 99)
    stats = evidence.stats(now=10)
    assert (stats["jobs"], stats["due"], stats["responses"], stats["claims"]) == ({"pending": 3}, 3, 7, 0)


def test_latest_claims_survive_failures_and_movement_needs_strict_order(evidence):
    evidence.job(1, "openalex-author", "A1", "p1")
    evidence.respond(1, author())
    assert [r.subject for r in evidence.transitions(["I1"]).collect()] == ["A1"]
    moved = evidence.transitions(["I1"]).first()
    assert moved.name == "Fictional Researcher" and json.loads(moved.later[0])["institution_id"] == "I2"
    assert evidence.transitions(["I1", "I2"]).count() == 0
    evidence.respond(1, b"broken")
    assert evidence.search("robotics")["total"] == 1
    assert evidence.search("a1")["total"] == 5
    evidence.respond(1, author(later=2020))
    assert evidence.transitions(["I1"]).count() == 0
    evidence.respond(1, author(latest="I1"))
    assert evidence.transitions(["I1"]).count() == 0
    assert evidence.search("robotics")["total"] == 1
    with pytest.raises(ValueError):
        evidence.transitions([])


def kinds(events):
    return [(e["predicate"], e["kind"]) for e in events]


def test_feed_replays_and_reports_changes_and_absence(evidence):
    evidence.job(1, "github-profile", "fixture")
    evidence.respond(1, {"login": "fixture", "id": 1, "bio": "Robotics", "location": "Example City"})
    feed = ChangeFeed(evidence)
    first = feed.read(limit=1)
    assert first == feed.read(limit=1) and first["has_more"]
    cursor = feed.read(after=first["cursor"])["cursor"]
    evidence.respond(1, {"login": "fixture", "id": 1, "bio": "Robotics", "location": "Example City"})
    assert feed.read(cursor)["events"] == []
    evidence.respond(1, {"login": "fixture", "id": 1, "bio": "Sensors"})
    changes = feed.read(cursor)["events"]
    assert kinds(changes) == [("self_reported_bio", "changed"), ("self_reported_location", "absent_from_latest")]
    assert changes[0]["before"] == ['"Robotics"'] and changes[0]["previous_response_id"] == 2
    cursor = changes[-1]["sequence"]
    evidence.respond(1, b"not-json")
    assert feed.read(cursor)["events"] == []
    with pytest.raises(ValueError):
        feed.read(after=-1)


def test_feed_takes_several_responses_per_job_in_one_sync(spark, evidence):
    evidence.job(1, "github-profile", "fixture")
    bodies = [{"login": "fixture", "id": 1, "bio": b} for b in ("a", "b", "b", "c")]
    evidence.respond(1, *bodies)
    feed = ChangeFeed(evidence)
    events = feed.read()["events"]
    assert [(e["response_id"], e["before"], e["after"]) for e in events if e["predicate"] == "self_reported_bio"] == [
        (1, [], ['"a"']), (2, ['"a"'], ['"b"']), (4, ['"b"'], ['"c"'])]
    assert [e["sequence"] for e in events] == [1, 2, 3, 4]
    nothing = spark.createDataFrame([], "job_id bigint, response_id bigint")
    pending = feeds.pending_responses(evidence.responses(), evidence.claims(), nothing)
    narrow = feeds.claim_changes(evidence.responses(), evidence.claims(), evidence.jobs(), pending)
    assert [r.sequence for r in feeds.sequenced(narrow, 10, width=2).orderBy("response_id", "predicate").collect()] == [11, 12, 13, 14]
    assert narrow.count() == 4


def test_in_flight_response_is_not_lost_and_late_one_is_ignored(spark, evidence):
    evidence.job(1, "github-profile", "fixture")
    evidence.respond(1, {"login": "fixture", "id": 1, "bio": "a"})
    feed = ChangeFeed(evidence)
    cursor = feed.read()["cursor"]
    row = evidence.responses().first()
    waiting = [(rid, 1, 2000.0, row.url, "x", bytearray(b"{}"), "1") for rid in (4, 3)]
    evidence.add("responses", spark.createDataFrame(waiting, RESPONSES))
    assert feed.read(cursor)["events"] == []
    claim = "response_id bigint, subject string, predicate string, value string, pos bigint"
    evidence.add("claims", spark.createDataFrame([(4, "fixture", "self_reported_bio", '"b"', 0)], claim))
    events = feed.read(cursor)["events"]
    assert kinds(events) == [("github_id", "absent_from_latest"), ("self_reported_bio", "changed")]
    evidence.add("claims", spark.createDataFrame([(3, "fixture", "self_reported_bio", '"late"', 0)], claim))
    assert feed.read(events[-1]["sequence"])["events"] == []


def test_repeated_batch_changes_nothing(evidence):
    evidence.job(1, "github-profile", "fixture")
    evidence.respond(1, {"login": "fixture", "id": 1})
    feed = ChangeFeed(evidence)
    assert feed.sync("b-0") == 1 and feed.sync("b-0") == 1
    assert feed.events().count() == 1


def test_plain_and_named_batches_number_every_event_once(spark, evidence):
    """Reads, plain syncs, named batches, a repeated batch and one that died before its commit."""
    evidence.job(1, "github-profile", "fixture")
    feed, seen = ChangeFeed(evidence), []
    for number, bio in enumerate("abcdef"):
        evidence.respond(1, {"login": "fixture", "id": 1, "bio": bio})
        if number == 4:  # written, but never committed
            feed.tables.write(spark.createDataFrame([], EVENTS).drop("batch"), "feed_events", "batch=s-4")
            feed.tables.write(spark.createDataFrame([(1, 99)], "job_id bigint, response_id bigint"), "feed_heads", "batch=s-4")
        if number % 2:
            feed.read()
        else:
            assert feed.sync(f"s-{number}") == (2 if number == 0 else 1)
            assert feed.sync("s-0") == 2
        events = feed.read(limit=5000)["events"]
        assert events[: len(seen)] == seen and [e["sequence"] for e in events] == list(range(1, len(events) + 1))
        seen = events
    assert [e["after"] for e in seen if e["predicate"] == "self_reported_bio"] == [[f'"{b}"'] for b in "abcdef"]


def test_seeding_counts_new_tasks_only(spark, evidence):
    profiles = spark.createDataFrame([
        ("p1", json.dumps({"external_ids": json.dumps({"openalex": "https://openalex.org/A1", "github": "Demo"})})),
        ("p2", json.dumps({"external_ids": {"github": "demo"}})),
        ("p3", json.dumps({"external_ids": "not json"})),
        ("p4", json.dumps({})),
        ("p5", json.dumps({"external_ids": {"openalex": "bad"}}))], "profile_id string, payload string")
    evidence.job(1, "github-profile", "demo")
    tasks = sorted(tuple(r) for r in C.seed_tasks(profiles, evidence.jobs()).collect())
    assert tasks == [("p1", 0, "openalex-author", "A1"), ("p1", 2, "github-repos", "demo")]
    assert C.seed_tasks(profiles, evidence.jobs(), limit=1).count() == 1
    listed = C.identifier_tasks(profiles)
    assert {r.profile_id for r in listed.filter("invalid").collect()} == {"p3", "p5"}
    assert [r.profile_id for r in listed.filter("missing").collect()] == ["p4"]
    links = spark.createDataFrame([("p2", "github-profile", "demo")], LINKS)
    fresh = C.new_links(links, listed.filter("provider IS NOT NULL"))
    assert fresh.count() == 4
    targets = spark.createDataFrame([("github-profile", "demo")], "provider string, subject string")
    assert C.eligible_jobs(evidence.jobs(), 100, targets).count() == 1
    assert C.eligible_jobs(evidence.jobs(), -1).count() == 0
