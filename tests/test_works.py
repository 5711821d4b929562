import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veristrand.operators import works as W
from veristrand.plans.store import EvidenceStore
from veristrand.plans.works import Works

RAW = b"Tide gauge logger, circuit and casing: Mara Oduya-Lind."
WORK = {"id": "gauge-7", "title": "Tide gauge logger", "kind": "instrument", "source_url": "https://harbour.example/gauges/7",
        "observed_at": "2024-05-17T06:30:00Z", "work_date": "2024-04", "organization": "Saltmarsh Works",
        "regional_evidence": "Moored in the outer basin", "geography_scope": "Outer basin",
        "description": "Sends hydroponic-grade salinity every hour", "raw_path": "raw.html", "raw_sha256": hashlib.sha256(RAW).hexdigest()}
CREDIT = {"work_id": "gauge-7", "name": "Mara Oduya-Lind", "role": "designer", "person_url": "", "identifiers": {},
          "evidence": RAW.decode(), "source_url": "https://harbour.example/gauges/7"}
ORIGINAL = {"record_id": "original", "name": "Teo Varga", "source_url": "https://harbour.example/staff/teo",
            "regional_evidence": "Keeps the lock gates"}


@pytest.fixture
def batch(spark, tmp_path, write_jsonl):
    class Batch:
        archive = Works(spark, str(tmp_path / "archive"))
        lane = tmp_path / "lane"

        def write(self, works=(WORK,), credits=(CREDIT,), raw=(), **manifest):
            write_jsonl(self.lane, "works", works)
            write_jsonl(self.lane, "contributions", credits)
            (self.lane / "raw.html").write_bytes(RAW)
            for name, content in raw:
                (self.lane / "raw").mkdir(exist_ok=True)
                (self.lane / "raw" / name).write_bytes(content)
            (self.lane / "manifest.json").write_text(json.dumps({
                "lane": "builders_business", "complete": False, "scope": "The harbour's instruments", "works": len(works),
                "contributions": len(credits), **manifest}))
            return self

        def ingest(self):
            return self.archive.ingest(str(self.lane))

        def store(self, *people, evidence=()):
            for name, rows in (("people", people), ("evidence", evidence), ("connections", ())):
                write_jsonl(tmp_path / "base", name, rows)
            store = EvidenceStore(spark, str(tmp_path / "store"))
            store.refresh(str(tmp_path / "base"))
            return store

        def exported(self, folder, name):
            return [json.loads(r.value) for r in spark.read.text(str(tmp_path / folder / f"{name}.jsonl")).collect()]

    return Batch()


def test_ingest_is_idempotent_and_keeps_every_raw_file(batch):
    batch.write(raw=[("blocked.html", b"Source returned a challenge, not records")])
    assert batch.ingest()["status"] == "imported"
    assert batch.ingest()["status"] == "unchanged"
    assert batch.archive.stats() == {"runs": 1, "works": 1, "contributions": 1, "artifacts": 2}
    by_path = {r.path: r.sha256 for r in batch.archive.run_artifacts().collect()}
    assert set(by_path) == {"raw.html", "raw/blocked.html"}
    kept = batch.archive.artifacts().filter(F.col("sha256") == by_path["raw.html"]).first()
    assert bytes(kept.bytes) == RAW


@pytest.mark.parametrize("change,message", [
    ({"works": ({**WORK, "raw_sha256": "0" * 64},)}, "hash mismatch"),
    ({"works": ({**WORK, "raw_path": "../outside.html"},)}, "outside batch"),
    ({"works": ({**WORK, "raw_path": "raw/missing.html"},)}, "outside batch or missing"),
    ({"works": (WORK, WORK)}, "Duplicate work"),
    ({"works": ({**WORK, "observed_at": "2026-01-01T00:00:00"},)}, "timezone"),
    ({"works": ({**WORK, "title": " "},)}, "missing title"),
    ({"credits": ({**CREDIT, "work_id": "missing"},)}, "unknown work"),
    ({"credits": (CREDIT, CREDIT)}, "Duplicate contribution"),
    ({"credits": ({**CREDIT, "identifiers": []},)}, "Identifiers"),
    ({"credits": ({**CREDIT, "person_url": "ftp://x"},)}, "person URL"),
    ({"contributions": 7}, "counts"),
    ({"complete": None}, "explicit completeness"),
])
def test_broken_batches_leave_nothing_behind(batch, change, message):
    rows = {k: v for k, v in change.items() if k in ("works", "credits") and isinstance(v, tuple)}
    manifest = {k: v for k, v in change.items() if k not in rows}
    with pytest.raises(ValueError, match=message):
        batch.write(**rows, **manifest).ingest()
    assert batch.archive.runs().count() == 0


def test_same_name_on_different_sources_stays_two_profiles(batch, tmp_path):
    store = batch.store(ORIGINAL)
    batch.write().ingest()
    other = {**WORK, "id": "other-work", "source_url": "https://harbour.example/gauges/8"}
    batch.write(works=(other,), credits=({**CREDIT, "work_id": "other-work", "source_url": other["source_url"]},)).ingest()
    assert batch.archive.export(store, str(tmp_path / "export"))["work_profiles"] == 2
    with pytest.raises(Exception):
        batch.archive.export(store, str(tmp_path / "export"))


def test_observations_keep_their_own_affiliation_and_profiles_roll_up(batch, tmp_path):
    store = batch.store(ORIGINAL)
    credit = {**CREDIT, "person_url": "https://harbour.example/people/mara"}
    batch.write(credits=(credit,)).ingest()
    second = {**WORK, "id": "second-work", "organization": "Lockkeepers", "regional_evidence": "Fixed to the sluice"}
    batch.write(works=(second,), credits=({**credit, "work_id": "second-work", "role": "adviser"},)).ingest()
    batch.archive.export(store, str(tmp_path / "export"))
    seen = sorted((o["organization"], o["role"], o["regional_evidence"]) for o in batch.exported("export", "evidence"))
    assert seen == [("Lockkeepers", "adviser", "Fixed to the sluice"),
                    ("Saltmarsh Works", "designer", "Moored in the outer basin")]
    person = next(p for p in batch.exported("export", "people") if p["record_id"] != "original")
    identity = json.dumps(["builders_business", "profile_url", "https://harbour.example/people/mara"])
    assert person["record_id"] == "person_" + hashlib.sha256(identity.encode()).hexdigest()[:24]
    assert person["organization"] == "Lockkeepers; Saltmarsh Works" and person["role"] == "adviser; designer"
    assert person["regional_evidence"] == "Moored in the outer basin\nFixed to the sluice"
    listed = sorted(batch.exported("export", "credits"), key=lambda c: (c["order"]["run"], c["order"]["pos"]))
    assert listed[0]["expertise"] == f"Tide gauge logger — designer: {RAW.decode()} Sends hydroponic-grade salinity every hour"
    assert [c["contribution"]["role"] for c in listed] == ["designer", "adviser"] and person["discovered_work_count"] == 2
    assert {c["record_id"] for c in listed} == {person["record_id"]} and [c["work"]["id"] for c in listed][1] == "second-work"
    assert person["collector"] == "university" and person["work_discovery"] is True


def test_reexport_is_stable_and_keeps_base_fields(batch, tmp_path, spark):
    profile = {**ORIGINAL, "profile_url": "https://harbour.example/people/mara"}
    store = batch.store(profile, evidence=(profile,))
    batch.write(credits=({**CREDIT, "person_url": profile["profile_url"]},)).ingest()
    first = batch.archive.export(store, str(tmp_path / "one"))
    assert (first["people"], first["new_work_profiles"], first["enriched_existing_profiles"]) == (1, 0, 1)
    store.refresh(str(tmp_path / "one"))
    assert store.stats()["unresolved_relationships"] == 0
    second = batch.archive.export(store, str(tmp_path / "two"))
    assert [second[k] for k in ("people", "evidence", "connections")] == [first[k] for k in ("people", "evidence", "connections")]
    row = batch.exported("two", "people")[0]
    assert {k: row[k] for k in profile} == profile
    assert row["discovered_work_count"] == 1
    assert batch.exported("two", "credits")[0]["contribution"]["role"] == "designer"


def test_people_are_found_by_what_their_works_say(batch, tmp_path, spark):
    known = {**ORIGINAL, "profile_url": "https://harbour.example/people/teo"}
    store = batch.store(known)
    batch.write(credits=(CREDIT, {**CREDIT, "name": "Teo Varga", "role": "tester", "person_url": known["profile_url"]})).ingest()
    assert store.search("hydroponic").count() == 0
    batch.archive.export(store, str(tmp_path / "one"))
    assert store.refresh(str(tmp_path / "one"))["status"] == "refreshed"
    found = {json.loads(r.payload)["name"]: r.score for r in store.search("hydroponic").collect()}
    assert set(found) == {"Mara Oduya-Lind", "Teo Varga"}
    # Of a made profile the line is expertise and evidence, as if both fields stood in its row.
    lines = {"made": f"Tide gauge logger — designer: {RAW.decode()} {WORK['description']}",
             "known": f"Tide gauge logger — tester: {RAW.decode()} {WORK['description']}"}
    made = json.loads(store.search("oduya").first().payload)
    whole = [({**made, "expertise": lines["made"], "work_evidence": lines["made"]}), {**known, "work_evidence": lines["known"]}]
    plain = EvidenceStore(spark, str(tmp_path / "plain"))
    ties = [json.loads(r.payload) for r in store.table("relationships").collect()]
    for name, rows in (("people", whole), ("evidence", ()), ("connections", ties)):
        (tmp_path / "flat").mkdir(exist_ok=True)
        (tmp_path / "flat" / f"{name}.jsonl").write_text("".join(json.dumps(row) + "\n" for row in rows))
    plain.refresh(str(tmp_path / "flat"))
    assert {json.loads(r.payload)["name"]: r.score for r in plain.search("hydroponic").collect()} == pytest.approx(found)
    assert store.search("salinity_every").count() == plain.search("salinity_every").count()
    credits = [r for r in store.profile(made["record_id"]).collect() if r.kind == "credits"]
    assert [json.loads(c.payload)["work"]["id"] for c in credits] == ["gauge-7"]
    # Rebuilt from the archive, not added again; a credit of nobody is refused.
    batch.archive.export(store, str(tmp_path / "two"))
    assert "profiles" not in store.refresh(str(tmp_path / "two"))["changes"]
    assert {json.loads(r.payload)["name"]: r.score for r in store.search("hydroponic").collect()} == pytest.approx(found)
    (tmp_path / "flat" / "credits.jsonl").write_text(json.dumps({"record_id": "nobody", "expertise": "x"}) + "\n")
    with pytest.raises(Exception, match="unknown record nobody"):
        plain.refresh(str(tmp_path / "flat"))


@pytest.mark.parametrize("size", [1, 10])
def test_profiles_have_one_form_at_every_size(batch, tmp_path, size):
    store = batch.store(ORIGINAL)
    credits = [{**CREDIT, "person_url": "https://harbour.example/people/mara", "role": f"role {i}"} for i in range(size)]
    batch.write(credits=credits).ingest()
    counts = batch.archive.export(store, str(tmp_path / "export"))
    assert counts["people"] == 2 and counts["evidence"] == counts["credits"] == size
    person = next(p for p in batch.exported("export", "people") if p["record_id"] != "original")
    assert person["discovered_work_count"] == size and person["role"].split("; ") == sorted(f"role {i}" for i in range(size))
    roles = [c["contribution"]["role"] for c in batch.exported("export", "credits")]
    assert sorted(roles) == sorted(f"role {i}" for i in range(size))


def test_source_identities_prefer_urls_then_identifiers(spark):
    base = {**CREDIT, "identifiers": {}}
    rows = [base, {**base, "work_id": "another"}, {**base, "identifiers": {"nih_profile_id": 12345}},
            {**base, "work_id": "another", "identifiers": {"nih_profile_id": "12345", "orcid": " "}},
            {**base, "person_url": "http://www.example.org/p/"}]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, c string")
    found = [r[0] for r in frame.orderBy("i").select(W.source_identity(F.lit("lane"), F.from_json("c", W.CREDIT_DOC))).collect()]
    assert found[0] != found[1] and found[2] == found[3] == '["lane", "nih_profile_id", "12345"]'
    assert found[4] == '["lane", "profile_url", "https://example.org/p"]'
