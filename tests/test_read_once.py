"""Documents are read once and taken apart as they are, without being written out as text in between."""

import json

import pytest
from pyspark.sql import functions as F

from veristrand.functions import payload as P
from veristrand.lanes import research
from veristrand.operators import claims as C
from veristrand.operators import works as W


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_problems_of_credits_read_each_document_once(spark):
    good = {"work_id": "w", "name": "n", "role": "r", "evidence": "e", "source_url": "https://example.org", "identifiers": {}}
    kinds = [good, {**good, "role": " "}, {**good, "work_id": "x", "name": 7}, {**good, "person_url": "no url"}, {**good, "identifiers": []},
             {**good, "work_id": 1, "source_url": "ftp://a"}, {**good, "work_id": None, "evidence": None}]
    docs = F.array(*[F.lit(json.dumps(k)) for k in kinds])
    credits = spark.range(len(kinds)).select(F.col("id").alias("pos"), P.variant(F.get(docs, F.col("id").cast("int"))).alias("doc"))
    works = spark.createDataFrame([('{"id": "w"}',), ('{"id": "w"}',), ('{"id": "1"}',)], "t string").select(P.variant(F.col("t")).alias("doc"))
    found = W.credit_problems(credits, works).filter("problem <> 'Duplicate contribution in batch'")
    unknown = "Contribution references unknown work"
    assert sorted(map(tuple, found.collect())) == [
        (1, "Contribution missing role"), (2, "Contribution missing name"), (2, unknown), (3, "Invalid person URL"),
        (4, "Identifiers must be an object"), (5, unknown), (5, "Invalid source URL"), (6, "Contribution missing evidence"), (6, unknown)]
    assert plan_of(found).count("Range (") == 1


@pytest.fixture(scope="module")
def repositories(spark):
    body = [{"owner": {"login": "A"}, "fork": False, "name": "x", "language": None, "topics": ["b", {"k": 1.5}], "archived": True, "z": 1},
            {"owner": {"login": "a"}, "fork": True, "name": "f"}, {"owner": {"login": "a"}, "name": 'q"é', "description": "d"}]
    raw = {1: json.dumps(body), 2: json.dumps(body[:1] + [{"owner": {}}]), 3: json.dumps({"owner": 1}), 4: "[]"}
    responses = spark.createDataFrame(list(raw.items()), "response_id long, t string").select(
        "response_id", F.col("response_id").alias("job_id"), F.encode("t", "UTF-8").alias("raw"))
    jobs = spark.createDataFrame([(i, "github-repos", "a") for i in raw], "job_id long, provider string, subject string")
    return C.parse_responses(responses, jobs)


def test_repository_claims_keep_their_text(repositories):
    claims = C.extract_claims(repositories)
    listed = {(r.response_id, r.pos): r.value for r in claims.collect()}
    scope = '"scope":"Most recently pushed owned public repositories"}'
    assert listed == {
        (1, 0): '{"complete":true,"limit":100,"received":3,' + scope, (4, 0): '{"complete":true,"limit":100,"received":0,' + scope,
        (1, 1): '{"archived":true,"description":null,"html_url":null,"language":null,"name":"x","pushed_at":null,"topics":["b",{"k":1.5}]}',
        (1, 2): '{"archived":null,"description":"d","html_url":null,"language":null,"name":"q\\"é","pushed_at":null,"topics":null}'}
    assert {r.response_id for r in C.extraction_errors(repositories).collect()} == {2, 3}
    assert "from_json" not in plan_of(claims)


def test_credits_of_works_take_documents_apart_without_text(spark):
    text = json.dumps({"id": "https://openalex.org/W1", "display_name": "T &amp; U", "publication_year": 2025, "authorships": [
        {"author": {"id": "https://openalex.org/A1", "display_name": "N&amp;M  O"}, "author_position": " first ",
         "institutions": [{"id": "https://openalex.org/I1"}, {"id": "https://openalex.org/I1"}]},
        {"author": {"id": "https://openalex.org/A2", "display_name": " "}, "institutions": [{"id": "https://openalex.org/I1"}]},
        {"author": "nobody", "institutions": "none"}]})
    documents = spark.createDataFrame([(1, "live", "t", "p", "s", text)],
                                      "ord int, origin string, observed string, raw_path string, raw_sha256 string, text string")
    documents = P.once(documents, "doc", P.variant(F.col("text"))).drop("text")
    institutions = spark.createDataFrame([("I1", "Inst", "near")], "institution_id string, institution string, scope string")
    lane = research.scholarly_works(documents, institutions, ("near", "far"))
    assert [(r.work_id, r.name, r.role) for r in lane.credits.collect()] == [("openalex:W1", "N&M O", "author (first)")]
    assert [(r.title, r.work_date, r.organization) for r in lane.works.collect()] == [("T & U", "2025", "Inst")]
    assert "from_json" not in plan_of(lane.credits)
