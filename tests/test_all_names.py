"""A name that many right records hold: every one of them is a candidate, without a limit of names."""

import random

import duckdb
import pytest
from compare import compare

import __spark_entry__ as contract
from veristrand.operators import fuzzy
from veristrand.operators import reconcile as R
from veristrand.sources.datasets import dataset_from_documents, prepared


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    tables = {
        "nation": ([(0, "GREENLAND", 0), (1, "NORTHMARCH", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": (
            [(i, f"Customer#{i}", i % 2, 100.0 + i, ("MACHINERY", "BUILDING")[i // 2 % 2]) for i in range(1, 9)],
            "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": (
            [(i, f"Supplier#{i}", int(i > 30), 103.0 + i if i < 4 else 5000.0 + i) for i in range(1, 34)],
            "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


@pytest.mark.parametrize("name", [
    "all_candidate_pairs", "best_of_all_candidates", "record_status", "match_summary", "match_quality", "reviewed_pairs"])
def test_no_name_is_left_out(spark, folder, name, monkeypatch):
    def limited(*_):
        raise AssertionError("a limit of names")

    monkeypatch.setattr(fuzzy, "_best", limited)
    connection = duckdb.connect()
    for table in ("nation", "customer", "supplier"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    problem, _ = compare(spark, connection, folder, contract.queries()[name], contract.oracle_sql()[name])
    assert problem == ""


def test_all_holders_of_a_hot_name(spark, folder):
    pairs = contract.queries()["all_candidate_pairs"](spark, folder)
    # Customer 4 is of the first nation, in machinery, as 30 suppliers are.
    assert {r["right_id"] for r in pairs.filter("left_id = '4'").collect()} >= {str(i) for i in range(1, 31)}


@pytest.mark.parametrize("name", ["record_status", "match_summary", "match_quality"])
def test_statuses_list_no_pairs_of_names(spark, folder, name, monkeypatch):
    def listed(*_):
        raise AssertionError("pairs of records were listed")

    monkeypatch.setattr(R.NameClasses, "pairs", listed)
    assert contract.queries()[name](spark, folder).count() > 0


def test_counted_statuses_equal_listed_ones(spark):
    """Records with several names, partners that reviews settle, and all of them at once."""
    rng = random.Random(3)
    pool = ["ana maria lopes", "ana maria lopez", "anna maria lopes", "otto krantz", "otto kranz", "wu lin"]
    sides = {side: [{"record_id": f"{side}{i}", "name": rng.choice(pool), "source_ref": f"https://example.org/{side}{i}",
                     "aliases": rng.sample(pool, rng.randint(0, 2)), "identifiers": {"orcid": [str(rng.randint(0, 9))]}}
                    for i in range(14)] for side in "lr"}
    made = [dataset_from_documents(spark, {
        "dataset_id": side, "entity_type": "person", "source": "https://example.org", "observed_at": "2026-01-01",
        "coverage": {"complete": True, "scope": "all"}}, rows) for side, rows in sides.items()]
    prints = [{r.record_id: r.fingerprint for r in prepared(d).collect()} for d in made]
    reviews = [(n, str(n), "run", "l", f"l{i}", "r", f"r{j}", prints[0][f"l{i}"], prints[1][f"r{j}"],
                rng.choice(["different", "different", "same", "unsure"]), "a", "b", "2026")
               for n, (i, j) in enumerate((i, j) for i in range(10) for j in range(14) if i < 5 or rng.random() < 0.3)]
    result = R.reconcile(*made, spark.createDataFrame(reviews, R.REVIEWS))
    pairs = result.pairs.collect()
    assert len({(p.left_id, p.right_id) for p in pairs}) == len(pairs)
    assert {(p.left_id, p.right_id) for p in pairs} <= {tuple(r) for r in result.candidates().collect()}
    of = lambda rid, status: [p for p in pairs if p.left_id == rid and p.status == status]
    grouped = {r.record_id for r in result.members().filter("side = 'left'").collect()}
    seen = set()
    for r in result.records.collect():
        if r.left_id not in grouped:
            matched = of(r.left_id, "matched")
            want = ("matched" if len(matched) == 1 else "possible_match" if matched or of(r.left_id, "possible_match") else "unmatched")
            assert r.status == want or r.reason == R.SHARED_OWNER and want == "matched"
            seen.add(want)
    assert "possible_match" in seen and len(seen) > 1
