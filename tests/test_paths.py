"""Paths through more nodes than the visit budget of a served request."""

import datetime

import duckdb
from compare import compare

import __spark_entry__ as contract
from veristrand.operators import graph


def test_sourced_path_visits_everyone(spark, tmp_path):
    """10,050 customers of one day; the last by name, 9999, is the last one reached."""
    day = datetime.date(1995, 1, 1)
    rows = [(20_000 if c == 9999 else c, c, day) for c in range(10_050)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    problem, count = compare(spark, connection, str(tmp_path), contract.queries()["sourced_path"], contract.oracle_sql()["sourced_path"])
    assert (problem, count) == ("", 2)


def test_budget_still_ends_a_served_request(spark):
    rows = [(i, f"p{i}", '{"object_url": "https://example.org/d"}') for i in range(8)]
    frame = spark.createDataFrame(rows, "pos long, profile_id string, payload string")
    assert graph.shortest_path(frame, "p0", "p7", 2, 3).truncated
    assert graph.shortest_path(frame, "p0", "p7", 2, None).found
