"""Run named queries in Spark and DuckDB and compare them as multisets of rows."""

import datetime
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in records)


def duck(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def compare(spark, connection, folder, run, sql):
    """An empty text when both agree, else what differs."""
    frame = run(spark, folder)
    left = rows_of(frame.columns, frame.collect())
    result = connection.execute(sql)
    right = rows_of([d[0] for d in result.description], result.fetchall())
    if left == right:
        return "", sum(left[1].values())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", 0
    only_left, only_right = left[1] - right[1], right[1] - left[1]
    return (f"{sum(only_left.values())} only in Spark {list(only_left)[:3]}, "
            f"{sum(only_right.values())} only in SQL {list(only_right)[:3]}"), 0


if __name__ == "__main__":
    import __spark_entry__ as contract

    from veristrand.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, connection = local_session(8), duck(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in wanted or queries:
        begun = time.time()
        try:
            if name in oracles:
                problem, count = compare(spark, connection, folder, queries[name], oracles[name])
            else:
                problem, count = "", queries[name](spark, folder).count()
        except Exception as error:  # report and go on with the other queries
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", 0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} {count} rows {time.time() - begun:.1f}s {problem}", flush=True)
    print("failed", bad)
