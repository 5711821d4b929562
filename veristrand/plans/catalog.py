"""Named queries over a folder of Parquet tables, each with SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Register a function of one ``table`` lookup under a name."""

        def register(build: Callable) -> Callable:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return build(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return build

        return register
