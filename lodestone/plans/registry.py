"""A registry of queries and of their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of a folder, read as they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Registers f(tables) under its name."""

        def put(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[key] = sql
            return f

        return put
