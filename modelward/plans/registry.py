"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modelward.sources.workload import Workload


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(fn: Callable[[Workload], DataFrame]):
            self.queries[name] = lambda spark, folder: fn(Workload(spark, folder))
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register
