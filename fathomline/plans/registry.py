"""Named queries and the SQL that states the same result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries with ``@registry.query(name, sql)``; ``sql`` is absent where SQL cannot state the result."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is defined twice")

            @functools.wraps(fn)
            def run(spark: SparkSession, directory: str) -> DataFrame:
                ship_package(spark)
                return fn(spark, directory)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add
