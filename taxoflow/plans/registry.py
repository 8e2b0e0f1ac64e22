"""A register of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name, with its SQL if SQL can express it."""

        def add(run: Query) -> Query:
            self.queries[run.__name__] = run
            if sql is not None:
                self.oracles[run.__name__] = sql
            return run

        return add
