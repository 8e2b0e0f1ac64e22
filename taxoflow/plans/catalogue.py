"""Queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxoflow.plans import contracts, extras, general, networks, rankings, records, statistics

MODULES = [general, records, networks, rankings, statistics, extras, contracts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
