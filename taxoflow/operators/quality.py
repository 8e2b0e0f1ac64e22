"""Contract checks: each gives the rows or counts that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.functions.text import filled


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(``column_name``, ``blank_rows``, ``blank_rate``) of every column, in one pass."""
    sums = df.agg(F.count("*").alias("__n"), *[F.count_if(filled(F.col(c).cast("string")).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("blank_rows")) for c in columns]))
    return sums.select("__n", pairs.alias("p")).select("p.column_name", "p.blank_rows", F.round(F.try_divide(F.col("p.blank_rows"), F.col("__n")), 6).alias("blank_rate"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is not null and has no parent."""
    keys = parent.select(F.col(parent_key).alias("__k")).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__k"), "left_anti")


def report(counts: dict[str, DataFrame]) -> DataFrame:
    """(``check_name``, ``violations``) of several checks, each one aggregate."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations") for name, df in counts.items()]
    return reduce(DataFrame.unionByName, rows)


def pinned(counts: dict[str, tuple[int, DataFrame]]) -> DataFrame:
    """(``pinned``, ``expected``, ``found``, ``holds``) of one-row tables of ``found``, each with the count it must have."""
    rows = [df.select(F.lit(name).alias("pinned"), F.lit(n).alias("expected"), "found", (F.col("found") == n).alias("holds")) for name, (n, df) in counts.items()]
    return reduce(DataFrame.unionByName, rows)


def status_class(status: Column) -> Column:
    """Class of an answer's status: reachable, access_controlled, http_error, or network_error where there is none."""
    held = F.when(status.between(200, 399), "reachable").when(status.isin(401, 403, 429), "access_controlled").otherwise("http_error")
    return F.when(status.isNull(), "network_error").otherwise(held)
