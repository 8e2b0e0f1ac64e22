"""Bringing records of several sources together, with precedence and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoflow.functions.text import filled


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row per key by the order given; rank-limited before the shuffle where keys are hot."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overlay(base: DataFrame, other: DataFrame, key: str, fields: list[str], names: tuple[str, str, str]) -> DataFrame:
    """Full outer reconciliation: the base row, or else the other's; the other's non-blank fields prevail.

    ``coverage`` says by ``names`` whether both, the base alone or the other alone held the key.
    """
    a, b = base.alias("a"), other.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    columns = [F.coalesce(filled(F.col(f"b.{f}")), F.col(f"a.{f}")).alias(f) for f in fields]
    rest = [c for c in base.columns if c != key and c not in fields]
    kept = [F.when(F.col(f"a.{key}").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in rest]
    label = F.when(F.col(f"b.{key}").isNull(), names[1]).when(F.col(f"a.{key}").isNull(), names[2]).otherwise(names[0])
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *kept, *columns, label.alias("coverage"))


def longest(x: Column) -> Column:
    """Aggregate: the longest text that is not blank, of equally long ones the greatest."""
    return F.max(F.when(filled(x).isNotNull(), F.struct(F.length(filled(x)).alias("n"), filled(x).alias("t"))))["t"]


def distinct_joined(x: Column, separator: str) -> Column:
    """Aggregate: distinct non-blank texts, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(filled(x))), separator)


def packed(df: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns kept, all others as one JSON text; nulls are left out of it."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*rest)).alias(name))


def exploded_ids(df: DataFrame, ids: str, separator: str, name: str) -> DataFrame:
    """One row per distinct id of a separated list; rows without ids are left out."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.col(ids), separator), lambda x: F.trim(x)), lambda x: x != ""))
    return df.withColumn(name, F.explode(parts))
