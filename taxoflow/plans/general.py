"""Queries of problem 6: dates of the case table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxoflow.operators.timestamps import normalise_timestamps
from taxoflow.sources import table


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Every value of ``date`` and ``source_verified_at`` that names a full day, as an instant in UTC."""
    return normalise_timestamps(
        table(spark, root, "case_verification_table"),
        key="row_id",
        fields=["date", "source_verified_at"],
        desks=table(spark, root, "verification_desks"),
        desk_key="desk_id",
        labels=table(spark, root, "zone_labels"),
    )


QUERIES = {"p6_found": p6_found}
ORACLES: dict[str, str] = {}
