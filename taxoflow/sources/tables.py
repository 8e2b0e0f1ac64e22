"""Parquet tables of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root``, one Parquet file or folder per table."""
    return spark.read.parquet(f"{root}/{name}.parquet")
