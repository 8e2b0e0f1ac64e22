"""Windowed counts; the same plan runs over a table and, with a watermark, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(df: DataFrame, time: str, keys: list[str], width: str, lateness: str | None = None) -> DataFrame:
    """(``start``, keys, ``n``) per window of ``width``; over a stream, rows later than ``lateness`` are dropped.

    Rows without a time are in no window. State is bounded by the windows that the watermark keeps open.
    """
    if df.schema[time].dataType.typeName() == "timestamp_ntz":
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    if df.isStreaming and lateness is not None:
        df = df.withWatermark(time, lateness)
    return df.where(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
