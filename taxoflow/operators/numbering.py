"""Row numbers over a whole table without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoflow.session import checkpointed, parallelism


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order given, which should settle all ties.

    Rows are sorted in ranges; a number is the place within a range plus the rows of the ranges before, of which
    there are as many as shuffle partitions. Their counts are all that is gathered.
    """
    spread = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    # The upper bits of the id are the partition, the lower 33 the place in it; the checkpoint keeps both as they are.
    held = checkpointed(spread.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return held.withColumn("__part", part).join(offsets, "__part").withColumn(name, F.col("__before") + place + 1).drop("__part", "__before", "__id")


def competition_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ranks of the value from the greatest on, equal values sharing the first of their places.

    Rows are counted by value; the values are numbered in ranges, with the rows of the values before added up.
    """
    counts = numbered(df.groupBy(value).agg(F.count("*").alias("__c")), [F.desc(value)], "__at")
    part = F.floor(F.col("__at") / 10_000)
    within = F.coalesce(F.sum("__c").over(Window.partitionBy(part).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy(part.alias("__p")).agg(F.sum("__c").alias("__s"))
    before = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    ranks = counts.withColumn("__w", within).withColumn("__p", part).join(before, "__p").select(F.col(value).alias("__v"), (F.col("__b") + F.col("__w") + 1).cast("long").alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")
