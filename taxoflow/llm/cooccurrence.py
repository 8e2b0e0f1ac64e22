"""Items that appear together in a basket, and how far beyond chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a basket that one row holds while pairs are emitted; larger baskets are cut into blocks.
BLOCK = 256


def _pairs(left: Column, right: Column | None = None) -> Column:
    """Array of ordered pairs: within one array of items, or across two disjoint ones."""

    def pair(x: Column, y: Column) -> Column:
        return F.struct(F.least(x, y).alias("item_a"), F.greatest(x, y).alias("item_b"))

    if right is None:
        return F.flatten(F.transform(left, lambda x: F.transform(F.filter(left, lambda y: y > x), lambda y: pair(x, y))))
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: pair(x, y))))


def cooccurrence(df: DataFrame, basket: str, item: str, scope: str | None = None, min_count: int = 1) -> DataFrame:
    """Every pair of items with the number of baskets that hold both, by scope.

    Columns: ``scope``, ``item_a`` < ``item_b``, ``together`` (baskets holding both), ``n_a``, ``n_b``,
    ``baskets`` (distinct baskets of the scope, those without any item included), ``lift`` and ``pmi``
    (natural logarithm). An item counts once per basket. Items held by fewer than ``min_count`` baskets
    cannot reach that count in a pair, so they are left out before pairs are emitted; pairs below it are left
    out of the result.

    Null items never count, a null basket is no basket, a null scope is a scope of its own; repeated rows
    change nothing; an empty table gives an empty result; other columns are not read.

    Baskets of more than ``BLOCK`` items are cut into blocks by the items' hash, and every pair of blocks is
    a row of its own, so that a basket holding a large part of all rows is spread over all tasks. Pairs are
    summed map-side before they are shuffled.
    """
    rows = df.select((F.lit("") if scope is None else F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit(""))).alias("__s"), F.col(basket).alias("__b"), F.col(item).alias("__i")).where("__b IS NOT NULL")
    totals = rows.select("__s", "__b").distinct().groupBy("__s").agg(F.count("*").alias("baskets"))
    held = rows.where("__i IS NOT NULL").distinct()
    marginals = held.groupBy("__s", "__i").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    kept = held.join(marginals.select("__s", "__i"), ["__s", "__i"], "left_semi") if min_count > 1 else held
    blocks = kept.groupBy("__s", "__b").agg(F.count("*").alias("__n")).where(F.col("__n") > BLOCK)
    blocks = blocks.select("__s", "__b", F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks"))
    cut = kept.join(blocks, ["__s", "__b"], "left").withColumn("__k", F.coalesce(F.pmod(F.xxhash64("__i"), F.col("__blocks")).cast("int"), F.lit(0)))
    lists = cut.groupBy("__s", "__b", "__k", "__blocks").agg(F.collect_list("__i").alias("__items"))
    within = lists.where(F.size("__items") > 1).select("__s", F.explode(_pairs(F.col("__items"))).alias("p"))
    # Every block goes to all pairs of blocks it is in, so that a pair is a key of its own before any join.
    one = lists.where("__k < __blocks - 1").select("__s", "__b", F.col("__k").alias("__low"), "__items", F.explode(F.expr("sequence(__k + 1, __blocks - 1)")).alias("__high"))
    two = lists.where("__blocks IS NOT NULL AND __k > 0").select("__s", "__b", F.col("__k").alias("__high"), F.col("__items").alias("__items2"), F.explode(F.expr("sequence(0, __k - 1)")).alias("__low"))
    across = one.join(two, ["__s", "__b", "__low", "__high"])
    pairs = within.unionByName(across.select("__s", F.explode(_pairs(F.col("__items"), F.col("__items2"))).alias("p")))
    counts = pairs.groupBy("__s", "p.item_a", "p.item_b").agg(F.count("*").alias("together")).where(F.col("together") >= min_count)
    out = (
        counts.join(marginals.select("__s", F.col("__i").alias("item_a"), F.col("n").alias("n_a")), ["__s", "item_a"])
        .join(marginals.select("__s", F.col("__i").alias("item_b"), F.col("n").alias("n_b")), ["__s", "item_b"])
        .join(totals, "__s")
    )
    lift = F.col("together").cast("double") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select(
        F.when(F.col("__s") != "", F.substring("__s", 2, 1 << 30)).alias("scope"), "item_a", "item_b", "together", "n_a", "n_b", "baskets", lift.alias("lift"), F.log(lift).alias("pmi")
    )


def beyond_chance(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs at least ``times`` as frequent as their items' own frequencies would give, in exact integers."""
    exact = "decimal(38,0)"
    return pairs.where(F.col("together").cast(exact) * F.col("baskets") >= F.lit(times).cast(exact) * F.col("n_a") * F.col("n_b"))
