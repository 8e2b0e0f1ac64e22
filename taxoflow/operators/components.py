"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from taxoflow.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to the smallest of all.

    One shuffle by node: within a node the neighbours come in order, so that the first is the smallest and
    repeated ones follow each other; no node's neighbours are held together.
    """
    toward = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else F.array(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = edges.select(F.inline(toward))
    order = Window.partitionBy("src").orderBy("dst")
    known = both.withColumns({"least": F.first("dst").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "before": F.lag("dst").over(order)})
    fresh = known.where("before IS NULL OR before <> dst").withColumn("m", F.least("src", "least"))
    if large:
        return fresh.where("dst > src AND dst <> m").select(F.col("m").alias("src"), "dst")
    linked = fresh.select(F.inline(F.when(F.col("before").isNull(), F.array(F.struct("m", "dst"), F.struct("m", F.col("src").alias("dst")))).otherwise(F.array(F.struct("m", "dst")))))
    return linked.where("m <> dst").select(F.col("m").alias("src"), "dst")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(``node``, ``component``) of every node of the edges, the component being its smallest node.

    Each round links neighbours to the smallest node around by a large and a small star; a logarithmic number
    of rounds leaves stars around the components' smallest nodes. A round is one job, which cuts the lineage
    and counts what it leaves. Loops give a component of one node; edges with a null end are left out; an
    empty table gives an empty result.
    """
    named = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
    named = checkpointed(named)
    loops = named.where("src = dst").select(F.col("src").alias("node")).distinct()
    stars, before = named.where("src <> dst"), None
    for _ in range(max_rounds):
        seen = Observation()
        stars = checkpointed(_star(_star(stars, large=True), large=False), seen, n=F.count("*"), mark=F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")))
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = stars.select(F.col("dst").alias("node"), F.col("src").alias("component")).unionByName(stars.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct())
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
