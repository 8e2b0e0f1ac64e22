"""Exact similarity joins: blocks of queries against blocks of items, by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoflow.functions.vectors import unit

#: Vectors of one block; a task holds one block of queries and one of items.
BLOCK = 2048


def _blocks(df: DataFrame, blocks: int, prefix: str) -> DataFrame:
    packed = df.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(f"{prefix}b"))
    return packed.agg(F.collect_list(F.struct("id", "part", "v")).alias(prefix))


def top_similar(queries: DataFrame, items: DataFrame, id_: str, vector: str, k: int, part: str | None = None, least: float | None = None) -> DataFrame:
    """(``query``, ``item``, ``similarity``, ``rank``): the k most similar items of every query, itself excluded.

    Similarity is the cosine rounded to 6 decimals; order is by similarity descending, then id ascending.
    With ``part`` only items whose part differs from the query's count. ``least`` drops pairs after ranking.
    Null ids and null vectors take no part. Every query block meets every item block once, as a stated query
    set against all rows; each keeps its k best per query, and those are ranked again.
    """
    def prepared(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull())
        return rows.select(F.col(id_).cast("string").alias("id"), (F.lit("") if part is None else F.coalesce(F.col(part).cast("string"), F.lit(""))).alias("part"), unit(F.col(vector)).alias("v"))

    q, i = prepared(queries), prepared(items)
    n = max(1, -(-i.count() // BLOCK))
    m = n if items is queries else max(1, -(-q.count() // BLOCK))
    left = _blocks(q, m, "q").withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = left.join(_blocks(i, n, "i"), "ib").repartition(m * n, "qb", "ib").select("q", "i")
    numeric = queries.schema[id_].dataType.typeName() in ("long", "integer", "short")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c)[row].values for c in ("q", "i")]
                ids = [np.array(s.field("id").to_pylist(), dtype=object) for s in sides]
                parts = [np.array(s.field("part").to_pylist(), dtype=object) for s in sides]
                x, y = (s.field("v").flatten().to_numpy().reshape(len(s), -1) for s in sides)
                sims = np.round(x @ y.T, 6)
                sims[ids[0][:, None] == ids[1][None, :]] = -9
                if part is not None:
                    sims[parts[0][:, None] == parts[1][None, :]] = -9
                keys = np.array([int(v) for v in ids[1]]) if numeric else np.argsort(np.argsort(ids[1].astype(str), kind="stable"), kind="stable")
                out = []
                for a in range(len(x)):
                    near = np.flatnonzero(sims[a] >= np.partition(sims[a], -min(k, len(y)))[-min(k, len(y))])
                    near = near[np.lexsort((keys[near], -sims[a][near]))][:k]
                    out += [(ids[0][a], ids[1][b], float(sims[a][b])) for b in near if sims[a][b] > -9]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["query", "item", "similarity"])

    kind = queries.schema[id_].dataType.simpleString()
    found = pairs.mapInArrow(ranked, "query string, item string, similarity double")
    found = found.select(F.col("query").cast(kind).alias("query"), F.col("item").cast(kind).alias("item"), "similarity")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "item")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out if least is None else out.where(F.col("similarity") >= least)


def union_edges(links: DataFrame) -> DataFrame:
    """Undirected edges ``src`` < ``dst`` of pairs that either end selects, with the similarity as ``weight``."""
    return links.select(F.least("query", "item").alias("src"), F.greatest("query", "item").alias("dst"), F.col("similarity").alias("weight")).distinct()


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, ``centroid``): mean vector of each group, dimension by dimension, brought to unit length."""
    flat = df.select(group, F.posexplode(vector).alias("d", "x"))
    means = flat.groupBy(group, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("xs"))
    return listed.select(group, unit(F.transform("xs", lambda s: s["x"])).alias("centroid"))
