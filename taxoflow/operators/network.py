"""Measures of undirected weighted graphs given as edges (``src`` < ``dst``, ``weight``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from taxoflow.session import checkpointed

#: Most edges that a kernel working on one whole graph accepts; beyond it an error is raised.
KERNEL_EDGES = 2_000_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: (``node``, ``other``, ``weight``)."""
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight")
    return one.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))


def projection(df: DataFrame, basket: str, item: str) -> DataFrame:
    """One-mode projection: pairs of items with ``together``, ``n_a``, ``n_b``, Jaccard and association strength.

    Items are distinct per basket; pairs come from a join of the baskets with themselves, which AQE splits
    where a basket is hot, and are summed map-side.
    """
    held = df.select(F.col(basket).alias("b"), F.col(item).alias("i")).dropna().distinct()
    marginals = held.groupBy("i").agg(F.count("*").alias("n"))
    pairs = held.select("b", F.col("i").alias("src")).join(held.select("b", F.col("i").alias("dst")), "b").where("src < dst")
    counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("together"))
    out = counts.join(marginals.select(F.col("i").alias("src"), F.col("n").alias("n_a")), "src").join(marginals.select(F.col("i").alias("dst"), F.col("n").alias("n_b")), "dst")
    jaccard = F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together"))
    association = F.col("together") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("src", "dst", "together", "n_a", "n_b", jaccard.alias("jaccard"), association.alias("association"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``node``, ``degree``, ``strength``) of every node, isolated ones with zeros."""
    counted = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def domain_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node of ``nodes`` (``node``, ``domain``): degree, strength, neighbours in other domains, their share, domains reached."""
    other = nodes.select(F.col("node").alias("other"), F.col("domain").alias("other_domain"))
    seen = both_ways(edges).join(other, "other").join(nodes, "node")
    sums = seen.groupBy("node").agg(
        F.count("*").alias("degree"), F.sum("weight").alias("strength"), F.count_if(F.col("domain") != F.col("other_domain")).alias("cross"), F.count_distinct("other_domain").alias("reached")
    )
    zero = lambda c, v=0: F.coalesce(c, F.lit(v)).alias(c)
    out = nodes.join(sums, "node", "left").select("node", "domain", zero("degree"), zero("strength", 0.0), zero("cross"), zero("reached"))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("cross"), F.col("degree")), F.lit(0.0)))


def domain_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``pair``, ``edges``): edges by the sorted domains of their ends, and whether they cross."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("domain").alias("da")), nodes.select(F.col("node").alias("dst"), F.col("domain").alias("db"))
    named = edges.join(a, "src").join(b, "dst").withColumn("pair", F.concat_ws("-", F.least("da", "db"), F.greatest("da", "db")))
    return named.groupBy("pair").agg(F.count("*").alias("edges"), F.bool_or(F.col("da") != F.col("db")).alias("crosses"))


def modularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: weighted modularity of the partition ``domain``."""
    total = edges.agg(F.sum("weight").alias("m"))
    a, b = nodes.select(F.col("node").alias("src"), F.col("domain").alias("da")), nodes.select(F.col("node").alias("dst"), F.col("domain").alias("db"))
    inner = edges.join(a, "src").join(b, "dst").where("da = db").groupBy(F.col("da").alias("domain")).agg(F.sum("weight").alias("inside"))
    around = both_ways(edges).join(nodes, "node").groupBy("domain").agg(F.sum("weight").alias("ends"))
    parts = around.join(inner, "domain", "left").join(total)
    term = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)
    return parts.agg(F.sum(term).alias("modularity"))


def nominal_assortativity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: (trace - sum of a b) / (1 - sum of a b) of the mixing matrix of domains."""
    other = nodes.select(F.col("node").alias("other"), F.col("domain").alias("db"))
    ends = both_ways(edges).join(nodes, "node").join(other, "other").groupBy("domain", "db").agg(F.count("*").alias("n"))
    total = ends.agg(F.sum("n").alias("all"))
    mixed = ends.join(total).select("domain", "db", (F.col("n") / F.col("all")).alias("e"))
    a = mixed.groupBy("domain").agg(F.sum("e").alias("a"), F.sum(F.when(F.col("domain") == F.col("db"), F.col("e")).otherwise(0.0)).alias("d"))
    sums = a.agg(F.sum("d").alias("trace"), F.sum(F.col("a") * F.col("a")).alias("ab"))
    return sums.select(((F.col("trace") - F.col("ab")) / (1 - F.col("ab"))).alias("assortativity"))


def degree_assortativity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: Pearson correlation of the strengths at both ends of all edges, each taken in both directions."""
    d = degrees(nodes, edges)
    ends = both_ways(edges).join(d.select("node", F.col("strength").alias("x")), "node").join(d.select(F.col("node").alias("other"), F.col("strength").alias("y")), "other")
    return ends.agg(F.corr("x", "y").alias("assortativity"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``node``, ``triangles``, ``clustering``) by weight: mean cube root of the products of the scaled weights of its triangles."""
    top = edges.agg(F.max("weight").alias("top"))
    # Every edge points from the end of lower degree, so that a hub opens no wedges but those among larger hubs.
    d = both_ways(edges).groupBy("node").agg(F.count("*").alias("d"))
    end = lambda c: d.select(F.col("node").alias(c), F.struct("d", "node").alias(f"{c}_end"))
    e = edges.join(end("src"), "src").join(end("dst"), "dst").join(top)
    e = e.select(F.least("src_end", "dst_end").alias("low"), F.greatest("src_end", "dst_end").alias("high"), (F.col("weight") / F.col("top")).alias("w"))
    ab, ac, bc = (e.select(F.col("low").alias(x), F.col("high").alias(y), F.col("w").alias(w)) for x, y, w in (("a", "b", "w1"), ("a", "c", "w2"), ("b", "c", "w3")))
    found = ab.join(ac, "a").where("b < c").join(bc, ["b", "c"]).withColumn("g", F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")))
    found = found.select(*[F.col(f"{x}.node").alias(x) for x in "abc"], "g")
    per = found.select(F.explode(F.array("a", "b", "c")).alias("node"), "g").groupBy("node").agg(F.count("*").alias("triangles"), F.sum("g").alias("g"))
    out = degrees(nodes, edges).join(per, "node", "left")
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return out.select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce(F.try_divide("g", possible), F.lit(0.0)).alias("clustering"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(``node``, ``rank``) after a number of power iterations by weight; nodes without edges spread their rank evenly."""
    links = both_ways(edges)
    sums = links.groupBy("node").agg(F.sum("weight").alias("out"))
    links = checkpointed(links.join(sums, "node").select("node", "other", (F.col("weight") / F.col("out")).alias("p")))
    base = nodes.select("node").join(sums, "node", "left").select("node", F.col("out").isNull().alias("idle"))
    n = base.agg(F.count("*").alias("n"))
    base = checkpointed(base.join(n))
    ranks = base.select("node", "idle", (1 / F.col("n")).alias("rank"))
    row = base.agg(F.sum(F.when(F.col("idle"), 1 / F.col("n")).otherwise(0.0)).alias("lost")).first()
    for _ in range(rounds):
        # One job a round: it cuts the lineage and sums the rank of the idle nodes for the next one.
        lost = F.lit(row["lost"] or 0.0)
        given = links.join(ranks.select("node", "rank"), "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("given"))
        fresh = base.join(given, "node", "left").select("node", "idle", ((1 - damping) / F.col("n") + damping * (F.coalesce("given", F.lit(0.0)) + lost / F.col("n"))).alias("rank"))
        seen = Observation()
        ranks = checkpointed(fresh, seen, lost=F.sum(F.when(F.col("idle"), F.col("rank")).otherwise(0.0)))
        row = seen.get
    return ranks.select("node", "rank")


def _adjacency(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, row starts, neighbours and weights of a graph of bounded size, on the driver."""
    pdf = edges.select("src", "dst", "weight").limit(KERNEL_EDGES + 1).toPandas()
    if len(pdf) > KERNEL_EDGES:
        raise ValueError(f"the graph has more than {KERNEL_EDGES} edges")
    names, at = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
    half = len(pdf)
    a, b = np.concatenate([at[:half], at[half:]]), np.concatenate([at[half:], at[:half]])
    w = np.concatenate([pdf["weight"], pdf["weight"]])
    order = np.lexsort((b, a))
    return names, np.searchsorted(a[order], np.arange(len(names) + 1)), b[order], w[order]


def betweenness(edges: DataFrame) -> DataFrame:
    """(``node``, ``betweenness``): exact shortest-path betweenness without weights, over (n - 1)(n - 2) / 2 pairs.

    One search per source, spread over the tasks; each adds up its sources' dependencies and the sums are
    added by node. The graph, of at most ``KERNEL_EDGES`` edges, goes to every task.
    """
    names, start, other, _ = _adjacency(edges)
    spark, n = edges.sparkSession, len(names)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0

    def sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n)
        for batch in batches:
            for s in batch["id"]:
                depth, paths = np.full(n, -1), np.zeros(n)
                depth[s], paths[s], levels, front = 0, 1.0, [], np.array([s])
                while len(front):
                    size = start[front + 1] - start[front]
                    u = np.repeat(front, size)
                    v = other[np.repeat(start[front], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                    new = np.unique(v[depth[v] < 0])
                    depth[new] = depth[s] + len(levels) + 1
                    step = depth[v] == depth[u] + 1
                    np.add.at(paths, v[step], paths[u[step]])
                    levels.append((u[step], v[step]))
                    front = new
                share = np.zeros(n)
                for u, v in reversed(levels):
                    np.add.at(share, u, paths[u] / paths[v] * (1 + share[v]))
                share[s] = 0
                total += share
        held = np.flatnonzero(total)
        yield pd.DataFrame({"i": held, "part": total[held]})

    parts = spark.range(n).repartition(max(1, min(64, n // 16))).mapInPandas(sources, "i long, part double")
    sums = parts.groupBy("i").agg(F.sum("part").alias("s"))
    named = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "node": names}))
    return named.join(sums, "i", "left").select("node", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness"))


def louvain(edges: DataFrame, resolution: float = 1.0, seed: int = 23) -> DataFrame:
    """(``node``, ``community``) by repeated local moves and folding, until modularity gains nothing.

    Works on one graph of at most ``KERNEL_EDGES`` edges. Nodes move in a fixed shuffled order, ties go to the
    smaller community, so results repeat; communities are numbered by their smallest node.
    """
    names, start, other, weight = _adjacency(edges)
    label = np.arange(len(names))
    rng = np.random.default_rng(seed)
    src = np.repeat(np.arange(len(names)), np.diff(start))
    total = weight.sum()
    while len(names):
        n = int(src.max()) + 1
        starts = np.searchsorted(src, np.arange(n + 1))
        k = np.bincount(src, weights=weight, minlength=n)
        at, room, moved_any = np.arange(n), k.copy(), False
        for _ in range(100):
            moved = False
            for i in rng.permutation(n):
                lo, hi = starts[i], starts[i + 1]
                near = other[lo:hi]
                links = {}
                for c, w, j in zip(at[near], weight[lo:hi], near):
                    if j != i:
                        links[c] = links.get(c, 0.0) + w
                own = at[i]
                room[own] -= k[i]
                best, gain = own, links.get(own, 0.0) - resolution * k[i] * room[own] / total
                for c, w in sorted(links.items()):
                    g = w - resolution * k[i] * room[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                at[i] = best
                room[best] += k[i]
                moved |= best != own
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            break
        _, at = np.unique(at, return_inverse=True)
        label = at[label]
        key = at[src].astype(np.int64) * (at.max() + 1) + at[other]
        folded, inverse = np.unique(key, return_inverse=True)
        weight = np.bincount(inverse, weights=weight)
        src, other = folded // (at.max() + 1), folded % (at.max() + 1)
    _, first = np.unique(label, return_index=True)
    order = np.argsort(np.argsort(first))
    return edges.sparkSession.createDataFrame(pd.DataFrame({"node": names, "community": order[label].astype(np.int64)}))


def overview(counts: DataFrame, pairs: DataFrame, per_domain: int, most: int) -> DataFrame:
    """Strongest edges among each domain's most frequent items: ``counts`` (node, domain, n), ``pairs`` (src, dst, weight)."""
    w = Window.partitionBy("domain").orderBy(F.desc("n"), "node")
    chosen = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_domain).select("node")
    inside = pairs.join(chosen.select(F.col("node").alias("src")), "src", "left_semi").join(chosen.select(F.col("node").alias("dst")), "dst", "left_semi")
    return inside.orderBy(F.desc("weight"), "src", "dst").limit(most)
