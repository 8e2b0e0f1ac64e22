"""Nearest neighbours of every vector, by graph search in shards of the collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoflow.llm.vamana import SEARCH_BEAM, TOGETHER, Graph, centroids
from taxoflow.session import checkpointed

#: Vectors of one shard's graph, and most cells.
SHARD, CELLS = 4096, 1 << 14
#: Vectors that the centroids are fitted on: so many at least, or so many for each centroid.
SAMPLE, PER_CELL = 20_000, 16
#: Queries whose nearest are looked up among all vectors, and the share of those that the searched cells must hold.
TRIED, RECALL = 1024, 0.998
#: Similarities that a worker holds at once; cosines that are as good as tied.
HELD, TIED = 1 << 22, 2e-6


def usable(vector: Column, size: int) -> Column:
    """True for vectors of ``size`` finite numbers that are not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest_of(size: int, k: int, names: np.ndarray, queries: np.ndarray, centre: np.ndarray):
    """Per partition the k nearest of every tried query, by comparison with all, and the cells that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.full((len(names), k), -9, dtype=np.float32)
        cell = np.zeros((len(names), k), dtype=np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), size).astype(np.float32)
            home = (x @ centre.T).argmax(axis=1).astype(np.int32)
            value = np.where(names[:, None] == batch.column("c").to_numpy()[None, :], -9, queries @ x.T)
            near, cell = np.concatenate([near, value], axis=1), np.concatenate([cell, np.broadcast_to(home, value.shape)], axis=1)
            keep = np.argpartition(-near, k - 1, axis=1)[:, :k]
            near, cell = np.take_along_axis(near, keep, 1), np.take_along_axis(cell, keep, 1)
        q, j = np.nonzero(near > -9)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(cell[q, j]), pa.array(near[q, j].astype(np.float64))], names=["q", "cell", "near"])

    return run


def _gap(classes: DataFrame, size: int, k: int, least: float, centre: np.ndarray) -> float:
    """How much less similar than its nearest centroid another may be to a query, so that the cells up to there hold
    the share ``RECALL`` of the tried queries' nearest."""
    if len(centre) == 1:
        return 0.0
    tried = classes.where("asked").orderBy(F.xxhash64("c", F.lit(2)), "c").limit(TRIED).select("c", "v").toArrow()
    if not tried.num_rows:
        return 0.0
    queries = _matrix(tried.column("v").combine_chunks(), size).astype(np.float32)
    rows = classes.select("c", "v").mapInArrow(_nearest_of(size, k, tried.column("c").to_numpy(), queries, centre), "q int, cell int, near double")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near")))).where((F.col("n") <= k) & (F.col("near") >= least))
    found = rows.select("q", "cell").toArrow()
    if not found.num_rows:
        return 0.0
    near = queries @ centre.T
    q = found.column("q").to_numpy()
    gaps = np.sort(near[q].max(axis=1) - near[q, found.column("cell").to_numpy()])
    return float(gaps[int(np.ceil(RECALL * len(gaps))) - 1]) + 1e-6


def _route(centre: np.ndarray, size: int, splits: np.ndarray, gap: float):
    """Rows for the index (kind 0, one shard) and for the search (kind 1, every shard of the cells within the gap)."""
    first = np.concatenate([[0], np.cumsum(splits)])

    def routed(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = _matrix(batch.column("v"), size).astype(np.float32) @ centre.T
        home = near.argmax(axis=1)
        spread = batch.column("salt").to_numpy(zero_copy_only=False) % splits[home]
        asked = batch.column("asked").to_numpy(zero_copy_only=False)
        within = (near >= near.max(axis=1, keepdims=True) - gap) & asked[:, None]
        row, cell = np.nonzero(within)
        many = splits[cell]
        again = np.repeat(np.arange(len(row)), many)
        turn = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
        rows = np.concatenate([np.arange(len(home)), row[again]])
        shard = np.concatenate([first[home] + spread, first[cell[again]] + turn])
        kind = np.concatenate([np.zeros(len(home), np.int8), np.ones(len(again), np.int8)])
        at = pa.array(rows)
        # Only stored rows need the name of their class.
        name = pa.concat_arrays([batch.column("name"), pa.nulls(len(again), batch.column("name").type)])
        return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(kind), batch.column("c").take(at), name, batch.column("v").take(at)], names=["shard", "kind", "c", "name", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // len(centre))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield routed(batch.slice(at, step))

    return run


def _search(size: int, k: int, least: float, beam: int):
    """Over rows sorted by shard and kind: build the shard's graph, then stream its queries through it."""

    def tied(exact: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, nodes and cosines by comparison with the whole shard: all at least as near as the (k + 1)-th."""
        parts, step = [], max(1, HELD // len(exact))
        for at in range(0, len(x), step):
            cosine = np.round(x[at : at + step] @ exact.T, 6)
            last = np.partition(cosine, -min(k + 1, len(exact)), axis=1)[:, -min(k + 1, len(exact))]
            q, node = np.nonzero((cosine >= last[:, None]) & (cosine >= least))
            parts.append((q + at, node, cosine[q, node]))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def answer(graph: Graph, exact: np.ndarray, ids: np.ndarray, place: np.ndarray, names: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        # A query that the shard holds sets out from its own node as well.
        at = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
        entry = np.where(ids[at] == names, at, -1)
        width = min(max(beam, 2 * k), len(ids))
        found, near = graph.search(x.astype(np.float32), width, entry)
        # Where the beam is full of what is as near as the (k + 1)-th, there may be more of it.
        full = (found[:, -1] >= 0) & (near[:, -1] >= np.maximum(near[:, min(k, width - 1)], least) - TIED) if width < len(ids) else np.zeros(len(x), dtype=bool)
        q, j = np.nonzero((found >= 0) & (near >= least - 1e-4) & ~full[:, None])
        nodes = found[q, j]
        cosine = np.round(np.einsum("md,md->m", x[q], exact[nodes]), 6)
        if full.any():
            more = tied(exact, x[full])
            q, nodes, cosine = np.concatenate([q, np.flatnonzero(full)[more[0]]]), np.concatenate([nodes, more[1]]), np.concatenate([cosine, more[2]])
        fine = (names[q] != ids[nodes]) & (cosine >= least)
        q, nodes, cosine = q[fine], nodes[fine], cosine[fine]
        # The nearest k, ties by the class's smallest id: no other class can hold one of the nearest k ids.
        order = np.lexsort((place[nodes], -cosine, q))
        q, nodes, cosine = q[order], nodes[order], cosine[order]
        fine = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        if not fine.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(names[q[fine]]), pa.array(ids[nodes[fine]]), pa.array(cosine[fine])], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, firsts, vectors, graph = None, [], [], [], None
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            key = shards.astype(np.int64) * 2 + kinds
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for low, high in zip(cuts, [*cuts[1:], len(key)]):
                if shards[low] != shard:
                    shard, ids, firsts, vectors, graph = shards[low], [], [], [], None
                part = batch.slice(int(low), int(high - low))
                names = part.column("c").to_numpy()
                x = _matrix(part.column("v"), size)
                if kinds[low] == 0:
                    ids.append(names)
                    firsts.append(part.column("name"))
                    vectors.append(x)
                    continue
                if graph is None:
                    if not ids:
                        continue
                    known = np.concatenate(ids)
                    order = np.argsort(known)
                    exact, known = np.concatenate(vectors)[order], known[order]
                    place = np.empty(len(known), dtype=np.int64)
                    place[pc.sort_indices(pa.concat_arrays(firsts).take(pa.array(order))).to_numpy()] = np.arange(len(known))
                    graph, vectors, firsts = Graph(exact), [], []
                for at in range(0, len(names), TOGETHER):
                    out = answer(graph, exact, known, place, names[at : at + TOGETHER], x[at : at + TOGETHER])
                    if out is not None:
                        yield out

    return run


def nearest(df: DataFrame, id_: str, vector: str, size: int, k: int, least: float = -1.0, beam: int = SEARCH_BEAM, asked: Column | None = None) -> DataFrame:
    """(``id``, ``neighbour``, ``cosine``, ``place``): the ``k`` most similar other ids of every id asked for.

    Order is by cosine, rounded to 6 decimals, descending, then id ascending; ``least`` leaves out less
    similar ones. Vectors that are null, of another length, all zero or not finite take no part, nor do null
    ids; an id counts once, with the greatest of its vectors; an empty table gives an empty result. Ids of
    equal vectors are one node of the index and are told apart afterwards, of each such class at most k + 1
    as neighbours, which are all that can be among the nearest k: any number of copies costs no more.

    Every vector is indexed in the shard of its nearest centroid. A query is searched for in the shards of the
    cells whose centroids are almost as similar to it as the nearest: by a gap that is measured on ``TRIED``
    queries, which are compared with all vectors, so that the cells within it hold the share ``RECALL`` of their
    nearest (of ``least`` or more). A query well inside its cell costs one search, one at a border several,
    whatever the number of cells. The centroids are fitted on the vectors of smallest hash, ``SAMPLE`` or
    ``PER_CELL`` for each, at most ``CELLS`` of them for ``SHARD`` vectors each; a cell with more than twice as
    many is cut by hash into several shards, all of which are searched. A shard holds one graph; its queries
    stream through it in batches. Where ties fill the beam, the whole shard is compared.
    """
    rows = df.select(F.col(id_).alias("id"), F.col(vector).cast("array<float>").alias("v"), (F.lit(True) if asked is None else asked).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"), size)).groupBy("id").agg(F.max(F.struct("v", "asked")).alias("r"))
    rows = rows.select("id", F.col("r.v").alias("v"), F.col("r.asked").alias("asked"))
    digest = F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))).cast("binary"))
    members = checkpointed(rows.withColumn("h", digest))
    classes = members.groupBy("h").agg(F.any_value("v").alias("v"), F.bool_or("asked").alias("asked"), F.min("id").alias("name"))
    classes = checkpointed(classes.select(F.conv(F.substring("h", 1, 15), 16, 10).cast("long").alias("c"), "h", "v", "asked", "name"))
    total = classes.count()
    if not total:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("place")).limit(0)
    cells = min(CELLS, -(-total // SHARD))
    sample = classes.orderBy(F.xxhash64("c"), "c").limit(max(SAMPLE, PER_CELL * cells)).select("v").toArrow()
    fit = _matrix(sample.column("v").combine_chunks(), size).astype(np.float32)
    centre = centroids(fit, min(cells, len(fit)))
    flat = classes.select("c", "v", F.pmod(F.xxhash64("c", F.lit(1)), F.lit(1 << 30)).alias("salt"), "asked", "name")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // len(centre))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            if batch.num_rows:
                home = (_matrix(batch.column("v"), size).astype(np.float32) @ centre.T).argmax(axis=1)
                cell, n = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    splits = np.ones(len(centre), dtype=np.int64)
    for r in flat.mapInArrow(homes, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        splits[r["cell"]] = max(1, -(-r["n"] // (2 * SHARD)))
    gap = _gap(classes, size, k, least, centre)
    name = classes.schema["name"].dataType.simpleString()
    routed = flat.mapInArrow(_route(centre, size, splits, gap), f"shard int, kind tinyint, c long, name {name}, v array<float>")
    spread = routed.repartitionById(int(splits.sum()), "shard").sortWithinPartitions("shard", "kind")
    links = spread.mapInArrow(_search(size, k, least, beam), "a long, b long, cosine double")
    # Of each class the k + 1 smallest ids; the rank is limited before the shuffle as well as after it.
    small = members.withColumn("n", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("n") <= k + 1)
    names = classes.select("c", "h")
    small = small.join(names, "h").select(F.col("c").alias("b"), F.col("id").alias("neighbour"))
    own = names.select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("cosine"))
    near = links.unionByName(own).join(small, "b")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k + 1)
    lists = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("near"))
    answers = members.where("asked").join(names, "h").select("id", F.col("c").alias("a")).join(lists, "a")
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    out = answers.select("id", F.posexplode(others).alias("place", "x"))
    return out.select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("place") + 1).alias("place")).where(F.col("cosine") >= least)


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Each pair of ids of which one is among the other's neighbours, once: (``id_a`` < ``id_b``)."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
