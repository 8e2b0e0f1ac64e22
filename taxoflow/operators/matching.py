"""Links between texts by cosine of term weights, exact above a least similarity and without comparing all pairs."""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxoflow.session import checkpointed, parallelism, scratch, written

#: Rows of one block and of one tile, and groups that terms are hashed into for the bound.
BLOCK, TILE, GROUPS = 2048, 32768, 512


def grams(words: Column, stop: list[str]) -> Column:
    """Words that are no stop words, and their pairs of neighbours joined by a blank."""
    kept = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
    pairs = F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(kept, F.when(F.size(kept) > 1, pairs).otherwise(F.array().cast("array<string>")))


def weights(df: DataFrame, id_: str, words: Column, most: float = 1.0, least: int = 1, log_tf: bool = True, features: int | None = None) -> DataFrame:
    """(id, ``term``, ``weight``, ``df``): term weights of unit length per row.

    With ``log_tf`` the weight is (1 + ln tf)(1 + ln((1 + N) / (1 + df))), else tf (1 + ln((1 + N) / (1 + df))), before rows are
    brought to unit length. Terms of fewer than ``least`` rows or of more than the share ``most`` are left out;
    ``features`` keeps so many terms of the highest total frequency, of equal ones the first in order.
    """
    terms = df.select(id_, F.explode(words).alias("term")).groupBy(id_, "term").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("n"))
    spread = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).join(total).where((F.col("df") >= least) & (F.col("df") <= most * F.col("n")))
    if features is not None:
        spread = spread.orderBy(F.desc("all"), "term").limit(features)
    tf = 1 + F.log("tf") if log_tf else F.col("tf")
    # A scan says nothing of how many terms its texts have: without the hint, terms of a small table of cards are broadcast.
    raw = terms.hint("merge").join(spread.select("term", "df", "n"), "term").select(id_, "term", "df", (tf * (1 + F.log((1 + F.col("n")) / (1 + F.col("df"))))).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_)))
    return raw.select(id_, "term", (F.col("w") / length).alias("weight"), "df")


def _blocks(w: DataFrame, id_: str) -> tuple[str, int]:
    """Folder and number of the blocks of the rows of ``weights``: ids, and hashes and weights of their terms. A block is
    a folder of its own, so that tasks read those that they need and nothing is shuffled more than once."""
    spark = w.sparkSession
    terms = F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("weight").alias("w")))
    rows = written(w.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(terms.alias("x")).select("id", F.col("x.t").alias("t"), F.col("x.w").alias("w")))
    n = max(1, -(-rows.count() // BLOCK))
    path = scratch(spark, "blocks")
    rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartition("b").write.option("compression", "zstd").partitionBy("b").parquet(path)
    return path, n


def cosine_pairs(left: DataFrame, right: DataFrame, id_: str, least: float, k: int | None = None) -> DataFrame:
    """(id, ``other``, ``score``) of all pairs of a left and a right row whose cosine, rounded to 6 decimals, is ``least`` or more;
    with ``k`` only the k of highest score of every left row, of equal ones the smallest.

    Rows have ``weights``. They are written once, in blocks; a task is a pair of tiles, which are ranges of blocks, or where left
    and right are one table, half of these pairs. Its blocks meet one another: terms
    are hashed into ``GROUPS``; two rows' cosine is at most the product of their lengths summed over the groups,
    which one matrix product gives for all pairs; those for which it reaches ``least``, and the k-th best score that the task has
    found, are compared term by term, and k rows are handed on. So the result is exact, and a pair of rows costs
    ``GROUPS`` multiplications. Terms are told apart by 64-bit hashes.
    """
    spark, kind, same = left.sparkSession, left.schema[id_].dataType.simpleString(), left is right
    (there, n) = _blocks(right, id_)
    (here, m) = (there, n) if same else _blocks(left, id_)
    size = lambda blocks: min(TILE // BLOCK, max(1, blocks // (2 * math.isqrt(parallelism(spark)))))
    s, z = size(m), size(n)
    p, q = -(-m // s), -(-n // z)

    class Block:
        def __init__(self, folder: str, number: int) -> None:
            files, path = pa.fs.FileSystem.from_uri(folder)
            where = f"{path}/b={number}"
            if files.get_file_info(where).type == pa.fs.FileType.NotFound:
                self.names = []
                return
            rows = pq.read_table(where, filesystem=files, columns=["id", "t", "w"], partitioning=None).combine_chunks()
            lists, weight = rows.column("t").combine_chunks(), rows.column("w").combine_chunks()
            self.ids, self.names = rows.column("id").combine_chunks().type, rows.column("id").to_pylist()
            self.start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            self.t, self.w = lists.flatten().to_numpy(), weight.flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(self.start))
            self.u = np.sqrt(np.bincount(row * GROUPS + (self.t >> 20) % GROUPS, weights=self.w * self.w, minlength=len(lists) * GROUPS)).reshape(-1, GROUPS).astype(np.float32)
            # Rows and terms in one sorted key, for the look-up.
            self.terms, number = np.unique(self.t, return_inverse=True)
            key = row * len(self.terms) + number
            order = np.argsort(key)
            self.key, self.value = key[order], self.w[order]
            self.reach: np.ndarray = np.full(len(lists), least)
            self.best: list[list[tuple[float, object]]] = [[] for _ in self.names]

        def keep(self, row: int, score: float, other: object) -> None:
            held = self.best[row]
            if other != self.names[row]:
                insort(held, (-score, other))
                if k is not None and len(held) >= k:
                    del held[k:]
                    self.reach[row] = -held[-1][0]

        def found(self) -> Iterator[pa.RecordBatch]:
            out = [(name, other, -score) for name, best in zip(self.names, self.best) for score, other in best] if self.names else []
            for at in range(0, len(out), 10_000):
                one, other, score = zip(*out[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(one, self.ids), pa.array(other, self.ids), pa.array(score, pa.float64())], names=["id", "other", "score"])

    def meet(a: Block, b: Block, both: bool) -> None:
        if not a.names or not b.names:
            return
        bound = a.u @ b.u.T
        i, j = np.nonzero(bound >= (np.minimum.outer(a.reach, b.reach) if both else a.reach[:, None]) - 1e-4)
        # The most promising pairs first, as they raise what the others have to reach.
        order = np.argsort(-bound[i, j], kind="stable")
        i, j, bound = i[order], j[order], bound[i, j][order]
        place = np.searchsorted(b.terms, a.t).clip(max=len(b.terms) - 1)
        number = np.where(b.terms[place] == a.t, place, -1)
        step = 2_000
        while len(i):
            x, y = i[:step], j[:step]
            size = a.start[x + 1] - a.start[x]
            pair = np.repeat(np.arange(len(x)), size)
            term = np.repeat(a.start[x], size) + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            known = number[term] >= 0
            pair, term = pair[known], term[known]
            wanted = y[pair] * len(b.terms) + number[term]
            place = np.minimum(np.searchsorted(b.key, wanted), len(b.key) - 1)
            hit = b.key[place] == wanted
            score = np.round(np.bincount(pair[hit], weights=a.w[term[hit]] * b.value[place[hit]], minlength=len(x)), 6)
            for at in np.flatnonzero(score >= a.reach[x]):
                a.keep(x[at], float(score[at]), b.names[y[at]])
            for at in np.flatnonzero(score >= b.reach[y]) if both else ():
                b.keep(y[at], float(score[at]), a.names[x[at]])
            i, j, bound, step = i[step:], j[step:], bound[step:], min(2 * step, 20_000)
            left = bound >= (np.minimum(a.reach[i], b.reach[j]) if both else a.reach[i]) - 1e-4
            i, j, bound = i[left], j[left], bound[left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                one, two = divmod(task, q)
                own = [Block(here, b) for b in range(one * s, min(m, (one + 1) * s))]
                if same and one == two:
                    for at, a in enumerate(own):
                        meet(a, a, False)
                        for b in own[at + 1 :]:
                            meet(a, b, True)
                else:
                    for at in range(two * z, min(n, (two + 1) * z)):
                        b = Block(there, at)
                        for a in own:
                            meet(a, b, same)
                        if same:
                            yield from b.found()
                for a in own:
                    yield from a.found()

    tasks = spark.range(0, p * q, 1, p * q) if not same else spark.createDataFrame(spark.sparkContext.parallelize([(a * q + b,) for a in range(p) for b in range(a, q)], p * (p + 1) // 2), "id long")
    found = tasks.mapInArrow(run, f"id {kind}, other {kind}, score double").withColumnRenamed("id", id_)
    if k is None:
        return found
    w = Window.partitionBy(id_).orderBy(F.desc("score"), "other")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def leading_components(df: DataFrame, id_: str, vector: str, size: int, dims: int) -> DataFrame:
    """(id, ``latent``): coordinates along the ``dims`` directions of largest variance, in order; each direction's sign
    makes its coordinate of largest magnitude positive, of equal ones that of the smallest id.

    One pass sums the vectors and their products, ``size`` squared numbers per task; the driver takes the directions
    from these, and a second pass projects.
    """
    rows = checkpointed(df.where(F.col(id_).isNotNull() & (F.size(vector) == size)).select(F.col(id_).alias("i"), F.col(vector).cast("array<double>").alias("v")))
    kind = rows.schema["i"].dataType.simpleString()

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.c_[np.ones(batch.num_rows), matrix(batch)]
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["t"])

    total = sum((np.array(r["t"]) for r in rows.mapInArrow(sums, "t array<double>").toLocalIterator()), np.zeros((size + 1) ** 2)).reshape(size + 1, size + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    values, directions = np.linalg.eigh(total[1:, 1:] - n * np.outer(mean, mean))
    directions = directions[:, np.argsort(-values, kind="stable")][:, :dims]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(list((matrix(batch) - mean) @ directions), pa.list_(pa.float64()))], names=["i", "latent"])

    latent = rows.mapInArrow(project, f"i {kind}, latent array<double>")
    far = latent.select("i", F.posexplode("latent").alias("d", "x")).groupBy("d").agg(F.min_by("x", F.struct(-F.round(F.abs("x"), 9), F.col("i"))).alias("x")).collect()
    sign = [1.0] * min(dims, size)
    for r in far:
        sign[r["d"]] = -1.0 if r["x"] < 0 else 1.0
    signs = F.array(*[F.lit(s) for s in sign])
    return latent.select(F.col("i").alias(id_), F.zip_with("latent", signs, lambda x, s: x * s).alias("latent"))
