"""Deterministic resampling, tests and fits; hashes of keys take the place of random numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from taxoflow.operators.numbering import numbered
from taxoflow.session import parallelism, scratch


def keyed(seed: int, *parts: Column) -> Column:
    """Order key: MD5 of seed and parts joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def hash_index(seed: int, n: Column, *parts: Column) -> Column:
    """Index below n from the leading 12 hex digits of the order key."""
    return F.conv(F.substring(keyed(seed, *parts), 1, 12), 16, 10).cast("long") % n


_MD5_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def hash_indices(seed: int, n: int, rep: int) -> Iterator[np.ndarray]:
    """``hash_index`` of the repetition and 0, 1, ... n - 1, in this order and in pieces: MD5 of many short texts at once."""
    low = np.array([int(hashlib.md5(f"{seed}|{rep}|{i}".encode()).hexdigest()[:12], 16) for i in range(min(n, 10_000))], np.uint64)
    yield (low % np.uint64(n)).astype(np.int64)
    digits = np.array([list(f"{i:04d}".encode()) for i in range(10_000)], np.uint8)
    for high in range(1, -(-n // 10_000)):
        rows = min(10_000, n - high * 10_000)
        start = f"{seed}|{rep}|{high}".encode()
        text = np.zeros((rows, 64), np.uint8)
        text[:, : len(start)], text[:, len(start) : len(start) + 4], text[:, len(start) + 4] = np.frombuffer(start, np.uint8), digits[:rows], 128
        text[:, 56:58] = divmod(8 * (len(start) + 4), 256)[::-1]
        words = text.view("<u4")
        changing = {len(start) // 4, (len(start) + 3) // 4}
        m = [np.ascontiguousarray(words[:, i]) if i in changing else words[0, i] for i in range(16)]
        first = [np.full(rows, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        (a, b, c, d), f, g = (x.copy() for x in first), np.empty(rows, np.uint32), np.empty(rows, np.uint32)
        for i in range(64):
            if i < 16:
                word = i
                np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
            elif i < 32:
                word = (5 * i + 1) % 16
                np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
            elif i < 48:
                word = (3 * i + 5) % 16
                np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            else:
                word = 7 * i % 16
                np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
            f += a
            if word in changing:
                f += m[word]
                f += np.uint32(_MD5_ADDED[i])
            else:
                f += np.uint32((int(m[word]) + _MD5_ADDED[i]) & 0xFFFFFFFF)
            np.left_shift(f, np.uint32(_MD5_TURNS[i]), out=g)
            f >>= np.uint32(32 - _MD5_TURNS[i])
            g |= f
            g += b
            a, b, c, d, g = d, g, b, c, a
        a, b = (a + first[0]).byteswap().astype(np.uint64), (b + first[1]).byteswap().astype(np.uint64)
        yield (((a << np.uint64(16)) | (b >> np.uint64(16))) % np.uint64(n)).astype(np.int64)


def resampled_counts(groups: DataFrame, reps: int, seed: int, together: int = 4) -> DataFrame:
    """(``rep``, ``item``, ``n``): how often each item is drawn when as many groups are drawn as there are, with repetition, once per
    repetition. ``groups`` has ``i``, 0, 1, ..., and ``items``, distinct codes from 1 on.

    The groups are written once; a task draws for some repetitions and reads them. Nothing is shuffled but its sums; it holds four bytes a group
    and repetition.
    """
    spark, path = groups.sparkSession, scratch(groups.sparkSession, "groups")
    groups.select(F.col("i").cast("long").alias("i"), F.col("items").cast("array<int>").alias("items")).write.option("compression", "zstd").parquet(path)
    n = spark.read.parquet(path).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [rep for batch in batches for rep in batch.column("id").to_pylist()]
        if not mine or not n:
            return
        times = np.zeros((len(mine), n), np.int32)
        for at, rep in enumerate(mine):
            for drawn in hash_indices(seed, n, rep):
                np.add.at(times[at], drawn, 1)
        files, where = pa.fs.FileSystem.from_uri(path)
        sums = [np.zeros(1, np.int64) for _ in mine]
        for batch in ds.dataset(where, filesystem=files, format="parquet").to_batches(columns=["i", "items"]):
            lists, i = batch.column("items"), batch.column("i").to_numpy()
            size, items = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            for at in range(len(mine)):
                more = np.bincount(items, weights=np.repeat(times[at][i], size), minlength=len(sums[at])).astype(np.int64)
                more[: len(sums[at])] += sums[at]
                sums[at] = more
        for rep, total in zip(mine, sums):
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), rep, np.int64)), pa.array(kept.astype(np.int64)), pa.array(total[kept])], names=["rep", "item", "n"])

    return spark.range(1, reps + 1, 1, -(-reps // together)).mapInArrow(run, "rep long, item long, n long")


def replicated(df: DataFrame, reps: int, name: str = "rep") -> DataFrame:
    """Each row once per repetition, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(reps).cast("long"))))


def shuffled(df: DataFrame, id_: str, label: str, stratum: list[str], reps: int, seed: int) -> DataFrame:
    """(``rep``, id, stratum, ``permuted``): labels permuted within strata, by hash order, for each repetition.

    Without strata the whole table is one, whose rows are numbered in ranges."""
    if stratum:
        base = df.select(id_, *stratum, label).withColumn("__j", F.row_number().over(Window.partitionBy(*stratum).orderBy(id_)).cast("long"))
    else:
        base = numbered(df.select(id_, label), [id_], "__j")
    own = base.select(id_, *stratum, "__j")
    drawn = replicated(base, reps)
    drawn = drawn.withColumn("__j", F.row_number().over(Window.partitionBy("rep", *stratum).orderBy(keyed(seed, F.col("rep"), F.col(id_)), id_)).cast("long"))
    return own.join(drawn.select("rep", *stratum, "__j", F.col(label).alias("permuted")), [*stratum, "__j"]).drop("__j")


def permutation_test(nulls: DataFrame, observed: DataFrame, lower: bool = False) -> DataFrame:
    """One row: the observed rate against the rates of permutations (column ``rate``): mean, standard deviation and
    95th percentile of these, ratio of observed to expected, one-sided p as (b + 1) / (B + 1), and z.

    ``lower`` counts the permutations at most as large instead of those at least as large.
    """
    rate, seen = F.round("rate", 12), F.round("observed", 12)
    sums = nulls.join(observed).groupBy("observed").agg(
        F.count("*").alias("permutations"), F.avg("rate").alias("null_mean"), F.stddev_samp("rate").alias("null_sd"), F.percentile("rate", F.lit(0.95)).alias("null_p95"), F.count_if(rate <= seen if lower else rate >= seen).alias("beyond")
    )
    return sums.select("permutations", "observed", "null_mean", "null_sd", "null_p95", F.try_divide("observed", "null_mean").alias("ratio"), ((F.col("beyond") + 1) / (F.col("permutations") + 1)).alias("p"), F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd")).alias("z"))


def bootstrap_share(df: DataFrame, flag: Column, reps: int, seed: int) -> DataFrame:
    """One row: number of rows, share for which the flag is true, and mean and 95 % interval of resamples' shares.

    Draw i of a repetition is row hash(rep, i) of the rows in an order that has the true ones first, so that a draw
    is true if it is below their number; no row is looked up.
    """
    whole = df.agg(F.count("*").alias("n"), F.count_if(flag).alias("hits"))
    draws = replicated(whole.select("n", "hits", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)))).alias("i")).where("n > 0"), reps)
    rates = draws.groupBy("n", "hits", "rep").agg((F.count_if(hash_index(seed, F.col("n"), F.col("rep"), F.col("i")) < F.col("hits")) / F.first("n")).alias("rate"))
    sums = rates.groupBy("n", "hits").agg(F.avg("rate").alias("mean"), F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sums.select("n", (F.col("hits") / F.col("n")).alias("share"), "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: counts, accuracy, precision, recall and Matthews correlation; null where a denominator is 0."""
    pick = lambda t, g: F.count_if((truth == t) & (guess == g))
    c = df.agg(pick(True, True).alias("tp"), pick(False, True).alias("fp"), pick(False, False).alias("tn"), pick(True, False).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        "tp", "fp", "tn", "fn", F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tp * tn - fp * fn, root).alias("mcc"),
    )


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``df`` with ``bin``: index of the right-closed interval between distinct interpolated quantiles, the least in bin 0."""
    steps = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = df.agg(F.array_distinct(F.percentile(F.col(value).cast("double"), steps)).alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return df.join(edges).withColumn("bin", F.greatest(below - 1, F.lit(0))).drop("__edges")


def ccdf(df: DataFrame, value: str) -> DataFrame:
    """(value, ``n``, ``share``): rows of each value and the share of rows at least as large."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(value, "n", (above / F.sum("n").over(Window.partitionBy())).alias("share"))


#: Terms that are summed before the Euler-Maclaurin remainder, and its Bernoulli numbers over factorials (fixed values).
_ZETA_TERMS, _ZETA_REST = 12, [1 / 12, -1 / 720, 1 / 30240, -1 / 1209600, 1 / 47900160]


def hurwitz(s: float, q: np.ndarray) -> np.ndarray:
    """The sum of (q + k) ** -s over k = 0, 1, ..., for s above 1."""
    q = np.asarray(q, dtype=np.float64)
    head = ((q[..., None] + np.arange(_ZETA_TERMS)) ** -s).sum(axis=-1)
    at = q + _ZETA_TERMS
    rest = at ** (1 - s) / (s - 1) + at**-s / 2
    factor, power = s, at ** (-s - 1)
    for j, b in enumerate(_ZETA_REST):
        rest = rest + b * factor * power
        factor, power = factor * (s + 2 * j + 1) * (s + 2 * j + 2), power / at**2
    return head + rest


def _alphas(x: np.ndarray, n: np.ndarray, discrete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values in the tail from every value on, and the exponents fitted to them, from sums over the table's end."""
    tail = np.cumsum(n[::-1])[::-1]
    logs = np.cumsum((n * np.log(x))[::-1])[::-1] - tail * np.log(x - 0.5 if discrete else x)
    with np.errstate(divide="ignore"):
        return tail, 1 + tail / np.where(logs > 0, logs, 0)


def _distance(x: np.ndarray, n: np.ndarray, alpha: float, discrete: bool) -> float:
    """Largest distance of i / n from the model at the i-th smallest value of a tail, given as values and counts."""
    upto = np.cumsum(n)
    model = 1 - hurwitz(alpha, x + 1) / hurwitz(alpha, x[0]) if discrete else 1 - (x / x[0]) ** (1 - alpha)
    return float(np.maximum(np.abs(upto / upto[-1] - model), np.abs((upto - n + 1) / upto[-1] - model)).max())


def _table_of(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct positive values and their counts, at most ``VALUES``."""
    counts = df.select(F.col(value).cast("double").alias("x")).where("x > 0").groupBy("x").agg(F.count("*").alias("n"))
    found = counts.limit(VALUES + 1).toArrow()
    if found.num_rows > VALUES:
        raise ValueError(f"more than {VALUES} distinct values")
    order = np.argsort(found.column("x").to_numpy())
    return found.column("x").to_numpy()[order], found.column("n").to_numpy()[order]


#: Distinct values of a distribution that go to the driver and to all tasks as a table of counts (16 MB); more are an error.
VALUES = 1 << 20


def power_law(df: DataFrame, value: str, least_tail: int, discrete: bool = False) -> DataFrame:
    """Every candidate minimum with a long enough tail: (``xmin``, ``n``, ``alpha``, ``ks``, ``chosen``).

    alpha is 1 + n / sum ln(x / xmin), with xmin - 1/2 for integers; ks is the largest distance of i / n from the
    model's distribution at the i-th smallest value of the tail, which for integers is by the Hurwitz zeta function.
    The candidate of least ks is chosen, of equal ones the smallest. Null and non-positive values take no part.

    Rows are counted by value in one shuffle; the table of counts gives all exponents by sums from its end, and the
    candidates' distances are spread over tasks. More than ``VALUES`` distinct values are an error.
    """
    spark = df.sparkSession
    x, n = _table_of(df, value)
    tail, alpha = _alphas(x, n, discrete)
    able = np.flatnonzero((tail >= least_tail) & np.isfinite(alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = able[batch.column("id").to_numpy()]
            ks = [_distance(x[i:], n[i:], alpha[i], discrete) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(tail[at].astype(np.int64)), pa.array(alpha[at]), pa.array(ks, pa.float64())], names=["xmin", "n", "alpha", "ks"])

    fits = spark.range(0, len(able), 1, min(max(1, len(able)), 4 * parallelism(spark))).mapInArrow(run, "xmin double, n long, alpha double, ks double")
    best = fits.agg(F.min(F.struct(F.round("ks", 12), "xmin"))["xmin"].alias("best"))
    return fits.join(best).withColumn("chosen", F.col("xmin") == F.col("best")).drop("best")


def tail_bootstrap(df: DataFrame, value: str, fit: Row, least_tail: int, reps: int, seed: int, discrete: bool = False) -> DataFrame:
    """(``rep``, ``ks``, ``exceeds``) of semi-parametric resamples, each fitted anew with its minimum.

    A resample has as many values below the minimum as the data, drawn from these with replacement, and as many in
    the tail, drawn from the model, which for integers ends at the larger of 1,000 and 40 times the minimum. A
    resample without a tail that can be fitted gives no row. The table of counts goes to every task, see
    ``VALUES``; repetitions are spread over tasks, each with its seed.
    """
    x, n = _table_of(df, value)
    body, tail, xmin, alpha, observed = x < fit["xmin"], int(fit["n"]), fit["xmin"], fit["alpha"], fit["ks"]
    support = np.arange(int(xmin), max(1000, int(xmin) * 40) + 1) if discrete else None

    def resample(rng: np.random.Generator) -> np.ndarray:
        below = np.repeat(x[body], rng.multinomial(n[body].sum(), n[body] / n[body].sum())) if body.any() else x[:0]
        if discrete:
            weight = support**-alpha
            return np.concatenate([below, np.repeat(support, rng.multinomial(tail, weight / weight.sum()))]).astype(np.float64)
        return np.concatenate([below, xmin * (1 - rng.random(tail)) ** (-1 / (alpha - 1))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rep in batch["id"]:
                v, c = np.unique(resample(np.random.default_rng([seed, int(rep)])), return_counts=True)
                size, a = _alphas(v, c, discrete)
                able = np.flatnonzero((size >= least_tail) & np.isfinite(a))
                if len(able):
                    ks = min(_distance(v[i:], c[i:], a[i], discrete) for i in able)
                    rows.append((int(rep), ks, bool(ks >= observed)))
            yield pd.DataFrame(rows, columns=["rep", "ks", "exceeds"])

    return df.sparkSession.range(0, reps, 1, min(reps, 32)).mapInPandas(run, "rep long, ks double, exceeds boolean")


def normal_equations(df: DataFrame, y: Column, xs: dict[str, Column]) -> DataFrame:
    """(``term``, ``coefficient``) of least squares with intercept, from one aggregate of cross products; plus ``r2``."""
    names = ["intercept", *xs]
    columns = [F.lit(1.0), *[x.cast("double") for x in xs.values()]]
    k = len(names)
    sums = [F.sum(columns[i] * columns[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(columns[i] * y).alias(f"y{i}") for i in range(k)] + [F.sum(y * y).alias("yy"), F.count("*").alias("n")]
    row = df.agg(*sums).first()
    a = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    b = np.array([row[f"y{i}"] or 0.0 for i in range(k)])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    mean = b[0] / max(row["n"], 1)
    spread = (row["yy"] or 0.0) - row["n"] * mean * mean
    r2 = float((beta @ b - row["n"] * mean * mean) / spread) if spread > 0 else None
    return df.sparkSession.createDataFrame([(t, float(v), r2) for t, v in zip(names, beta)], "term string, coefficient double, r2 double")


def within_regression(df: DataFrame, y: str, x: str, level: str) -> DataFrame:
    """One row: least squares of y on x with a constant per level, by deviations from the levels' means: number of rows
    and levels, ``slope``, sums of squares of x within levels (``sxx``), of residuals (``rss``) and of y (``tss``)."""
    means = df.groupBy(level).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    d = df.join(means, level).select(level, (F.col(x) - F.col("__mx")).alias("dx"), (F.col(y) - F.col("__my")).alias("dy"), F.col(y).alias("y"))
    sums = d.agg(F.count("*").alias("n"), F.count_distinct(level).alias("levels"), F.sum(F.col("dx") * F.col("dx")).alias("sxx"), F.sum(F.col("dx") * F.col("dy")).alias("sxy"), F.sum(F.col("dy") * F.col("dy")).alias("syy"), (F.var_pop("y") * F.count("*")).alias("tss"))
    return sums.select("n", "levels", F.try_divide("sxy", "sxx").alias("slope"), "sxx", (F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))).alias("rss"), "tss")


def stratified_sample(df: DataFrame, id_: str, stratum: str, quota: Column, seed: int) -> DataFrame:
    """Up to a quota of rows per stratum, the first by hash order of their id."""
    w = Window.partitionBy(stratum).orderBy(keyed(seed, F.col(id_)), id_)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= quota).drop("__n")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ranks of the value in ascending order, equal values sharing their mean rank."""
    counts = df.groupBy(value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select(F.col(value).alias("__v"), (upto - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranks, F.col(value) == F.col("__v")).drop("__v")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two partitions of the rows."""
    half = lambda c: c * (c - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(half(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(half(F.col("n"))).alias("ra"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(half(F.col("n"))).alias("rb"))
    chance = F.col("ra") * F.col("rb") / half(F.col("n"))
    return both.join(rows).join(columns).select(F.try_divide(F.col("both") - chance, (F.col("ra") + F.col("rb")) / 2 - chance).alias("ari"))
