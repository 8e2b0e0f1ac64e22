"""Fits whose data stay distributed: each round is one aggregate, only small matrices reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxoflow.session import checkpointed

def _cross(df: DataFrame, columns: list[Column], weight: Column, right: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weight * x x' and of x * r, in one pass."""
    k = len(columns)
    sums = [F.sum(weight * columns[i] * columns[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(columns[i] * r).alias(f"b{i}_{m}") for i in range(k) for m, r in enumerate(right)]
    row = df.agg(*sums).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return a, np.array([[row[f"b{i}_{m}"] or 0.0 for m in range(len(right))] for i in range(k)])


def logistic_hc3(df: DataFrame, y: Column, xs: dict[str, Column], rounds: int = 25) -> DataFrame:
    """(``term``, ``coefficient``, ``error``, ``odds``) of a logistic model by Newton's method, errors robust (HC3).

    Each round sums the information matrix and the score; a last pass sums the squared residuals over
    (1 - leverage)^2. Rows with a null in any variable are left out.
    """
    names, columns = ["intercept", *xs], [F.lit(1.0), *[x.cast("double") for x in xs.values()]]
    rows = df.select(y.cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    x = [F.col(f"x{i}") for i in range(len(columns))]
    beta = np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))))
        a, g = _cross(rows, x, p * (1 - p), [F.col("y") - p])
        step = np.linalg.pinv(a) @ g[:, 0]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    p = 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))))
    bread = np.linalg.pinv(_cross(rows, x, p * (1 - p), [F.lit(0.0)])[0])
    leverage = p * (1 - p) * sum((float(bread[i, j]) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
    meat = _cross(rows, x, F.pow((F.col("y") - p) / (1 - leverage), 2), [F.lit(0.0)])[0]
    error = np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0))
    return df.sparkSession.createDataFrame([(n, float(b), float(e), math.exp(float(b))) for n, b, e in zip(names, beta, error)], "term string, coefficient double, error double, odds double")


def mcnemar_exact(first_only: int, second_only: int) -> float:
    """Two-sided exact p of two discordant counts."""
    n, k = first_only + second_only, min(first_only, second_only)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(math.exp(v) for v in logs))


def _truncated_moments(mu: float, sigma: float) -> tuple[list[float], float]:
    """Moments 0 to 4 of a normal variable cut off below 0, and the logarithm of the share that is left."""
    a = -mu / sigma
    if a < 25:
        left = 0.5 * math.erfc(a / math.sqrt(2))
        log_left, hazard = math.log(left), math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / left
    else:
        hazard = a + 1 / a - 2 / a**3
        log_left = -a * a / 2 - math.log(hazard * math.sqrt(2 * math.pi))
    m = [1.0, mu + sigma * hazard]
    for k in range(2, 5):
        m.append(mu * m[k - 1] + (k - 1) * sigma**2 * m[k - 2])
    return m, log_left


def _truncated_normal(mean: float, square: float, rounds: int = 200) -> tuple[float, float, float]:
    """Most likely mean and deviation of a normal variable cut off below 0, and the logarithm of the share left, from
    the first two moments: Newton's method on the natural parameters, in which the likelihood is concave."""

    def value(t: np.ndarray) -> float:
        sigma = math.sqrt(-0.5 / t[1])
        mu = t[0] * sigma**2
        return t[0] * mean + t[1] * square - mu * mu / (2 * sigma**2) - math.log(sigma) - _truncated_moments(mu, sigma)[1]

    spread = max(square - mean * mean, 1e-12)
    t = np.array([mean / spread, -0.5 / spread])
    for _ in range(rounds):
        sigma = math.sqrt(-0.5 / t[1])
        m, _ = _truncated_moments(t[0] * sigma**2, sigma)
        gradient = np.array([mean - m[1], square - m[2]])
        step = np.linalg.lstsq(np.array([[m[2] - m[1] ** 2, m[3] - m[1] * m[2]], [m[3] - m[1] * m[2], m[4] - m[2] ** 2]]), gradient, rcond=None)[0]
        size, now = 1.0, value(t)
        while size > 1e-9 and ((t + size * step)[1] >= -1e-9 or value(t + size * step) < now):
            size /= 2
        if size <= 1e-9 or np.abs(size * step).max() < 1e-12 * (1 + np.abs(t).max()):
            break
        t = t + size * step
    sigma = math.sqrt(-0.5 / t[1])
    return t[0] * sigma**2, sigma, _truncated_moments(t[0] * sigma**2, sigma)[1]


def vuong(df: DataFrame, value: str, xmin: float, alpha: float) -> DataFrame:
    """One row (``ratio``, ``z``, ``p``, ``preferred``): power law against the lognormal truncated at ``xmin``.

    With y = ln(x / xmin) the gap of the log-likelihoods is a polynomial of degree 2 in y, so that the sums of the
    first four powers of y give the fit, the ratio and its deviation: one aggregate, whatever the tail's length.
    """
    y = F.log(F.col(value).cast("double") / xmin)
    powers = [F.avg(F.pow(y, F.lit(k))).alias(f"m{k}") for k in range(1, 5)]
    row = df.where(F.col(value).cast("double") >= xmin).agg(F.count("*").alias("n"), *powers).first()
    n = row["n"]
    if n < 2 or not row["m2"]:
        return df.sparkSession.createDataFrame([], "ratio double, z double, p double, preferred string")
    m = [1.0, *[row[f"m{k}"] for k in range(1, 5)]]
    mu, sigma, log_left = _truncated_normal(m[1], m[2])
    # Both densities are of y: the factor 1 / x cancels out.
    c = [math.log(alpha - 1) + mu * mu / (2 * sigma**2) + math.log(sigma * math.sqrt(2 * math.pi)) + log_left, -(alpha - 1) - mu / sigma**2, 1 / (2 * sigma**2)]
    mean = sum(c[i] * m[i] for i in range(3))
    square = sum(c[i] * c[j] * m[i + j] for i in range(3) for j in range(3))
    spread = math.sqrt(max(square - mean * mean, 0.0) * n / (n - 1) / n)
    z = mean / spread if spread > 1e-12 else 0.0
    return df.sparkSession.createDataFrame([(float(n * mean), float(z), math.erfc(abs(z) / math.sqrt(2)), "power law" if mean > 0 else "lognormal")], "ratio double, z double, p double, preferred string")


def kmeans_farthest_first(df: DataFrame, id_: str, vector: str, clusters: int, rounds: int = 100) -> DataFrame:
    """(id, ``cluster``): the first centre is the vector of smallest id, each next the one farthest from all centres;
    then Lloyd rounds until no centre moves. An empty cluster keeps its centre. Every round is one pass, in which
    each partition sums its vectors by cluster; the driver holds the centres only. Ties go to the smaller id and
    the smaller cluster.
    """
    rows = checkpointed(df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).alias("i"), F.col(vector).cast("array<double>").alias("v")))
    first = rows.orderBy("i").limit(1).collect()
    if not first:
        return df.select(F.col(id_), F.lit(0).alias("cluster")).limit(0)
    centres = [np.array(first[0]["v"])]
    kind = rows.schema["i"].dataType.simpleString()

    def nearest(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.array(centres)
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
        d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0).round(12)
        return x, d.argmin(axis=1), d.min(axis=1)

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, cluster, d = nearest(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(cluster.astype(np.int32)), pa.array(d), b.column("v")], names=["i", "cluster", "d", "v"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centres), len(centres[0]))), np.zeros(len(centres), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x, cluster, _ = nearest(b.column("v"))
                np.add.at(total, cluster, x)
                count += np.bincount(cluster, minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(count), pa.array(list(total), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

    while len(centres) < clusters:
        far = rows.mapInArrow(away, f"i {kind}, cluster int, d double, v array<double>").orderBy(F.desc("d"), "i").limit(1).collect()[0]
        if far["d"] == 0:
            break
        centres.append(np.array(far["v"]))
    for _ in range(rounds):
        parts = rows.mapInArrow(sums, "cluster int, n long, total array<double>").where("n > 0").orderBy("cluster").collect()
        total, count = np.zeros((len(centres), len(centres[0]))), np.zeros(len(centres))
        for r in parts:
            total[r["cluster"]] += r["total"]
            count[r["cluster"]] += r["n"]
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], np.array(centres))
        settled = np.allclose(moved, np.array(centres), atol=1e-8)
        centres = list(moved)
        if settled:
            break
    return rows.mapInArrow(away, f"i {kind}, cluster int, d double, v array<double>").select(F.col("i").alias(id_), "cluster")
