import math

import numpy as np
from pyspark.sql import functions as F

from taxoflow.operators import models, stats
from taxoflow.plans import catalogue


def test_logistic_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.c_[np.ones(200), rng.integers(0, 2, 200), rng.normal(size=200)]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [0.3, 0.8, -0.5])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (_, a, b), c in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = models.logistic_hc3(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")}).collect()
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
    h = p * (1 - p) * np.einsum("ij,jk,ik->i", x, bread, x)
    error = np.sqrt(np.diag(bread @ ((x * (((y - p) / (1 - h)) ** 2)[:, None]).T @ x) @ bread))
    assert np.allclose([r.coefficient for r in got], beta) and np.allclose([r.error for r in got], error)


def test_mcnemar_exact():
    assert models.mcnemar_exact(0, 0) == 1.0 and models.mcnemar_exact(5, 5) == 1.0
    assert math.isclose(models.mcnemar_exact(1, 9), 2 * (1 + 10) / 2**10)


def test_vuong_prefers_the_true_model(spark):
    rng = np.random.default_rng(3)
    law = (1 - rng.random(4000)) ** (-1 / 1.5)
    df = spark.createDataFrame([(float(v),) for v in law], "x double")
    assert models.vuong(df, "x", 1.0, 2.5).first()["p"] > 0.01 or models.vuong(df, "x", 1.0, 2.5).first()["preferred"] == "power law"
    bell = np.exp(rng.normal(1.0, 0.4, 4000))
    bell = bell[bell >= 1]
    alpha = 1 + len(bell) / np.log(bell).sum()
    assert models.vuong(spark.createDataFrame([(float(v),) for v in bell], "x double"), "x", 1.0, float(alpha)).first()["preferred"] == "lognormal"


def test_kmeans_finds_planted_clusters(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(4)[i % 4] * 10 + rng.normal(size=4)).tolist()) for i in range(80)] + [(None, [0.0] * 4), (999, None)]
    got = {r.id: r.cluster for r in models.kmeans_farthest_first(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 4).collect()}
    assert len(got) == 80 and all(got[i] == got[i % 4] for i in range(80)) and len(set(got.values())) == 4
    assert models.kmeans_farthest_first(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 4).count() == 0


def test_tail_bootstrap_repeats(spark):
    x = spark.createDataFrame([(float(v),) for v in (1 - np.random.default_rng(5).random(200)) ** (-1 / 1.5)], "x double")
    best = stats.power_law(x, "x", 50).where("chosen").first()
    runs = [sorted(map(tuple, stats.tail_bootstrap(x, "x", best, 50, 6, 1).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 6


def test_tail_bootstrap_runs_the_references_repetitions(spark):
    rows = {r.value: r for r in catalogue.queries()["tail_bootstrap_p"](spark, "/root/testdata/sf0.001").collect()}
    assert rows and all(990 <= r.completed <= 1000 and r.p == r.exceeding / r.completed for r in rows.values())


def test_hurwitz_zeta():
    q = np.array([1.0, 2.0, 7.0, 60.0])
    for s in (1.5, 2.5, 4.5, 9.0):
        k = np.arange(200_000)
        direct = ((q[:, None] + k) ** -s).sum(axis=1) + (q + 199_999.5) ** (1 - s) / (s - 1)
        assert np.allclose(stats.hurwitz(s, q), direct, rtol=1e-9)


def test_power_law_against_its_definition(spark):
    values = np.random.default_rng(8).integers(1, 12, 300).astype(float)
    df = spark.createDataFrame([(v,) for v in values.tolist()] + [(None,), (0.0,), (-3.0,)], "x double")
    for discrete in (False, True):
        for r in stats.power_law(df, "x", 50, discrete).collect():
            tail = np.sort(values[values >= r.xmin])
            alpha = 1 + len(tail) / np.log(tail / (r.xmin - 0.5 * discrete)).sum()
            model = 1 - stats.hurwitz(alpha, tail + 1) / stats.hurwitz(alpha, np.array([r.xmin])) if discrete else 1 - (tail / r.xmin) ** (1 - alpha)
            assert r.n == len(tail) and math.isclose(r.alpha, alpha) and math.isclose(r.ks, np.abs(np.arange(1, len(tail) + 1) / len(tail) - model).max())


def test_numbers_and_ranks_without_one_task(spark):
    from taxoflow.operators.numbering import competition_rank, numbered

    values = np.random.default_rng(1).integers(0, 40, 500).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(7)
    got = {r.id: r.at for r in numbered(df, [F.desc("v"), "id"], "at").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)), 1)}
    assert {r.id: r.k for r in competition_rank(df, "v", "k").collect()} == {i: 1 + sum(w > v for w in values) for i, v in enumerate(values)}
    assert numbered(df.limit(0), ["id"], "at").count() == 0


def test_vuong_by_sums_equals_the_sum_over_values(spark):
    rng = np.random.default_rng(6)
    x = np.exp(rng.normal(1.2, 0.5, 3000))
    x = x[x >= 1.0]
    y = np.log(x)
    alpha = 1 + len(x) / y.sum()
    mu, sigma, left = models._truncated_normal(y.mean(), (y**2).mean())
    assert abs(mu - 1.2) < 0.1 and abs(sigma - 0.5) < 0.1
    gap = math.log(alpha - 1) - (alpha - 1) * y + math.log(sigma * math.sqrt(2 * math.pi)) + (y - mu) ** 2 / (2 * sigma**2) + left
    row = models.vuong(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 1.0, float(alpha)).first()
    assert math.isclose(row["ratio"], gap.sum(), rel_tol=1e-6) and math.isclose(row["z"], gap.mean() / (gap.std(ddof=1) / math.sqrt(len(gap))), rel_tol=1e-6)
