import math

import numpy as np

from taxoflow.llm import knn
from taxoflow.llm.vamana import Graph


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 6)
    out = {}
    for a, i in enumerate(ids):
        near = sorted((-sims[a, b], j) for b, j in enumerate(ids) if b != a and sims[a, b] >= least)[:k]
        out[i] = [(j, -s) for s, j in near]
    return out


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 5 + 1, d))
    return {f"v{i:05d}": (centre[i // 5] + 0.25 * rng.normal(size=d)).astype(np.float32) for i in range(n)}


def test_pairs_and_dirty_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 100)
    vectors = clustered(400, 12, 3)
    for i in range(30):
        vectors[f"w{i:02d}"] = vectors["v00000"]  # equal vectors under many ids
    for i in range(5):
        vectors[f"x{i}"] = vectors["v00005"] * np.float32(2**i)  # equal directions
    rows = [(i, v.tolist(), 1, "x") for i, v in vectors.items()]
    rows += [rows[3], rows[7], ("bad1", None, 1, "x"), ("bad2", [0.0] * 12, 1, "x"), ("bad3", [1.0] * 11, 1, "x"), ("bad4", [math.nan] + [1.0] * 11, 1, "x"), ("bad5", [math.inf] + [1.0] * 11, 1, "x"), ("bad6", [None] + [1.0] * 11, 1, "x"), (None, [1.0] * 12, 1, "x")]
    df = spark.createDataFrame(rows, "ids string, vectors array<float>, c int, h string")
    expected = {tuple(sorted((a, b))) for a, near in brute(vectors, 8, 0.85).items() for b, _ in near}
    got = {tuple(r) for r in knn.similar_pairs(knn.nearest(df, "ids", "vectors", 12, 8, least=0.85)).collect()}
    assert len(expected & got) >= 0.98 * len(expected) and len(got - expected) <= 0.02 * len(expected)
    assert not any(i.startswith("bad") for p in got for i in p)


def test_recall_of_neighbours(spark):
    vectors = clustered(600, 16, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "ids string, vectors array<float>")
    truth = brute(vectors, 8, -1)
    rows = knn.nearest(df, "ids", "vectors", 16, 8).collect()
    assert len(rows) == 600 * 8 and {r.place for r in rows} == set(range(1, 9))
    hit = sum(r.neighbour in {j for j, _ in truth[r.id]} for r in rows)
    assert hit >= 0.95 * len(rows)


def test_recall_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 25)
    rng = np.random.default_rng(9)
    vectors = {f"v{i:05d}": rng.normal(size=24).astype(np.float32) for i in range(1500)}
    df = spark.createDataFrame([(i, v.tolist(), i.endswith("0")) for i, v in vectors.items()], "ids string, vectors array<float>, q boolean")
    truth = brute(vectors, 8, -1)
    rows = knn.nearest(df, "ids", "vectors", 24, 8, asked=df.q).collect()
    hit = sum(r.neighbour in {j for j, _ in truth[r.id]} for r in rows)
    assert len(rows) == 150 * 8 and hit >= 0.95 * len(rows)


def test_few_and_no_vectors(spark):
    schema = "ids string, vectors array<float>"
    assert knn.nearest(spark.createDataFrame([], schema), "ids", "vectors", 2, 8).count() == 0
    assert knn.nearest(spark.createDataFrame([("a", [1.0, 0.0])], schema), "ids", "vectors", 2, 8).count() == 0
    two = knn.nearest(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], schema), "ids", "vectors", 2, 8).collect()
    assert sorted((r.id, r.neighbour, r.cosine, r.place) for r in two) == [("a", "b", 0.707107, 1), ("b", "a", 0.707107, 1)]


def test_graph_reaches_equal_points():
    x = np.concatenate([np.tile([[1.0, 0.0]], (20, 1)), np.tile([[0.0, 1.0]], (60, 1))])
    found, _ = Graph(x).search(np.array([[1.0, 0.0]]), 32)
    assert set(range(20)) <= set(found[0].tolist())


def test_more_scaled_copies_than_the_beam_holds(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=12)
    vectors = {f"s{i:03d}": (base * (1 + (i * 37 % 150) / 7)).astype(np.float32) for i in range(150)}
    vectors |= {f"o{i:03d}": rng.normal(size=12).astype(np.float32) for i in range(200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "ids string, vectors array<float>")
    got = {}
    for r in knn.nearest(df, "ids", "vectors", 12, 8, least=0.9).collect():
        got.setdefault(r.id, []).append((r.place, r.neighbour))
    expected = brute(vectors, 8, 0.9)
    for i in vectors:
        if i[0] == "s":
            assert [n for _, n in sorted(got[i])] == [n for n, _ in expected[i]], i


def test_centroids_in_two_steps(monkeypatch):
    from taxoflow.llm import vamana

    monkeypatch.setattr(vamana, "FLAT", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    many = vamana.centroids(x, 100)
    assert 80 <= len(many) <= 110 and np.allclose(np.linalg.norm(many, axis=1), 1, atol=1e-5) and (x @ many.T).max(axis=1).mean() > (x @ vamana.centroids(x, 10).T).max(axis=1).mean()
