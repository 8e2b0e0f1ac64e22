import itertools
import math
import random
from collections import Counter, defaultdict

from taxoflow.llm import cooccurrence as co
from taxoflow.llm import topn


def brute(rows, min_count):
    held, baskets = defaultdict(set), defaultdict(set)
    for s, b, i in rows:
        if b is not None:
            baskets[s].add(b)
            if i is not None:
                held[s, b].add(i)
    n, c = Counter(), Counter()
    for (s, _), items in held.items():
        n.update((s, i) for i in items)
        c.update((s, *p) for p in itertools.combinations(sorted(items), 2))
    return {(s, a, b): (k, n[s, a], n[s, b], len(baskets[s])) for (s, a, b), k in c.items() if k >= min_count}


def frame(spark, rows):
    # other columns bear the names that the operator uses itself
    return spark.createDataFrame([(s, b, i, "x", 1, 0.5) for s, b, i in rows], "release string, basket string, card string, scope string, baskets int, lift double")


def test_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(rng.choice(["r1", "r2", None]), f"b{rng.randrange(12)}", f"i{rng.randrange(9)}") for _ in range(250)]
    rows += [("r1", "hot", f"i{k}") for k in range(40)] + [("r1", "hot", "i1")] * 5 + [("r1", None, "i1"), ("r2", "b0", None), ("r2", "only null", None)]
    for least in (1, 3):
        got = {(r.scope, r.item_a, r.item_b): (r.together, r.n_a, r.n_b, r.baskets) for r in co.cooccurrence(frame(spark, rows), "basket", "card", "release", least).collect()}
        assert got == brute(rows, least)


def test_lift_and_empty(spark):
    rows = [("r", "1", "a"), ("r", "1", "b"), ("r", "2", "a"), ("r", "3", None)]
    r = co.cooccurrence(frame(spark, rows), "basket", "card", "release").first()
    assert r.lift == 1 * 3 / (2 * 1) and math.isclose(r.pmi, math.log(1.5))
    assert co.beyond_chance(co.cooccurrence(frame(spark, rows), "basket", "card", "release"), 2).count() == 0
    assert co.cooccurrence(frame(spark, rows).limit(0), "basket", "card").count() == 0


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["g1", "g2", "g3", None]), rng.choice([f"i{k}" for k in range(8)] + [None]), rng.choice([0.5, 0.25, -0.0, 0.0, None, math.nan, math.inf])) for _ in range(600)]
    rows += [("hot", f"i{k % 7}", float(k % 5)) for k in range(3000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "case string, card string, score double, g string, top_rank int").repartition(5)
    best = defaultdict(dict)
    for g, i, s in rows:
        if None not in (g, i, s) and not math.isnan(s):
            best[g][i] = max(s, best[g].get(i, -math.inf))
    expected = {(g, k + 1, i) for g, items in best.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:3])}
    assert {tuple(r) for r in topn.top_n_per_group(df, "case", "card", "score", 3).collect()} == expected
    assert topn.top_n_per_group(df.limit(0), "case", "card", "score", 3).count() == 0


def test_stream_carries_open_groups():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"g": g, "i": i, "s": s}) for g, i, s in [(["a", "a"], ["x", "x"], [3.0, 2.0]), (["a"], ["y"], [1.5]), (["a", "b"], ["x", "z"], [1.0, 9.0]), (["b", "b", "b"], ["z", "q", "r"], [8.0, 7.0, 6.0])]]
    rows = [tuple(x.values()) for b in topn._stream(2, True)(iter(batches)) for x in b.to_pylist()]
    assert rows == [("a", "x", 1), ("a", "y", 2), ("b", "z", 1), ("b", "q", 2)]
