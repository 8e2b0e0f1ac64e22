import hashlib

import numpy as np

from taxoflow.operators import stats
from taxoflow.plans import catalogue


def index(seed, n, rep, i):
    return int(hashlib.md5(f"{seed}|{rep}|{i}".encode()).hexdigest()[:12], 16) % n


def test_hash_indices_are_those_of_single_texts():
    for n, rep in ((1, 1), (9_999, 2), (10_001, 30), (123_456, 300)):
        got = np.concatenate(list(stats.hash_indices(5, n, rep)))
        asked = [*range(0, n, 97), n - 1, min(n, 10_000) - 1, min(n - 1, 10_000)]
        assert len(got) == n and [got[i] for i in asked] == [index(5, n, rep, i) for i in asked]


def test_resampled_counts_against_single_draws(spark):
    items = {0: [1, 3], 1: [], 2: [2], 3: [1]}
    got = {(r.rep, r.item): r.n for r in stats.resampled_counts(spark.createDataFrame(list(items.items()), "i long, items array<int>"), 6, 5).collect()}
    expected = {}
    for rep in range(1, 7):
        for i in range(4):
            for x in items[index(5, 4, rep, i)]:
                expected[rep, x] = expected.get((rep, x), 0) + 1
    assert got == expected


def test_rank_intervals_shuffle_no_draws(spark):
    text = catalogue.queries()["bootstrap_rank_intervals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sequence(1, 300" not in text and "md5" not in text
