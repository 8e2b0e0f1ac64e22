import itertools
import random
from collections import defaultdict, deque

import pytest

from taxoflow.operators import network, similarity
from taxoflow.operators.components import connected_components


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


@pytest.mark.parametrize("pairs", [random_pairs(60, 40, 1), [(i, i + 1) for i in range(80)], [(0, i) for i in range(1, 50)], []])
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(graph(spark, pairs)).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_loops_and_nulls(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (None, 4), (2, 2)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {1: 1, 2: 2, 3: 2}


def test_betweenness_against_enumeration(spark):
    pairs = random_pairs(14, 22, 5)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def shortest(s, t):
        best, queue = [], deque([[s]])
        while queue:
            path = queue.popleft()
            if best and len(path) > len(best[0]):
                break
            if path[-1] == t:
                best.append(path)
                continue
            queue.extend(path + [x] for x in near[path[-1]] if x not in path)
        return best

    n, total = len(near), defaultdict(float)
    for s, t in itertools.combinations(sorted(near), 2):
        paths = shortest(s, t)
        for p in paths:
            for x in p[1:-1]:
                total[x] += 1 / len(paths)
    got = {r.node: r.betweenness for r in network.betweenness(graph(spark, pairs)).collect()}
    assert got == pytest.approx({x: total[x] * 2 / ((n - 1) * (n - 2)) for x in near})


def test_louvain_finds_planted_groups(spark):
    pairs = [p for g in range(4) for p in itertools.combinations(range(g * 6, g * 6 + 6), 2)] + [(0, 6), (6, 12), (12, 18)]
    got = {r.node: r.community for r in network.louvain(graph(spark, pairs)).collect()}
    assert len({got[x] for x in range(24)}) == 4 and all(got[g * 6] == got[g * 6 + i] for g in range(4) for i in range(6))
    nodes = spark.createDataFrame([(x, str(c)) for x, c in got.items()], "node long, domain string")
    assert network.modularity(nodes, graph(spark, pairs)).first()[0] > 0.6


def test_pagerank_sums_to_one(spark):
    nodes = spark.range(16).withColumnRenamed("id", "node")
    ranks = network.pagerank(nodes, graph(spark, random_pairs(14, 22, 5)), 12).collect()
    assert len(ranks) == 16 and sum(r["rank"] for r in ranks) == pytest.approx(1)


def test_top_similar_excludes_self_and_nulls(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query, r["rank"]): r.item for r in similarity.top_similar(df, df, "id", "v", 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 1}
    assert similarity.top_similar(df.limit(0), df.limit(0), "id", "v", 2).count() == 0
