import random
import re
from collections import defaultdict

import numpy as np
import pytest

from taxoflow.llm import neardup, rtree

SCHEMA = "uid string, version string, title string, body string, w string, group string, c int"


def brute(rows, t):
    last = {}
    for u, v, a, b in rows:
        if u is not None and (u not in last or v > last[u][0]):
            last[u] = (v, frozenset(re.findall("[a-z0-9]+", f"{a or ''} {b or ''}".lower())))
    ids = sorted(u for u in last if last[u][1])
    words = {u: last[u][1] for u in ids}
    parent = {u: u for u in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(words[a] & words[b])
            if n >= t * (len(words[a]) + len(words[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {u: (find(u), links[u]) for u in ids if links[u]}


def family_rows():
    rng = random.Random(4)
    common = [f"word{k}" for k in range(60)]
    rows = []
    for f in range(25):
        base = [f"name{f}", f"place{f}", f"maker{f}"] + rng.sample(common, 25)
        for m in range(rng.randrange(1, 6)):
            words = base[:]
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(3, len(words))] = rng.choice(common + [f"odd{rng.randrange(1000)}"])
            rng.shuffle(words)
            rows.append((f"u{f}-{m}", "2", " ".join(words[:8]).title(), " ".join(words[8:])))
    rows += [("u0-0", "1", "an older", "text of another story"), ("copy1", "1", "Same WORDS here", "one two"), ("copy2", "1", "here same words", "two one two"), ("none1", "1", None, None), ("none2", "1", "", "!!"), ("late", "1", "a b c", None), ("late", "2", None, "?")]
    rows += [(None, "1", "a b c", "d"), ("long", "1", "long " * 30000, "x"), ("long2", "1", "long", "x")] + [rows[0]] * 2
    return rows


@pytest.mark.parametrize("together", [512, 3])
def test_groups_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(neardup, "TOGETHER", together)
    rows = family_rows()
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    got = {r.uid: (r.group, r.links) for r in neardup.near_duplicates(df, "uid", "version", ["title", "body"], 0.7).collect()}
    assert got == brute(rows, 0.7)


def test_parts_of_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 5)
    rows = family_rows()
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    groups = neardup.near_duplicates(df, "uid", "version", ["title", "body"], 0.7)
    expected = brute(rows, 0.7)
    members = defaultdict(list)
    for u, (g, _) in expected.items():
        members[g].append(u)
    pairs = {(a, b) for m in members.values() for a in m for b in m if a < b}
    assert {tuple(r) for r in neardup.pairs_within(groups, "uid").collect()} == pairs


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(df, "uid", "version", ["title", "body"], 0.7).count() == 0


@pytest.mark.parametrize("chunk, leaf, fanout", [(3, 2, 2), (1 << 16, 64, 8), (500, 8, 3)])
def test_tree_join_is_complete(monkeypatch, chunk, leaf, fanout):
    for name, value in (("CHUNK", chunk), ("LEAF", leaf), ("FANOUT", fanout)):
        monkeypatch.setattr(rtree, name, value)
    rng = np.random.default_rng(1)
    n = 300
    block, side = np.sort(rng.integers(0, 4, n)), np.zeros(n, dtype=np.int64)
    side[block == 3] = np.sort(rng.integers(0, 2, (block == 3).sum()))
    counts = rng.integers(0, 2, (n, 64)).astype(np.int64) * rng.integers(0, 6, (n, 64)) * (rng.random((n, 64)) < 0.2)
    counts[1::3] = counts[:-1:3][: len(counts[1::3])]
    counts[7] *= 40
    size = counts.sum(axis=1) + 1
    low, high = rtree.planes(counts)
    held, excess = np.minimum(counts, rtree.TOP), size - np.minimum(counts, rtree.TOP).sum(axis=1)
    got = {(int(a), int(b)) for x, y in rtree.similar(block, side, low, high, size, 0.8) for a, b in zip(x, y)}
    for a in range(n):
        for b in range(a + 1, n):
            joined = block[a] == block[b] and (side[a] != side[b] if block[a] == 3 else True)
            bound = np.minimum(held[a], held[b]).sum() + min(excess[a], excess[b])
            able = bound >= 0.8 / 1.8 * (size[a] + size[b]) - 1e-9 and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])
            assert ((a, b) in got) == bool(joined and able)


def held_often_rows(copies=60):
    """A story of frequent words, and records of the same words with four rare ones more, delivered twice."""
    story = " ".join(f"word{k}" for k in range(70))
    rows = [(f"s{i:03d}", "1", story, f"only{i} only{i}x") for i in range(copies)]
    rare = [(f"r{i}", "1", story, " ".join(f"rare{i}{j}" for j in range(4))) for i in range(3)]
    return rows + rare + rare


@pytest.mark.parametrize("together", [512, 3])
def test_matches_that_share_no_rare_word(spark, monkeypatch, together):
    monkeypatch.setattr(neardup, "TOGETHER", together)
    rows = held_often_rows()
    # Words of the story occur more than 2,000 times, by records that match nothing.
    rows += [(f"x{i:04d}", "1", " ".join(f"word{k}" for k in range(i % 7, 70, 7)), " ".join(f"far{i % 50}{j}" for j in range(40))) for i in range(14_500)]
    expected = brute(rows[:66], 0.7)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = {r.uid: (r.group, r.links) for r in neardup.near_duplicates(df, "uid", "version", ["title", "body"], 0.7).collect() if r.uid[0] != "x"}
    assert len(expected) == 63 and got == expected


def test_many_rare_words_in_pairs(spark):
    """Two records share 50 of 66 words, each has eight more that stand in one other record."""
    shared = " ".join(f"word{k}" for k in range(50))
    own = [" ".join(f"own{r}x{k}" for k in range(8)) for r in range(2)]
    rows = [(f"a{r}", "1", shared, own[r]) for r in range(2)] + [(f"b{r}", "1", f"elsewhere{r} entirely{r} other{r}", own[r]) for r in range(2)]
    rows += [(f"f{i:03d}", "1", " ".join(f"word{(i + 7 * k) % 50}" for k in range(5)), f"more{i} of{i} it{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    got = {r.uid: (r.group, r.links) for r in neardup.near_duplicates(df, "uid", "version", ["title", "body"], 0.7).collect()}
    assert got == brute(rows, 0.7) and {"a0", "a1"} <= got.keys()
