import math

from pyspark.sql import functions as F

from taxoflow.operators import matching
from taxoflow.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_weights_broadcast_no_terms(spark):
    # Terms grow with the table, whatever the size of its files.
    assert "BroadcastHashJoin" not in plan(catalogue.queries()["tfidf_weights"](spark, "/root/testdata/sf0.001"))


def test_term_weights_keep_a_row_without_id(spark):
    df = spark.createDataFrame([("a", ["x", "x", "y"]), (None, ["x"]), ("b", [])], "id string, w array<string>")
    got = {(r.id, r.term): r.weight for r in matching.weights(df, "id", F.col("w")).collect()}
    x, y = (1 + math.log(2)) * (1 + math.log(4 / 3)), 1 + math.log(4 / 2)
    assert set(got) == {("a", "x"), ("a", "y"), (None, "x")} and math.isclose(got["a", "x"], x / math.hypot(x, y)) and got[None, "x"] == 1.0


def test_cluster_terms_broadcast_no_terms(spark):
    assert "SortMergeJoin [term" in plan(catalogue.queries()["cluster_top_terms"](spark, "/root/testdata/sf0.001"))


def test_lexical_contrast_broadcasts_no_terms(spark):
    assert "SortMergeJoin [term" in plan(catalogue.queries()["lexical_contrast"](spark, "/root/testdata/sf0.001"))


def test_cluster_terms_broadcast_no_cards(spark):
    assert "BroadcastHashJoin [l4_id" not in plan(catalogue.queries()["cluster_top_terms"](spark, "/root/testdata/sf0.001"))


def test_lexical_contrast_broadcasts_no_cards(spark):
    assert "BroadcastHashJoin [l4_id" not in plan(catalogue.queries()["lexical_contrast"](spark, "/root/testdata/sf0.001"))


def brute(rows, others, least, k):
    out = set()
    for i, x in rows.items():
        near = sorted((-round(sum(v * y.get(t, 0) for t, v in x.items()), 6), j) for j, y in others.items() if j != i)
        out |= {(i, j, -s) for s, j in near[:k] if -s >= least}
    return out


def test_best_pairs_over_tiles_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(7)
    texts = [(i, [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 10))]) for i in range(150)]
    texts += [(200 + i, texts[3][1] or ["w1"]) for i in range(40)] + [(None, ["w1"])]  # more equal texts than a block holds
    monkeypatch.setattr(matching, "BLOCK", 8)
    monkeypatch.setattr(matching, "TILE", 16)
    t = matching.weights(spark.createDataFrame(texts, "id long, w array<string>"), "id", F.col("w")).localCheckpoint()
    rows = {}
    for r in t.where("id IS NOT NULL").collect():
        rows.setdefault(r.id, {})[r.term] = r.weight
    for k in (1, 3):
        assert {(r.id, r.other, r.score) for r in matching.cosine_pairs(t, t, "id", 0.3, k).collect()} == brute(rows, rows, 0.3, k)
    odd = {i: x for i, x in rows.items() if i % 2}
    assert {(r.id, r.other, r.score) for r in matching.cosine_pairs(t.where("id % 2 = 1"), t, "id", 0.3, 2).collect()} == brute(odd, rows, 0.3, 2)


def test_rows_are_shuffled_once_whatever_the_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 4)
    t = spark.createDataFrame([(i, f"w{i % 7}", 1.0) for i in range(64)], "id long, term string, weight double")
    assert "Generate explode" not in plan(matching.cosine_pairs(t, t, "id", 0.5, 1))


def test_neighbour_edges_repeat_no_block(spark):
    # Blocks were repeated for every other block, which are shuffled rows by the square of the table.
    assert "Generate explode" not in plan(catalogue.queries()["name_neighbour_edges"](spark, "/root/testdata/sf0.001"))
