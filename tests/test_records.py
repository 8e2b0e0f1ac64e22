import numpy as np
from pyspark.sql import functions as F

from taxoflow.functions import text as tx
from taxoflow.operators import quality, reconcile, rules, stats


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "  a \t b\n", tx.clean) == "a b" and one(spark, None, tx.clean) == ""
    assert one(spark, "  ", tx.filled) is None
    assert one(spark, "Héllo, World-2", tx.title_key) == "h llo world 2"
    assert one(spark, "on 5 May 2021 and 2022", tx.year_of) == 2021 and one(spark, "120215", tx.year_of) is None
    assert one(spark, "['a', 'b']", tx.list_of) == ["a", "b"] and one(spark, "nan", tx.list_of) == [] and one(spark, "x", tx.list_of) == ["x"]
    assert one(spark, "https://u@Example.org:80/a", tx.host_of) == "example.org" and one(spark, "ftp://x", tx.host_of) is None
    assert one(spark, "YES ", tx.truthy) is True and one(spark, None, tx.truthy) is False
    assert one(spark, "X. none", tx.domain_label) == "Uncoded or excluded" and one(spark, "1. Safety", tx.domain_label) == "Safety"
    assert one(spark, "<a>&'", tx.escaped) == "&lt;a&gt;&amp;&#x27;"


def test_overlay_precedence(spark):
    a = spark.createDataFrame([(1, "t1", "x"), (2, "t2", "y")], "k int, title string, risk string")
    b = spark.createDataFrame([(2, "u2", "z"), (3, "u3", " ")], "k int, title string, risk string")
    got = {r.k: (r.title, r.risk, r.coverage) for r in reconcile.overlay(a, b, "k", ["risk"], ("both", "a", "b")).collect()}
    assert got == {1: ("t1", "x", "a"), 2: ("t2", "z", "both"), 3: ("u3", None, "b")}


def test_rule_without_clause_and_exclusion(spark):
    df = spark.createDataFrame([("A_1", "A", "robot"), ("B_1", "B", None)], "id string, domain string, text string")
    found = rules.members(df, [rules.Rule("none"), rules.Rule("gate", gate=["A"], terms=["robot"]), rules.Rule("all", prefixes=["A", "B"], exclude=["A_1"])], "id", "domain", F.col("text"))
    assert sorted(tuple(r) for r in found.collect()) == [("all", "B_1"), ("gate", "A_1")]


def test_quality(spark):
    df = spark.createDataFrame([("a", None), ("a", " ")], "k string, v string")
    assert quality.repeated_keys(df, ["k"]).collect()[0].n == 2
    assert {r.column_name: r.blank_rate for r in quality.blank_counts(df, ["k", "v"]).collect()} == {"k": 0.0, "v": 1.0}


def test_normal_equations_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((50, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(0, 0.1, 50)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    got = {r.term: r.coefficient for r in stats.normal_equations(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")}).collect()}
    beta = np.linalg.lstsq(np.c_[np.ones(50), x], y, rcond=None)[0]
    assert np.allclose([got["intercept"], got["a"], got["b"]], beta)


def test_confusion_without_rows_of_a_class(spark):
    df = spark.createDataFrame([(True, True)], "t boolean, g boolean")
    r = stats.confusion(df, F.col("t"), F.col("g")).first()
    assert (r.tp, r.accuracy, r.mcc) == (1, 1.0, None)


def test_lists_in_single_quotes_keep_quotes_inside(spark):
    from taxoflow.functions import text as tx

    cases = {"['4', '5']": ["4", "5"], '["a", "b"]': ["a", "b"], "['it\u0027s', 'x']": ["it's", "x"], "7": ["7"], "nan": [], "": [], "[1, 2]": ["1", "2"], "[]": []}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.n for r in df.select("x", tx.list_of(df.x).alias("n")).collect()} == cases


def test_status_classes_and_unknown_ranges(spark):
    from taxoflow.operators import quality, rules

    df = spark.createDataFrame([(200,), (399,), (403,), (429,), (404,), (500,), (None,)], "s int")
    assert [r[0] for r in df.select(quality.status_class(df.s)).collect()] == ["reachable", "reachable", "access_controlled", "access_controlled", "http_error", "http_error", "network_error"]
    assert [r[0] for r in df.select(rules.within_or_unknown(df.s, 399)).collect()] == [True, True, False, False, False, False, True]


def test_text_matches_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from taxoflow.operators import matching

    rng = random.Random(2)
    texts = {i: [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 12))] for i in range(60)}
    texts |= {100 + i: texts[i] + ["extra"] for i in range(20)}
    df = spark.createDataFrame([(i, w) for i, w in texts.items()] + [(None, ["w1"])], "id long, w array<string>").where("id IS NOT NULL")
    t = matching.weights(df, "id", matching.grams(F.col("w"), ["w3"]))
    got = {(r.id, r.other): r.score for r in matching.cosine_pairs(t, t, "id", 0.4).collect()}
    bags = {}
    for i, w in texts.items():
        kept = [x for x in w if x != "w3"]
        bags[i] = Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    n, spread = len(texts), Counter(x for b in bags.values() for x in b)
    raw = {i: {x: (1 + math.log(k)) * (1 + math.log((1 + n) / (1 + spread[x]))) for x, k in b.items()} for i, b in bags.items()}
    unit = {i: {x: v / math.sqrt(sum(u * u for u in r.values())) for x, v in r.items()} for i, r in raw.items()}
    score = {(a, b): sum(v * unit[b].get(x, 0) for x, v in unit[a].items()) for a in unit for b in unit if a != b}
    expected = {p: s for p, s in score.items() if round(s, 6) >= 0.4}
    assert got.keys() == expected.keys() and all(abs(got[p] - expected[p]) < 2e-6 for p in got)


def test_leading_components_against_numpy(spark):
    import numpy as np

    from taxoflow.operators import matching

    x = np.random.default_rng(3).normal(size=(50, 6)) * np.array([5, 4, 3, 2, 1, 0.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 6), (99, None), (98, [1.0])], "id long, v array<double>").repartition(5)
    got = np.array([r.latent for r in matching.leading_components(df, "id", "v", 6, 3).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]))
    assert all(got[np.abs(got[:, d]).argmax(), d] > 0 for d in range(3))
