import pytest
from oracle import assert_same, connect

from taxoflow.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalogue.queries()[name], ORACLES[name])


# What must hold of the queries that SQL does not express: columns, and a law of their rows.
LAWS = {
    "p6_found": (["row_id", "field", "utc"], lambda d: len(d) > 1500 and d["utc"].str.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z").all() and not d.duplicated(["row_id", "field"]).any()),
    "bridge_table": (["node", "domain", "betweenness", "degree", "cross", "share", "rank"], lambda d: len(d) == 20 and (d["rank"].tolist() == list(range(1, 21))) and (d["betweenness"].diff().dropna() <= 0).all()),
    "louvain_communities": (["node", "community"], lambda d: d["node"].is_unique and d["community"].nunique() > 1),
    "tail_bootstrap_p": (["value", "completed", "exceeding", "p"], lambda d: len(d) >= 1 and d["p"].between(0, 1).all()),
    "group_pca_coordinates": (["vec_id", "label", "x", "y"], lambda d: d["vec_id"].is_unique and d[["x", "y"]].abs().max().max() <= 1 and d.groupby("label")[["x", "y"]].mean().abs().max().max() < 1e-4),
    "vuong_test": (["ratio", "z", "p", "preferred"], lambda d: len(d) == 1 and (d["ratio"][0] > 0) == (d["preferred"][0] == "power law") and 0 <= d["p"][0] <= 1),
    "logistic_robust": (["term", "coefficient", "error", "odds"], lambda d: len(d) == 4 and (d["error"] > 0).all()),
    "kmeans_clusters": (["vec_id", "cluster"], lambda d: d["vec_id"].is_unique and d["cluster"].nunique() == 12),
    "compatible_form_contains": (["l4_id", "characters"], lambda d: len(d) > 0 and d["l4_id"].is_unique),
    "leading_components": (["vec_id", "latent"], lambda d: d["vec_id"].is_unique and all(len(x) == 48 for x in d["latent"])),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_without_sql_keeps_its_law(spark, name):
    columns, law = LAWS[name]
    out = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(out.columns) == sorted(columns)
    assert law(out.toPandas())


EMPTY_AT_THE_SMALLEST_SCALE = {"record_match_candidates", "matched_pairs"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_rows(name):
    assert name in EMPTY_AT_THE_SMALLEST_SCALE or len(connect().sql(ORACLES[name]).limit(1).df()) == 1
