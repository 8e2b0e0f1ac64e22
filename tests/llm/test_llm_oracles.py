import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import assert_same  # noqa: E402

from taxoflow.llm import queries as q  # noqa: E402


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, q.queries()[name], q.oracle_sql()[name])


LAWS = {
    "p5_votes": lambda d: len(d) > 0 and not d.duplicated(["canonical_id", "field"]).any() and (d["support"] > 0).all() and (d["rivals"] >= 1).all(),
    "p7_found": lambda d: len(d) > 0 and (d["l4_id_a"] < d["l4_id_b"]).all() and not d.duplicated().any(),
    "p7_forms": lambda d: len(d) > 0 and (d["form"] != "").all() and d["form"].str.strip(" ").eq(d["form"]).all(),
    "p8_ids": lambda d: len(d) == 100 and d["doc_id"].is_unique and all(x is not None for x in d["ids"]),
    "p9_containers": lambda d: d[d["container"] > 0].groupby("container")["size"].sum().max() <= 2048 and not d.duplicated(["doc_id", "part"]).any(),
    "p9_fill": lambda d: d["containers"][0] >= d["least"][0] and d["fullest"][0] <= 2048 and d["used"][0] > 0.9,
    "p10_pieces": lambda d: len(d) > 0 and d["tokens"].max() <= 512 and (d["end_token"] - d["start_token"] == d["tokens"]).all() and not d.duplicated(["doc_id", "piece"]).any(),
}


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_sql_keeps_its_law(spark, name):
    assert LAWS[name](q.queries()[name](spark, "/root/testdata/sf0.001").toPandas())
