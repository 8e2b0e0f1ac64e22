"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.llm import cooccurrence as co
from taxoflow.llm import bpe, knn, lookalike, neardup, packing, splitting, topn, truth
from taxoflow.sources import table

CARD_FIELDS = ["evidence_quote", "risk_definition_ko", "l4_name_en"]
STORY_FIELDS = ["incident_title", "risk_description"]
#: Trust in the sources of an incident, higher first.
TRUST = {"AIID": 3, "MIT AI Incident Tracker": 2, "OECD AIM": 1}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Cards together in at least 8 cases of a release, four times as often as chance."""
    pairs = co.cooccurrence(table(spark, root, "case_verification_table"), "case_id", "l4_id", scope="taxonomy_snapshot", min_count=8)
    return co.beyond_chance(pairs, 4).select(F.col("scope").alias("taxonomy_snapshot"), F.col("item_a").alias("risk_a"), F.col("item_b").alias("risk_b"))


def p1_pairs(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of cards with counts, lift and pointwise mutual information."""
    pairs = co.cooccurrence(table(spark, root, "case_verification_table"), "case_id", "l4_id", scope="taxonomy_snapshot")
    return pairs.withColumns({"lift": F.round("lift", 6), "pmi": F.round("pmi", 6)})


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    """Records that tell one story in slightly different words: group and number of matches of each."""
    return neardup.near_duplicates(table(spark, root, "source_records"), "record_uid", "source_snapshot", ["incident_title", "risk_description", "ai_system"], 0.70)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of records in one group of near-duplicates."""
    return neardup.pairs_within(p2_groups(spark, root), "record_uid")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The three best cards of every case."""
    return topn.top_n_per_group(table(spark, root, "case_verification_table"), "case_id", "l4_id", "cosine_similarity", 3)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of cards with cosine 0.85 or more of which one is among the other's 8 nearest."""
    return knn.similar_pairs(knn.nearest(table(spark, root, "semantic_embeddings"), "ids", "vectors", 96, 8, least=0.85))


def p4_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The 8 nearest cards of every card whose number is divisible by 100, among all cards."""
    asked = F.regexp_extract("ids", r"(\d+)$", 1).try_cast("long") % 100 == 0
    return knn.nearest(table(spark, root, "semantic_embeddings"), "ids", "vectors", 96, 8, asked=F.coalesce(asked, F.lit(False)))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The record whose title or description survives for every incident with two or more records."""
    best = truth.discover(truth.incident_claims(table(spark, root, "source_records"), STORY_FIELDS), TRUST, complete_first=True)
    return best.select(F.col("entity").alias("canonical_id"), "field", F.col("record").alias("record_uid"))


def p5_votes(spark: SparkSession, root: str) -> DataFrame:
    """Survivors by reliability-weighted votes, with their support and the number of rival values."""
    best = truth.discover(truth.incident_claims(table(spark, root, "source_records"), STORY_FIELDS), TRUST, complete_first=False)
    return best.select(F.col("entity").alias("canonical_id"), "field", F.col("record").alias("record_uid"), F.round("support", 6).alias("support"), "rivals")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of cards with texts that differ but look the same."""
    return lookalike.lookalike_pairs(table(spark, root, "heart_l4_risk_cards"), "l4_id", CARD_FIELDS)


def p7_forms(spark: SparkSession, root: str) -> DataFrame:
    """Every text of the cards in its consistent form."""
    return lookalike.forms(table(spark, root, "heart_l4_risk_cards"), "l4_id", CARD_FIELDS).select("field", "l4_id", "form")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.token_ids(table(spark, root, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return packing.pack(bpe.token_counts(table(spark, root, "documents"), ["doc_id"], "text"), "doc_id", "tokens", 2048)


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are: their number, the least possible and the share of room used."""
    sums = p9_containers(spark, root).groupBy("container").agg(F.sum("size").alias("size"))
    whole = sums.agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"))
    return whole.select("containers", F.ceil(F.col("tokens") / 2048).alias("least"), "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * 2048), 6).alias("used"))


def p10_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Documents of more than 512 tokens in pieces of at most 512 that share 64."""
    return splitting.split_long(table(spark, root, "documents"), "doc_id", "text", 512, 64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_groups, p3_found, p4_found, p4_neighbours, p5_found, p5_votes, p7_found, p7_forms, p8_ids, p9_containers, p9_fill, p10_pieces)}

_P1 = """
WITH held AS (SELECT DISTINCT taxonomy_snapshot AS s, case_id, l4_id FROM case_verification_table WHERE l4_id IS NOT NULL AND case_id IS NOT NULL),
n AS (SELECT s, l4_id, count(*) AS n FROM held GROUP BY s, l4_id),
t AS (SELECT taxonomy_snapshot AS s, count(DISTINCT case_id) AS baskets FROM case_verification_table GROUP BY 1),
c AS (SELECT a.s, a.l4_id AS item_a, b.l4_id AS item_b, count(*) AS together FROM held a JOIN held b
      ON a.s IS NOT DISTINCT FROM b.s AND a.case_id = b.case_id AND a.l4_id < b.l4_id GROUP BY 1, 2, 3),
r AS (SELECT c.s AS scope, item_a, item_b, together, x.n AS n_a, y.n AS n_b, t.baskets FROM c
      JOIN n x ON x.s IS NOT DISTINCT FROM c.s AND x.l4_id = item_a JOIN n y ON y.s IS NOT DISTINCT FROM c.s AND y.l4_id = item_b
      JOIN t ON t.s IS NOT DISTINCT FROM c.s)
"""

_P2 = """
WITH RECURSIVE last AS (SELECT record_uid AS u, max_by({'t': incident_title, 'd': risk_description, 's': ai_system}, source_snapshot) AS r FROM source_records WHERE record_uid IS NOT NULL GROUP BY 1),
w AS (SELECT u, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', r.t, r.d, r.s)), '[a-z0-9]+'))) AS w FROM last), n AS (SELECT u, count(*) AS n FROM w GROUP BY u),
s AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM w a JOIN w b ON a.w = b.w AND a.u < b.u GROUP BY 1, 2),
m AS (SELECT a, b FROM s JOIN n x ON x.u = a JOIN n y ON y.u = b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM m UNION ALL SELECT b, a FROM m), c AS (SELECT a AS node, a AS seen FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen), g AS (SELECT node, min(seen) AS grp FROM c GROUP BY node)
"""

_P4_VECTORS = """v AS (SELECT ids, list_transform(max(vectors), lambda x: CAST(x AS DOUBLE)) AS v FROM semantic_embeddings
  WHERE len(vectors) = 96 AND len(list_filter(vectors, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vectors, lambda x: x <> 0)) > 0 GROUP BY ids)"""

ORACLES: dict[str, str] = {
    "p2_found": _P2 + "SELECT x.node AS uid_a, y.node AS uid_b FROM g x JOIN g y ON x.grp = y.grp AND x.node < y.node",
    "p2_groups": _P2 + "SELECT node AS record_uid, grp AS \"group\", (SELECT count(*) FROM e WHERE e.a = node) AS links FROM g",
    "p4_neighbours": f"""
WITH {_P4_VECTORS}, s AS (SELECT a.ids AS a, b.ids AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM v a JOIN v b ON a.ids <> b.ids AND TRY_CAST(regexp_extract(a.ids, '(\\d+)$', 1) AS BIGINT) % 100 = 0)
SELECT a AS id, b AS neighbour, c AS cosine, CAST(row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS INTEGER) AS place FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 8""",
    "p1_found": _P1 + "SELECT scope AS taxonomy_snapshot, item_a AS risk_a, item_b AS risk_b FROM r WHERE together >= 8 AND together * baskets >= 4 * n_a * n_b",
    "p1_pairs": _P1
    + """SELECT scope, item_a, item_b, together, n_a, n_b, baskets, round(CAST(together AS DOUBLE) * baskets / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift,
    round(ln(CAST(together AS DOUBLE) * baskets / (CAST(n_a AS DOUBLE) * n_b)), 6) AS pmi FROM r""",
    "p3_found": """
WITH best AS (SELECT case_id, l4_id, max(cosine_similarity) AS s FROM case_verification_table
  WHERE case_id IS NOT NULL AND l4_id IS NOT NULL AND cosine_similarity IS NOT NULL AND NOT isnan(cosine_similarity) GROUP BY case_id, l4_id),
r AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY s DESC, l4_id) AS INTEGER) AS top_rank, l4_id FROM best)
SELECT case_id, top_rank, l4_id FROM r WHERE top_rank <= 3""",
    "p4_found": """
WITH """ + _P4_VECTORS + """,
s AS (SELECT a.ids AS a, b.ids AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM v a JOIN v b ON a.ids <> b.ids),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 8 AND c >= 0.85""",
    "p5_found": """
WITH last AS (SELECT record_uid, max_by({'c': canonical_aiid_id, 's': source, 't': incident_title, 'd': risk_description}, source_snapshot) AS r FROM source_records GROUP BY record_uid),
named AS (SELECT DISTINCT record_uid, r.s AS source, r.t AS t, r.d AS d, CAST(u.n AS BIGINT) AS canonical_id
  FROM last, unnest(regexp_extract_all(regexp_replace(r.c, '([0-9])[.]0+($|[^0-9])', '\\1\\2', 'g'), '[0-9]+')) AS u(n)),
several AS (SELECT canonical_id FROM named GROUP BY canonical_id HAVING count(*) >= 2),
claims AS (SELECT canonical_id, record_uid, source, f.field, trim(regexp_replace(f.v, '\\s+', ' ', 'g')) AS v FROM named JOIN several USING (canonical_id),
  unnest([{'field': 'incident_title', 'v': t}, {'field': 'risk_description', 'v': d}]) AS q(f)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical_id, field ORDER BY length(v) DESC,
  CASE source WHEN 'AIID' THEN 1 WHEN 'MIT AI Incident Tracker' THEN 2 ELSE 3 END, record_uid) AS k FROM claims
  WHERE v IS NOT NULL AND lower(v) NOT IN ('', '-', '--', '---', '?', '[blank]', 'blank', 'n/a', 'na', 'nan', 'no text', 'none', 'null', 'tba', 'tbd', 'unknown'))
SELECT canonical_id, field, record_uid FROM ranked WHERE k = 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
