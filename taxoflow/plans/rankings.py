"""Queries on grouping, ranking, sets and hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxoflow.operators import stats
from taxoflow.plans.registry import Registry
from taxoflow.sources import table

R = Registry()


@R.query("SELECT p_brand, p_type, n, CAST(r AS INTEGER) AS place FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r <= 3")
def topn_per_domain(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))
    return counts.withColumn("place", place).where("place <= 3")


@R.query("""SELECT l1_id, l4_id FROM (SELECT l1_id, l4_id, row_number() OVER (PARTITION BY l1_id, l2_id ORDER BY length(risk_definition_en) DESC NULLS LAST, l4_id) AS r FROM heart_l4_risk_cards) WHERE r <= CASE l1_id WHEN 'L1_G' THEN 1 WHEN 'L1_A' THEN 2 ELSE 4 END""")
def label_quota(spark: SparkSession, root: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("l1_id", "l2_id").orderBy(F.length("risk_definition_en").desc_nulls_last(), "l4_id"))
    quota = F.when(F.col("l1_id") == "L1_G", 1).when(F.col("l1_id") == "L1_A", 2).otherwise(4)
    return table(spark, root, "heart_l4_risk_cards").withColumn("r", r).where(F.col("r") <= quota).select("l1_id", "l4_id")


@R.query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS INTEGER) AS place FROM part")
def competition_rank_desc(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))).alias("place"))


@R.query("""WITH q AS (SELECT list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS edges FROM events)
SELECT bin, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM (SELECT value, greatest(len(list_filter(edges, lambda e: e < value)) - 1, 0) AS bin FROM events, q) GROUP BY bin""")
def quantile_bins_qcut(spark: SparkSession, root: str) -> DataFrame:
    rows = stats.quantile_bins(table(spark, root, "events"), "value", 10)
    return rows.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@R.query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events")
def factorize_codes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events")
    kinds = rows.select("event_type").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    return rows.join(kinds, "event_type").select("event_id", "code")


@R.query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r, n / sum(n) OVER (PARTITION BY source) AS share FROM c)
SELECT a.source, a.lang AS first, round(a.share, 6) AS share, CASE WHEN a.share < 0.55 THEN b.lang END AS second FROM r a LEFT JOIN r b ON a.source IS NOT DISTINCT FROM b.source AND b.r = 2 WHERE a.r = 1""")
def mode_top2_share(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "documents").where("lang IS NOT NULL").groupBy("source", "lang").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source")
    ranked = counts.withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "lang"))).withColumn("share", F.col("n") / F.sum("n").over(by))
    wide = ranked.groupBy("source").agg(F.max(F.when(F.col("r") == 1, F.col("lang"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("share"))).alias("share"), F.max(F.when(F.col("r") == 2, F.col("lang"))).alias("second"))
    return wide.select("source", "first", F.round("share", 6).alias("share"), F.when(F.col("share") < 0.55, F.col("second")).alias("second"))


@R.query("""SELECT 'both' AS kind, n FROM (SELECT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'customers only', n FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, root: str) -> DataFrame:
    c, s = table(spark, root, "customer").select(F.col("c_nationkey").alias("n")), table(spark, root, "supplier").select(F.col("s_nationkey").alias("n"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "n")
    return named(c.intersect(s), "both").unionByName(named(c.subtract(s), "customers only")).unionByName(named(c.union(s).distinct(), "any"))


@R.query("""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('23|' || doc_id), doc_id) AS r FROM documents) WHERE r <= CASE WHEN lang = 'en' THEN 50 ELSE 25 END""")
def stratified_sample_quota(spark: SparkSession, root: str) -> DataFrame:
    return stats.stratified_sample(table(spark, root, "documents"), "doc_id", "lang", F.when(F.col("lang") == "en", 50).otherwise(25), 23).select("lang", "doc_id")


@R.query("""WITH s AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('23|' || doc_id), doc_id) AS r FROM documents),
t AS (SELECT doc_id, 'first' AS part FROM s WHERE r <= 10), u AS (SELECT doc_id, 'top up' AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('24|' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)) WHERE r <= 20)
SELECT *, '' AS reviewer FROM (SELECT * FROM t UNION ALL SELECT * FROM u)""")
def sample_with_top_up(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "lang")
    first = stats.stratified_sample(docs, "doc_id", "lang", F.lit(10), 23).select("doc_id", F.lit("first").alias("part"))
    rest = docs.join(first, "doc_id", "left_anti").orderBy(stats.keyed(24, F.col("doc_id")), "doc_id").limit(20).select("doc_id", F.lit("top up").alias("part"))
    return first.unionByName(rest).withColumn("reviewer", F.lit(""))


@R.query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rollup_hierarchy_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "customer").join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@R.query("SELECT l1_id, l2_id, l3_id, count(*) AS n FROM heart_l4_risk_cards GROUP BY ROLLUP (l1_id, l2_id, l3_id)")
def taxonomy_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "heart_l4_risk_cards").rollup("l1_id", "l2_id", "l3_id").agg(F.count("*").alias("n"))


@R.query("SELECT l4_id, array_to_string(list_sort(list(DISTINCT case_id)), ';') AS cases, count(DISTINCT case_id) AS n FROM case_verification_table WHERE l4_id IS NOT NULL GROUP BY l4_id")
def inverted_index(spark: SparkSession, root: str) -> DataFrame:
    pairs = table(spark, root, "case_verification_table").where("l4_id IS NOT NULL").select("l4_id", "case_id").distinct()
    return pairs.groupBy("l4_id").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ";").alias("cases"), F.count("*").alias("n"))


@R.query("SELECT event_type, round(stddev_samp(value), 6) AS sd, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def group_statistics(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("event_type").agg(
        F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("user_id").alias("users")
    )


@R.query("""WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n, round(sqrt(9 + 216 * CASE WHEN max(n) OVER () = min(n) OVER () THEN 0.5 ELSE (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) END), 6) AS radius FROM c""")
def scaled_node_size(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    bounds = counts.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    ratio = F.coalesce(F.try_divide(F.col("n") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))
    return counts.join(bounds).select("l_suppkey", "n", F.round(F.sqrt(9 + 216 * ratio), 6).alias("radius"))


@R.query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY (o_orderkey = 7) DESC, o_totalprice DESC, o_orderkey LIMIT 5")
def exact_match_first(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").orderBy(F.desc(F.col("o_orderkey") == 7), F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_orderdate")


@R.query("SELECT split_part(o_orderpriority, '-', 1) AS class, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS closed, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS rate FROM orders GROUP BY 1")
def classified_counts(spark: SparkSession, root: str) -> DataFrame:
    closed = F.col("o_orderstatus") == "F"
    return table(spark, root, "orders").groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("class")).agg(F.count("*").alias("n"), F.count_if(closed).alias("closed"), F.round(F.avg(closed.cast("int")), 6).alias("rate"))


@R.query("""WITH l AS (SELECT DISTINCT o_orderpriority AS level FROM orders WHERE o_orderpriority IS NOT NULL), k AS (SELECT level FROM l WHERE level > (SELECT min(level) FROM l))
SELECT o_orderkey, k.level, CASE WHEN o_orderpriority = k.level THEN 1.0 ELSE 0.0 END AS value FROM orders, k""")
def one_hot(spark: SparkSession, root: str) -> DataFrame:
    """Indicator columns of all levels but the first in order, as rows; at most 1,000 levels, which name columns."""
    orders = table(spark, root, "orders")
    found = sorted(r[0] for r in orders.where("o_orderpriority IS NOT NULL").select("o_orderpriority").distinct().limit(1001).collect())
    if len(found) > 1000:
        raise ValueError("more than 1000 levels")
    wide = orders.select("o_orderkey", *[F.when(F.col("o_orderpriority") == v, 1.0).otherwise(0.0).alias(v) for v in found[1:]])
    return wide.unpivot(["o_orderkey"], found[1:], "level", "value")


@R.query("SELECT event_type, min(ts) AS first_seen, count(*) AS n FROM events GROUP BY event_type")
def first_seen_groups(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("event_type").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"))


@R.query("""WITH c AS (SELECT case_id, count(*) AS n, count(DISTINCT l4_id) AS cards, count(rank) AS ranks, count(DISTINCT rank) AS places, max(rank) AS last FROM case_verification_table WHERE case_id IS NOT NULL GROUP BY case_id),
l AS (SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'three_per_case' AS law, count(*) FILTER (n <> 3) AS broken, count(*) AS checked FROM c UNION ALL SELECT 'card_once_per_case', count(*) FILTER (cards <> n), count(*) FROM c
UNION ALL SELECT 'rank_gaps', count(*) FILTER (places <> last), count(*) FROM c UNION ALL SELECT 'rank_repeats', count(*) FILTER (places <> ranks), count(*) FROM c
UNION ALL SELECT 'lines_per_order', count(*) FILTER (n NOT BETWEEN 1 AND 7), count(*) FROM l""")
def quality_laws(spark: SparkSession, root: str) -> DataFrame:
    """How many groups break each law: three rows a case, a card once a case, ranks without gaps and repeats, one to seven lines an order."""
    c = table(spark, root, "case_verification_table").where("case_id IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct("l4_id").alias("cards"), F.count("rank").alias("ranks"), F.count_distinct("rank").alias("places"), F.max("rank").alias("last"))
    cases = {"three_per_case": "n <> 3", "card_once_per_case": "cards <> n", "rank_gaps": "places <> last", "rank_repeats": "places <> ranks"}
    counted = c.agg(F.count("*").alias("checked"), *[F.count_if(F.expr(x)).alias(law) for law, x in cases.items()])
    laws = counted.unpivot(["checked"], [*cases], "law", "broken").select("law", "broken", "checked")
    lines = table(spark, root, "orders").join(table(spark, root, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("n"))
    return laws.unionByName(lines.agg(F.lit("lines_per_order").alias("law"), F.count_if(~F.col("n").between(1, 7)).alias("broken"), F.count("*").alias("checked")))


@R.query("""SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def weekly_event_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy(F.date_trunc("week", "ts").alias("week"), "event_type").agg(F.count("*").alias("n"))


QUERIES, ORACLES = R.queries, R.oracles
