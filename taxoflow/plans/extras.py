"""Queries on concepts, comparisons of rankings, models and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxoflow.operators import models, network, numbering, similarity, stats
from taxoflow.plans import networks as nw
from taxoflow.plans.registry import Registry
from taxoflow.plans.statistics import strengths
from taxoflow.session import checkpointed, written
from taxoflow.sources import table

R = Registry()
KEEP, INCLUDED, EXCLUDED = 0.35, [3, 17], [5, 8]


@R.query(f"WITH {nw.CENTRES_SQL} SELECT category, vec_id, score FROM z WHERE vec_id NOT IN (5, 8) AND (score >= {KEEP} OR vec_id IN (3, 17))")
def concept_retrieval_threshold(spark: SparkSession, root: str) -> DataFrame:
    kept = ~F.col("vec_id").isin(EXCLUDED) & ((F.col("score") >= KEEP) | F.col("vec_id").isin(INCLUDED))
    return nw.category_scores(spark, root).where(kept).select("category", "vec_id", "score")


HALVES = [(1, 32), (33, 32)]
_HALF = """{n}v AS (SELECT vec_id, label, list_transform(embedding[{a}:{b}], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
{n}k AS (SELECT a.vec_id AS query, b.vec_id AS item, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS r FROM {n}v a JOIN {n}v b ON a.vec_id <> b.vec_id)"""


@R.query(f"""WITH {_HALF.format(n='p', a=1, b=32)}, {_HALF.format(n='q', a=33, b=64)},
o AS (SELECT p.query, count(q.item) / 8.0 AS overlap FROM pk p LEFT JOIN qk q ON q.query = p.query AND q.item = p.item AND q.r <= 8 WHERE p.r <= 8 GROUP BY 1)
SELECT round(avg(overlap), 6) AS overlap, (SELECT round(avg(CAST(same AS INTEGER)), 6) FROM pk WHERE r <= 8) AS same_first, (SELECT round(avg(CAST(same AS INTEGER)), 6) FROM qk WHERE r <= 8) AS same_second FROM o""")
def neighbour_overlap(spark: SparkSession, root: str) -> DataFrame:
    v = nw.vectors(spark, root)
    sides = []
    for start, n in HALVES:
        half = v.select("vec_id", F.slice("embedding", start, n).alias("embedding"))
        near = checkpointed(similarity.top_similar(half, half, "vec_id", "embedding", 8).select("query", "item"))
        named = near.join(v.select(F.col("vec_id").alias("query"), "label"), "query").join(v.select(F.col("vec_id").alias("item"), F.col("label").alias("other")), "item")
        sides.append((near, named.agg(F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("same"))))
    (a, same_a), (b, same_b) = sides
    shared = a.join(b.withColumn("hit", F.lit(1)), ["query", "item"], "left").groupBy("query").agg((F.count("hit") / 8.0).alias("overlap"))
    return shared.agg(F.round(F.avg("overlap"), 6).alias("overlap")).join(same_a.withColumnRenamed("same", "same_first")).join(same_b.withColumnRenamed("same", "same_second"))


#: Old and new beginnings of ids, replaced wherever they stand in a text, in this order.
RENAMED = {"P_DAT_": "P_DTA_", "G_SYS_": "G_SST_", "G_SOC_": "G_SCL_", "G_INT_": "G_ITR_", "A_DAT_": "A_DTA_", "P_SOC_": "P_SCL_"}


def _renamed_sql(x: str) -> str:
    for old, new in RENAMED.items():
        x = f"replace({x}, '{old}', '{new}')"
    return x


@R.query(f"""WITH n AS (SELECT case_id, list(l4_id ORDER BY l4_id) AS cards, max('seen with ' || l4_id) AS note FROM (SELECT DISTINCT case_id, l4_id FROM case_verification_table WHERE l4_id IS NOT NULL) GROUP BY case_id)
SELECT case_id, {_renamed_sql("array_to_string(cards, ',')")} AS cards, {_renamed_sql("note")} AS note FROM n""")
def id_migration(spark: SparkSession, root: str) -> DataFrame:
    """Ids renamed in nested values: lists of structures of ids, and texts that hold them."""

    def renamed(x: Column) -> Column:
        for old, new in RENAMED.items():
            x = F.replace(x, F.lit(old), F.lit(new))
        return x

    v = table(spark, root, "case_verification_table").where("l4_id IS NOT NULL").select("case_id", "l4_id").distinct()
    nested = v.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("l4_id", F.concat(F.lit("seen with "), "l4_id").alias("note")))).alias("cards"))
    moved = nested.withColumn("cards", F.transform("cards", lambda c: F.struct(renamed(c["l4_id"]).alias("l4_id"), renamed(c["note"]).alias("note"))))
    return moved.select("case_id", F.array_join(F.transform("cards", lambda c: c["l4_id"]), ",").alias("cards"), F.element_at("cards", -1)["note"].alias("note"))


@R.query(f"""WITH {nw.BASE}, d AS (SELECT unnest([0.0, 0.02, 0.05, 0.1]) AS margin), x AS (SELECT margin, query, count(*) AS n, count(DISTINCT db) > 1 AS c FROM (SELECT l.*, max(similarity) OVER (PARTITION BY query) AS top FROM l) t, d WHERE similarity >= round(top - margin, 6) GROUP BY 1, 2)
SELECT margin, round(avg(n), 6) AS links, round(avg(CAST(c AS INTEGER)), 6) AS crossing FROM x GROUP BY margin""")
def margin_rule_curve(spark: SparkSession, root: str) -> DataFrame:
    rows = nw.linked_domains(spark, root).withColumn("top", F.max("similarity").over(Window.partitionBy("query")))
    rows = rows.withColumn("margin", F.explode(F.array(*[F.lit(m) for m in (0.0, 0.02, 0.05, 0.1)]))).where(F.col("similarity") >= F.round(F.col("top") - F.col("margin"), 6))
    each = rows.groupBy("margin", "query").agg(F.count("*").alias("n"), (F.count_distinct("domain") > 1).alias("c"))
    return each.groupBy("margin").agg(F.round(F.avg("n"), 6).alias("links"), F.round(F.avg(F.col("c").cast("int")), 6).alias("crossing"))


_ROLE_WORDS = {"developer": "developer|maker|built by", "operator": "operator|deployed|staff", "user": "user|customer|passenger", "bystander": "bystander|pedestrian|child|neighbour"}


@R.query("WITH t AS (SELECT source, actual_harm, lower(concat_ws(' ', incident_title, risk_description)) AS t FROM source_records), r AS (" + " UNION ALL ".join(f"SELECT '{r}' AS role, source, actual_harm FROM t WHERE regexp_matches(t, '{p}')" for r, p in _ROLE_WORDS.items()) + ") SELECT role, source, count(*) AS n, count(*) FILTER (actual_harm) AS harmed, round(count(*) FILTER (actual_harm) / count(*), 6) AS rate FROM r GROUP BY 1, 2")
def actor_counts(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries of each source that mention each role, and how many of them report harm."""
    t = F.lower(F.concat_ws(" ", "incident_title", "risk_description"))
    roles = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(r)) for r, p in _ROLE_WORDS.items()]))
    g = table(spark, root, "source_records").select("source", "actual_harm", F.explode(roles).alias("role")).groupBy("role", "source").agg(F.count("*").alias("n"), F.count_if(F.coalesce("actual_harm", F.lit(False))).alias("harmed"))
    return g.withColumn("rate", F.round(F.col("harmed") / F.col("n"), 6))


@R.query(f"""WITH {nw.TFIDF_SQL}, n AS (SELECT count(*) FILTER (l1_id = 'L1_P') AS p, count(*) FILTER (l1_id IS DISTINCT FROM 'L1_P') AS o FROM heart_l4_risk_cards),
m AS (SELECT term, sum(CASE WHEN d.l1_id = 'L1_P' THEN weight ELSE 0 END) / any_value(n.p) AS a, sum(CASE WHEN d.l1_id IS DISTINCT FROM 'L1_P' THEN weight ELSE 0 END) / any_value(n.o) AS b FROM t JOIN d ON d.l4_id = t.l4_id, n GROUP BY term)
SELECT term, round(a - b, 6) AS contrast FROM m ORDER BY round(a - b, 6) DESC, term LIMIT 20""")
def lexical_contrast(spark: SparkSession, root: str) -> DataFrame:
    cards = table(spark, root, "heart_l4_risk_cards").select("l4_id", F.coalesce(F.col("l1_id") == "L1_P", F.lit(False)).alias("p"))
    sizes = cards.agg(F.count_if("p").alias("np"), F.count_if(~F.col("p")).alias("no"))
    w = nw.name_weights(spark, root).join(cards.hint("merge"), "l4_id").groupBy("term").agg(F.sum(F.when(F.col("p"), F.col("weight")).otherwise(0.0)).alias("a"), F.sum(F.when(~F.col("p"), F.col("weight")).otherwise(0.0)).alias("b"))
    return w.join(sizes).select("term", F.round(F.try_divide("a", "np") - F.try_divide("b", "no"), 6).alias("contrast")).orderBy(F.desc("contrast"), "term").limit(20)


@R.query("""WITH o AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS i FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)), n AS (SELECT count(*) AS n FROM o),
d AS (SELECT rep, CAST('0x' || substr(md5('5|' || rep || '|' || i), 1, 12) AS BIGINT) % n AS k FROM o, n, (SELECT unnest(range(1, 301)) AS rep)), h AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT rep, p_brand, count(*) AS n FROM d JOIN o ON o.i = d.k JOIN h ON h.l_orderkey = o.l_orderkey GROUP BY 1, 2), r AS (SELECT p_brand, rank() OVER (PARTITION BY rep ORDER BY n DESC) AS r FROM c)
SELECT p_brand, CAST(min(r) AS INTEGER) AS best, CAST(max(r) AS INTEGER) AS worst, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM r GROUP BY p_brand""")
def bootstrap_rank_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Intervals of the brands' ranks by number of orders over 300 resamples of orders."""
    parts = table(spark, root, "part").select("p_partkey", "p_brand")
    brands = numbering.numbered(parts.select("p_brand").distinct(), ["p_brand"], "item")
    coded = parts.join(brands.withColumnRenamed("p_brand", "b"), F.col("p_brand").eqNullSafe(F.col("b"))).select("p_partkey", F.col("item").cast("int").alias("item"))
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey").join(coded, F.col("l_partkey") == F.col("p_partkey"))
    held = written(lines.groupBy("l_orderkey").agg(F.collect_set("item").alias("items")))
    orders = numbering.numbered(held, [F.col("l_orderkey").asc_nulls_last()], "i")
    # An order without a key is drawn, but has no brands.
    orders = orders.select(F.col("i") - 1, F.when(F.col("l_orderkey").isNotNull(), F.col("items")).otherwise(F.array().cast("array<int>")).alias("items"))
    counts = stats.resampled_counts(orders.toDF("i", "items"), 300, 5).join(brands, "item")
    ranked = counts.withColumn("r", F.rank().over(Window.partitionBy("rep").orderBy(F.desc("n"))))
    cut = F.percentile("r", F.array(F.lit(0.025), F.lit(0.975)))
    out = ranked.groupBy("p_brand").agg(F.min("r").alias("best"), F.max("r").alias("worst"), F.round(F.avg("r"), 6).alias("mean"), cut.alias("q"))
    return out.select("p_brand", "best", "worst", "mean", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@R.query(f"""WITH {nw.CENTRES_SQL}, {nw.BASE}, w AS (SELECT q.label = q.category AS a, k.la = k.lb AS b FROM q JOIN k ON k.query = q.vec_id AND k.rank = 1 WHERE q.place = 1),
o AS (SELECT count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second FROM w), i AS (SELECT unnest(range(0, (SELECT least(only_first, only_second) + 1 FROM o))) AS i)
SELECT any_value(only_first) AS only_first, any_value(only_second) AS only_second, round(least(1.0, 2 * sum(exp(lgamma(only_first + only_second + 1) - lgamma(i + 1) - lgamma(only_first + only_second - i + 1) - (only_first + only_second) * ln(2)))), 6) AS p FROM o, i""")
def mcnemar_test(spark: SparkSession, root: str) -> DataFrame:
    r = nw.paired_scorers(spark, root).first()
    p = models.mcnemar_exact(r["only_first"], r["only_second"])
    return spark.createDataFrame([(r["only_first"], r["only_second"], round(p, 6))], "only_first long, only_second long, p double")


@R.query()
def vuong_test(spark: SparkSession, root: str) -> DataFrame:
    s = strengths(spark, root)
    best = stats.power_law(s, "strength", 50).where("chosen").first()
    if best is None:
        return spark.createDataFrame([], "ratio double, z double, p double, preferred string")
    return models.vuong(s, "strength", best["xmin"], best["alpha"])


@R.query()
def logistic_robust(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "source_records").where("actual_harm IS NOT NULL")
    has = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "").cast("int")
    return models.logistic_hc3(rows, F.col("actual_harm").cast("int"), {"developer": has("developer"), "deployer": has("deployer"), "tracker": (F.col("source") == "OECD AIM").cast("int")})


@R.query()
def kmeans_clusters(spark: SparkSession, root: str) -> DataFrame:
    return models.kmeans_farthest_first(nw.vectors(spark, root), "vec_id", "embedding", 12)


@R.query(f"""WITH {nw.TFIDF_SQL}, m AS (SELECT d.l1_id, term, sum(weight) / (SELECT count(*) FROM d x WHERE x.l1_id = d.l1_id) AS w FROM t JOIN d ON d.l4_id = t.l4_id WHERE d.l1_id IS NOT NULL GROUP BY 1, 2)
SELECT l1_id, term, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l1_id ORDER BY round(w, 9) DESC, term) AS r FROM m) WHERE r <= 3""")
def cluster_top_terms(spark: SparkSession, root: str) -> DataFrame:
    cards = table(spark, root, "heart_l4_risk_cards").where("l1_id IS NOT NULL").select("l4_id", "l1_id")
    sizes = cards.groupBy("l1_id").agg(F.count("*").alias("n"))
    # Weights come in order of the cards, which a scan's size would have broadcast, however many they are.
    means = nw.name_weights(spark, root).join(cards.hint("merge"), "l4_id").groupBy("l1_id", "term").agg(F.sum("weight").alias("w")).join(sizes, "l1_id").select("l1_id", "term", F.round(F.col("w") / F.col("n"), 9).alias("w"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("l1_id").orderBy(F.desc("w"), "term"))).where("place <= 3").select("l1_id", "term", "place")


@R.query("""WITH d AS (SELECT doc_id, length(text) AS n, source, lang = 'en' AS en FROM documents WHERE text IS NOT NULL),
p AS (SELECT a.doc_id, b.doc_id AS match, abs(a.n - b.n) AS gap, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.n - b.n), b.doc_id) AS r FROM d a JOIN d b ON a.source = b.source AND NOT a.en AND b.en)
SELECT doc_id, match, gap FROM p WHERE r = 1 AND gap <= 50""")
def matched_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The nearest English text of the same source by length for every other text: neighbours in one sorted order, no pairs.

    The best match by length is the last one not longer or the first one not shorter, of equals the smallest
    id, which running aggregates over the sorted group carry along.
    """
    d = table(spark, root, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.length("text").alias("n"), "source", (F.col("lang") == "en").alias("en"))
    by = Window.partitionBy("source").orderBy("n")
    best = d.where("en").groupBy("source", "n").agg(F.min("doc_id").alias("match"))
    both = d.where("NOT en").select("source", "n", "doc_id", F.lit(None).cast("long").alias("match")).unionByName(best.select("source", "n", F.lit(None).cast("long").alias("doc_id"), "match"))
    held = F.when(F.col("match").isNotNull(), F.struct("n", "match"))
    below = F.last(held, ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first(held, ignorenulls=True).over(by.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"b": below, "a": above}).where("doc_id IS NOT NULL")
    pick = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("n") - F.col(f"{c}.n")).cast("long").alias("gap"), F.col(f"{c}.match").alias("match"))) for c in ("b", "a")])))
    return near.select("doc_id", pick.alias("p")).where("p.gap <= 50").select("doc_id", F.col("p.match").alias("match"), F.col("p.gap").alias("gap"))


@R.query("""WITH c AS (SELECT l4_id, substr(md5(l4_id), 1, 6) AS hex FROM heart_l4_risk_cards) SELECT l4_id, '#' || hex AS colour, CAST('0x' || substr(hex, 1, 2) AS INTEGER) AS r, CAST('0x' || substr(hex, 3, 2) AS INTEGER) AS g, CAST('0x' || substr(hex, 5, 2) AS INTEGER) AS b,
round(CASE WHEN CAST('0x' || substr(hex, 1, 2) AS INTEGER) / 255.0 <= 0.04045 THEN CAST('0x' || substr(hex, 1, 2) AS INTEGER) / 255.0 / 12.92 ELSE ((CAST('0x' || substr(hex, 1, 2) AS INTEGER) / 255.0 + 0.055) / 1.055) ** 2.4 END, 6) AS linear_r FROM c""")
def card_colours(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "heart_l4_risk_cards").select("l4_id", F.substring(F.md5(F.col("l4_id").cast("binary")), 1, 6).alias("hex"))
    part = lambda at: F.conv(F.substring("hex", at, 2), 16, 10).cast("int")
    share = F.col("r") / 255.0
    linear = F.when(share <= 0.04045, share / 12.92).otherwise(F.pow((share + 0.055) / 1.055, F.lit(2.4)))
    return rows.select("l4_id", F.concat(F.lit("#"), "hex").alias("colour"), part(1).alias("r"), part(3).alias("g"), part(5).alias("b")).withColumn("linear_r", F.round(linear, 6))


@R.query(f"""WITH {nw.BASE}, d AS (SELECT degree AS k FROM g) SELECT round(avg(k), 6) AS mean, round(quantile_cont(k, 0.5), 6) AS median, max(k) AS top, CAST(sum(k) AS BIGINT) AS ends, (SELECT 2 * count(*) FROM e) AS twice_edges FROM d""")
def conservation_report(spark: SparkSession, root: str) -> DataFrame:
    e = nw.edges(spark, root)
    d = network.degrees(nw.nodes(spark, root), e).agg(F.round(F.avg("degree"), 6).alias("mean"), F.round(F.percentile("degree", F.lit(0.5)), 6).alias("median"), F.max("degree").alias("top"), F.sum("degree").alias("ends"))
    return d.join(e.agg((2 * F.count("*")).alias("twice_edges")))


QUERIES, ORACLES = R.queries, R.oracles
