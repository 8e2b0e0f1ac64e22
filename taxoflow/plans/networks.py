"""Queries on similarity links, projections and graph measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxoflow.operators import matching, network, numbering, reconcile, rules, similarity, stats
from taxoflow.operators.components import connected_components
from taxoflow.plans.registry import Registry
from taxoflow.session import checkpointed
from taxoflow.sources import table

R = Registry()
DOMAIN_SQL = "CASE WHEN label < 6 THEN 'G' WHEN label < 8 THEN 'A' ELSE 'P' END"
NEAR, LEAST, LINKS = 8, 0.25, 5
THRESHOLDS = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
BASE = f"""v AS (SELECT vec_id, label, {DOMAIN_SQL} AS domain, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS item, a.label AS la, b.label AS lb, a.domain AS da, b.domain AS db, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM s),
e AS (SELECT DISTINCT least(query, item) AS src, greatest(query, item) AS dst, similarity AS weight FROM k WHERE rank <= {NEAR} AND similarity >= {LEAST}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS r FROM s WHERE la <> lb) WHERE r <= {LINKS}),
b AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
g AS (SELECT v.vec_id AS node, v.domain, count(b.other) AS degree, coalesce(sum(b.weight), 0) AS strength, count(*) FILTER (o.domain <> v.domain) AS cross_edges, count(DISTINCT o.domain) AS reached
  FROM v LEFT JOIN b ON b.node = v.vec_id LEFT JOIN v o ON o.vec_id = b.other GROUP BY 1, 2)"""


def _domain() -> Column:
    return F.when(F.col("label") < 6, "G").when(F.col("label") < 8, "A").otherwise("P")


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", "label", _domain().alias("domain"), "embedding")


def nodes(spark: SparkSession, root: str) -> DataFrame:
    return vectors(spark, root).select(F.col("vec_id").alias("node"), "domain")


def neighbours(spark: SparkSession, root: str, least: float | None = LEAST) -> DataFrame:
    v = vectors(spark, root)
    return similarity.top_similar(v, v, "vec_id", "embedding", NEAR, least=least)


def edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of the neighbour graph, computed once."""
    return checkpointed(similarity.union_edges(neighbours(spark, root)))


def links(spark: SparkSession, root: str) -> DataFrame:
    """The best items of other labels for every vector."""
    v = vectors(spark, root)
    return similarity.top_similar(v, v, "vec_id", "embedding", LINKS, part="label")


def linked_domains(spark: SparkSession, root: str) -> DataFrame:
    return links(spark, root).join(nodes(spark, root).select(F.col("node").alias("item"), "domain"), "item")


@R.query(f"WITH {BASE} SELECT query, item, similarity, CAST(r AS INTEGER) AS rank, r <= 3 AS in_k3 FROM l")
def topk_similarity_link(spark: SparkSession, root: str) -> DataFrame:
    return links(spark, root).select("query", "item", "similarity", "rank", (F.col("rank") <= 3).alias("in_k3"))


@R.query(f"""WITH {BASE}, f AS (SELECT query, r, db AS domain FROM l)
SELECT query, array_to_string(list_sort(list_distinct(list(domain) FILTER (r <= 3))), ';') AS domains_3, count(DISTINCT domain) FILTER (r <= 3) > 1 AS cross_3,
array_to_string(list_sort(list_distinct(list(domain))), ';') AS domains_5, count(DISTINCT domain) > 1 AS cross_5, bool_or(domain = 'P') AS physical_5 FROM f GROUP BY query""")
def domain_sets_k3_k5(spark: SparkSession, root: str) -> DataFrame:
    rows = linked_domains(spark, root)

    def sets(k: int) -> DataFrame:
        g = rows.where(F.col("rank") <= k).groupBy("query").agg(F.array_sort(F.collect_set("domain")).alias("d"), F.bool_or(F.col("domain") == "P").alias(f"physical_{k}"))
        return g.select("query", F.array_join("d", ";").alias(f"domains_{k}"), (F.size("d") > 1).alias(f"cross_{k}"), f"physical_{k}")

    return sets(3).join(sets(5), "query").select("query", "domains_3", "cross_3", "domains_5", "cross_5", "physical_5")


@R.query(f"WITH {BASE} SELECT query, max(item) FILTER (r = 1) AS first, max(item) FILTER (r = 2) AS second, max(item) FILTER (r = 3) AS third FROM l GROUP BY query")
def pivot_top3(spark: SparkSession, root: str) -> DataFrame:
    wide = links(spark, root).groupBy("query").pivot("rank", [1, 2, 3]).agg(F.max("item"))
    return wide.select("query", F.col("1").alias("first"), F.col("2").alias("second"), F.col("3").alias("third"))


@R.query(f"WITH {BASE} SELECT src, dst, weight FROM e")
def knn_union_edges(spark: SparkSession, root: str) -> DataFrame:
    return similarity.union_edges(neighbours(spark, root))


@R.query(f"""WITH {BASE} SELECT node, domain, degree, round(strength, 6) AS strength, cross_edges, round(coalesce(cross_edges / nullif(degree, 0), 0), 6) AS share, reached,
CAST(row_number() OVER (ORDER BY degree DESC, round(strength, 6) DESC, node) AS INTEGER) AS rank FROM g""")
def knn_graph_hub_ranking(spark: SparkSession, root: str) -> DataFrame:
    profile = network.domain_profile(nodes(spark, root), edges(spark, root))
    out = profile.select("node", "domain", "degree", F.round("strength", 6).alias("strength"), F.col("cross").alias("cross_edges"), F.round("share", 6).alias("share"), "reached")
    return numbering.numbered(out, [F.desc("degree"), F.desc("strength"), "node"], "rank").withColumn("rank", F.col("rank").cast("int"))


@R.query(f"""WITH RECURSIVE {BASE}, t AS (SELECT unnest({THRESHOLDS}) AS threshold), x AS (SELECT DISTINCT t.threshold, least(query, item) AS src, greatest(query, item) AS dst FROM k, t WHERE rank <= {NEAR} AND similarity >= t.threshold),
y AS (SELECT threshold, src AS a, dst AS b FROM x UNION SELECT threshold, dst, src FROM x UNION SELECT threshold, vec_id, vec_id FROM v, t), c AS (SELECT threshold, a AS node, b AS seen FROM y UNION SELECT c.threshold, c.node, y.b FROM c JOIN y ON y.a = c.seen AND y.threshold = c.threshold),
p AS (SELECT threshold, node, min(seen) AS component FROM c GROUP BY 1, 2), z AS (SELECT p.threshold, label, component, count(*) AS n FROM p JOIN v ON vec_id = node GROUP BY 1, 2, 3),
q AS (SELECT threshold, sum(n * (n - 1) / 2.0) AS both_, sum(n) * (sum(n) - 1) / 2.0 AS pairs, count(DISTINCT component) AS components FROM z GROUP BY 1), ra AS (SELECT threshold, sum(m * (m - 1) / 2.0) AS a FROM (SELECT threshold, label, sum(n) AS m FROM z GROUP BY 1, 2) GROUP BY 1),
rb AS (SELECT threshold, sum(m * (m - 1) / 2.0) AS b, count(*) FILTER (m = 1) AS isolates FROM (SELECT threshold, component, sum(n) AS m FROM z GROUP BY 1, 2) GROUP BY 1), n AS (SELECT threshold, count(*) AS edges FROM x GROUP BY 1)
SELECT q.threshold, coalesce(edges, 0) AS edges, isolates, components, round((both_ - a * b / pairs) / ((a + b) / 2 - a * b / pairs), 6) AS ari FROM q JOIN ra USING (threshold) JOIN rb USING (threshold) LEFT JOIN n USING (threshold)""")
def threshold_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Edges, isolated nodes, components and their agreement with the labels, by least similarity.

    The graphs of all thresholds are one: a node of each is numbered by threshold and node.
    """
    e = checkpointed(similarity.union_edges(neighbours(spark, root, None)).withColumn("step", F.explode(F.filter(F.transform(F.array(*[F.lit(t) for t in THRESHOLDS]), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda s: s["t"] <= F.col("weight")))))
    step = lambda c: F.struct(F.col("step.i").alias("i"), F.col(c).alias("node"))
    found = connected_components(e.select(step("src").alias("src"), step("dst").alias("dst")))
    every = vectors(spark, root).select("vec_id", "label", F.explode(F.array(*[F.lit(i) for i in range(len(THRESHOLDS))])).alias("i"))
    rows = every.join(found.select("node.i", F.col("node.node").alias("vec_id"), F.col("component.node").alias("component")), ["i", "vec_id"], "left")
    rows = rows.select("i", "label", F.coalesce("component", "vec_id").alias("component"))
    half = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = checkpointed(rows.groupBy("i", "label", "component").agg(F.count("*").alias("n")))
    q = cells.groupBy("i").agg(F.sum(half("n")).alias("both"), F.sum("n").alias("n"))
    a = cells.groupBy("i", "label").agg(F.sum("n").alias("m")).groupBy("i").agg(F.sum(half("m")).alias("a"))
    b = cells.groupBy("i", "component").agg(F.sum("n").alias("m")).groupBy("i").agg(F.sum(half("m")).alias("b"), F.count_if(F.col("m") == 1).alias("isolates"), F.count("*").alias("components"))
    counted = e.groupBy(F.col("step.i").alias("i")).agg(F.count("*").alias("edges"))
    chance = F.col("a") * F.col("b") / half("n")
    ari = F.try_divide(F.col("both") - chance, (F.col("a") + F.col("b")) / 2 - chance)
    return q.join(a, "i").join(b, "i").join(counted, "i", "left").select(F.array(*[F.lit(t) for t in THRESHOLDS])[F.col("i")].alias("threshold"), F.coalesce("edges", F.lit(0)).alias("edges"), "isolates", "components", F.round(ari, 6).alias("ari"))


BRANDS_SQL = """h AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT i, count(*) AS n FROM h GROUP BY i),
p AS (SELECT a.i AS src, b.i AS dst, count(*) AS together FROM h a JOIN h b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2),
j AS (SELECT p.*, x.n AS n_a, y.n AS n_b, together / (x.n + y.n - together) AS jaccard, together / sqrt(CAST(x.n AS DOUBLE) * y.n) AS weight FROM p JOIN n x ON x.i = src JOIN n y ON y.i = dst)"""


def held(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, root, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").select("l_orderkey", "p_brand")


def brand_pairs(spark: SparkSession, root: str) -> DataFrame:
    return network.projection(held(spark, root), "l_orderkey", "p_brand")


@R.query(f"WITH {BRANDS_SQL} SELECT src, dst, together, n_a, n_b, round(jaccard, 9) AS jaccard, round(weight, 9) AS association FROM j")
def basket_pair_counts(spark: SparkSession, root: str) -> DataFrame:
    return brand_pairs(spark, root).withColumns({"jaccard": F.round("jaccard", 9), "association": F.round("association", 9)})


@R.query(f"WITH {BRANDS_SQL} SELECT src, dst, together, round(together * 1000.0 / (SELECT count(DISTINCT o) FROM h), 6) AS per_1000 FROM j ORDER BY together DESC, src, dst LIMIT 15")
def pair_rate_per_1000(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "lineitem").agg(F.count_distinct("l_orderkey").alias("n"))
    rows = brand_pairs(spark, root).join(n).select("src", "dst", "together", F.round(F.col("together") * 1000.0 / F.col("n"), 6).alias("per_1000"))
    return rows.orderBy(F.desc("together"), "src", "dst").limit(15)


@R.query(f"""WITH {BRANDS_SQL} SELECT count(*) AS edges, (SELECT count(*) FROM n) AS nodes, round(2.0 * count(*) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 9) AS density, CAST(sum(together) AS BIGINT) AS links FROM j""")
def degree_centrality_density(spark: SparkSession, root: str) -> DataFrame:
    n = held(spark, root).agg(F.count_distinct("p_brand").alias("nodes"))
    sums = brand_pairs(spark, root).agg(F.count("*").alias("edges"), F.sum("together").alias("links")).join(n)
    return sums.select("edges", "nodes", F.round(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9).alias("density"), "links")


def _status_edges(spark: SparkSession, root: str, status: str) -> DataFrame:
    kept = table(spark, root, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("l_orderkey"))
    return network.projection(held(spark, root).join(kept, "l_orderkey", "left_semi"), "l_orderkey", "p_brand").select("src", "dst", F.col("together").alias("weight"))


@R.query("""WITH h AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i, o_orderstatus AS s FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O'))
SELECT a.i AS src, b.i AS dst, count(*) AS weight FROM h a JOIN h b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2""")
def weighted_graph_union(spark: SparkSession, root: str) -> DataFrame:
    return _status_edges(spark, root, "F").unionByName(_status_edges(spark, root, "O")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


@R.query("""WITH h AS (SELECT DISTINCT year(o_orderdate) AS y, l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT y, count(DISTINCT o) AS n FROM h GROUP BY y)
SELECT a.y AS year, a.i AS src, b.i AS dst, count(*) AS together, round(count(*) * 1000.0 / any_value(n.n), 6) AS per_1000 FROM h a JOIN h b ON a.o = b.o AND a.i < b.i JOIN n ON n.y = a.y GROUP BY 1, 2, 3""")
def annual_slice_networks(spark: SparkSession, root: str) -> DataFrame:
    years = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("long").alias("year"))
    h = held(spark, root).join(years, "l_orderkey").distinct()
    n = h.groupBy("year").agg(F.count_distinct("l_orderkey").alias("n"))
    pairs = h.select("year", "l_orderkey", F.col("p_brand").alias("src")).join(h.select("l_orderkey", F.col("p_brand").alias("dst")), "l_orderkey").where("src < dst")
    counts = pairs.groupBy("year", "src", "dst").agg(F.count("*").alias("together")).join(n, "year")
    return counts.select("year", "src", "dst", "together", F.round(F.col("together") * 1000.0 / F.col("n"), 6).alias("per_1000"))


@R.query("""WITH h AS (SELECT DISTINCT year(o_orderdate) AS y, l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey),
p AS (SELECT a.y, a.i AS src, b.i AS dst, count(*) AS w FROM h a JOIN h b ON a.o = b.o AND a.i < b.i GROUP BY 1, 2, 3), b AS (SELECT y, src AS node, dst AS other, w FROM p UNION ALL SELECT y, dst, src, w FROM p),
g AS (SELECT y, node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS strength FROM b GROUP BY 1, 2), n AS (SELECT y, count(*) AS nodes FROM g GROUP BY 1)
SELECT g.y AS year, node, degree, strength, round(degree / (nodes - 1), 6) AS centrality, CAST(row_number() OVER (PARTITION BY g.y ORDER BY strength DESC, node) AS INTEGER) AS rank FROM g JOIN n ON n.y = g.y QUALIFY row_number() OVER (PARTITION BY g.y ORDER BY strength DESC, node) <= 10""")
def annual_centralities(spark: SparkSession, root: str) -> DataFrame:
    """The ten strongest brands of every year's network, with degree centrality d / (n - 1)."""
    years = table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("long").alias("year"))
    h = checkpointed(held(spark, root).join(years, "l_orderkey").distinct())
    pairs = h.select("year", "l_orderkey", F.col("p_brand").alias("node")).join(h.select("l_orderkey", F.col("p_brand").alias("other")), "l_orderkey").where("node <> other")
    g = pairs.groupBy("year", "node", "other").agg(F.count("*").alias("w")).groupBy("year", "node").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    n = g.groupBy("year").agg(F.count("*").alias("nodes"))
    place = Window.partitionBy("year").orderBy(F.desc("strength"), "node")
    out = g.join(n, "year").select("year", "node", "degree", "strength", F.round(F.try_divide(F.col("degree"), F.col("nodes") - 1), 6).alias("centrality"))
    return out.withColumn("rank", F.row_number().over(place)).where("rank <= 10")


@R.query(f"""WITH {BASE}, size AS (SELECT count(*) FILTER (domain = 'P') AS n FROM v), r AS (SELECT unnest(range(1, 51)) AS rep),
kept AS (SELECT rep, vec_id FROM v, r WHERE domain <> 'G' UNION ALL SELECT rep, vec_id FROM (SELECT rep, vec_id, row_number() OVER (PARTITION BY rep ORDER BY md5('31|' || rep || '|' || vec_id), vec_id) AS j FROM v, r WHERE domain = 'G'), size WHERE j <= n),
x AS (SELECT rep, query, count(DISTINCT db) > 1 AS c FROM l JOIN kept ON kept.vec_id = l.item GROUP BY 1, 2), t AS (SELECT rep, avg(CAST(c AS INTEGER)) AS rate FROM x GROUP BY rep)
SELECT count(*) AS repetitions, round(avg(rate), 6) AS mean, round(min(rate), 6) AS least, round(max(rate), 6) AS most FROM t""")
def domain_rarefaction(spark: SparkSession, root: str) -> DataFrame:
    """Share of queries whose links cross domains when the general items are thinned to as many as the physical ones."""
    v = nodes(spark, root)
    size = v.agg(F.count_if(F.col("domain") == "P").alias("n"))
    drawn = stats.replicated(v.where("domain = 'G'"), 50)
    order = Window.partitionBy("rep").orderBy(stats.keyed(31, F.col("rep"), F.col("node")), "node")
    thinned = drawn.withColumn("j", F.row_number().over(order)).join(size).where("j <= n").select("rep", F.col("node").alias("item"))
    kept = stats.replicated(v.where("domain <> 'G'").select(F.col("node").alias("item")), 50).select("rep", "item").unionByName(thinned)
    crossing = linked_domains(spark, root).join(kept, "item").groupBy("rep", "query").agg((F.count_distinct("domain") > 1).alias("c"))
    rates = crossing.groupBy("rep").agg(F.avg(F.col("c").cast("int")).alias("rate"))
    return rates.agg(F.count("*").alias("repetitions"), F.round(F.avg("rate"), 6).alias("mean"), F.round(F.min("rate"), 6).alias("least"), F.round(F.max("rate"), 6).alias("most"))


@R.query(f"""WITH {BRANDS_SQL}, c AS (SELECT i FROM (SELECT i, row_number() OVER (PARTITION BY substr(i, 7, 1) ORDER BY n DESC, i) AS r FROM n) WHERE r <= 3)
SELECT src, dst, together AS weight FROM j WHERE src IN (SELECT i FROM c) AND dst IN (SELECT i FROM c) ORDER BY together DESC, src, dst LIMIT 40""")
def induced_overview_subgraph(spark: SparkSession, root: str) -> DataFrame:
    counts = held(spark, root).distinct().groupBy(F.col("p_brand").alias("node")).agg(F.count("*").alias("n")).withColumn("domain", F.substring("node", 7, 1))
    return network.overview(counts, brand_pairs(spark, root).select("src", "dst", F.col("together").alias("weight")), 3, 40)


@R.query(f"""WITH {BASE} SELECT concat_ws('-', least(x.domain, y.domain), greatest(x.domain, y.domain)) AS pair, count(*) AS edges, bool_or(x.domain <> y.domain) AS crosses FROM e JOIN v x ON x.vec_id = src JOIN v y ON y.vec_id = dst GROUP BY 1""")
def domain_pair_counts(spark: SparkSession, root: str) -> DataFrame:
    return network.domain_pairs(nodes(spark, root), edges(spark, root))


@R.query(f"WITH {BASE} SELECT CAST(sum(cross_edges) / 2 AS BIGINT) AS cross_edges, CAST(sum(degree) / 2 AS BIGINT) AS edges, round(sum(cross_edges) / sum(degree), 6) AS share, count(*) FILTER (degree = 0) AS isolates FROM g")
def cross_domain_edges(spark: SparkSession, root: str) -> DataFrame:
    p = network.domain_profile(nodes(spark, root), edges(spark, root)).agg(F.sum("cross").alias("c"), F.sum("degree").alias("d"), F.count_if(F.col("degree") == 0).alias("isolates"))
    return p.select((F.col("c") / 2).cast("long").alias("cross_edges"), (F.col("d") / 2).cast("long").alias("edges"), F.round(F.col("c") / F.col("d"), 6).alias("share"), "isolates")


@R.query(f"WITH {BASE} SELECT b.node, o.domain AS neighbour_domain, count(*) AS n FROM b JOIN v o ON o.vec_id = b.other GROUP BY 1, 2")
def neighbor_domain_profile(spark: SparkSession, root: str) -> DataFrame:
    other = nodes(spark, root).select(F.col("node").alias("other"), F.col("domain").alias("neighbour_domain"))
    return network.both_ways(edges(spark, root)).join(other, "other").groupBy("node", "neighbour_domain").agg(F.count("*").alias("n"))


@R.query(f"""WITH RECURSIVE {BASE}, t AS (SELECT src, dst FROM e WHERE weight >= 0.35), w AS (SELECT src AS a, dst AS b FROM t UNION SELECT dst, src FROM t UNION SELECT src, src FROM t UNION SELECT dst, dst FROM t),
c AS (SELECT a AS node, b AS seen FROM w UNION SELECT c.node, w.b FROM c JOIN w ON w.a = c.seen) SELECT node, min(seen) AS component FROM c GROUP BY node""")
def component_labels(spark: SparkSession, root: str) -> DataFrame:
    return connected_components(similarity.union_edges(neighbours(spark, root, 0.35)))


@R.query(f"WITH {BASE} SELECT degree, count(*) AS n FROM g GROUP BY degree")
def degree_histogram(spark: SparkSession, root: str) -> DataFrame:
    return network.degrees(nodes(spark, root), edges(spark, root)).groupBy("degree").agg(F.count("*").alias("n"))


@R.query(f"""WITH {BASE}, m AS (SELECT sum(weight) AS m FROM e), i AS (SELECT x.domain, sum(weight) AS inside FROM e JOIN v x ON x.vec_id = src JOIN v y ON y.vec_id = dst AND x.domain = y.domain GROUP BY 1),
a AS (SELECT domain, sum(strength) AS ends FROM g GROUP BY 1) SELECT round(sum(coalesce(inside, 0) / m - (ends / (2 * m)) ** 2), 9) AS modularity FROM a LEFT JOIN i USING (domain), m""")
def modularity_of_given_partition(spark: SparkSession, root: str) -> DataFrame:
    return network.modularity(nodes(spark, root), edges(spark, root)).select(F.round("modularity", 9).alias("modularity"))


@R.query(f"""WITH {BASE}, x AS (SELECT p.domain AS a, q.domain AS b, count(*) / (SELECT count(*) FROM b) AS e FROM b t JOIN v p ON p.vec_id = t.node JOIN v q ON q.vec_id = t.other GROUP BY 1, 2),
y AS (SELECT a, sum(e) AS s, sum(e) FILTER (a = b) AS d FROM x GROUP BY a) SELECT round((sum(d) - sum(s * s)) / (1 - sum(s * s)), 9) AS assortativity FROM y""")
def nominal_assortativity(spark: SparkSession, root: str) -> DataFrame:
    return network.nominal_assortativity(nodes(spark, root), edges(spark, root)).select(F.round("assortativity", 9).alias("assortativity"))


@R.query(f"WITH {BASE} SELECT round(corr(x.strength, y.strength), 9) AS assortativity FROM b JOIN g x ON x.node = b.node JOIN g y ON y.node = b.other")
def degree_assortativity(spark: SparkSession, root: str) -> DataFrame:
    return network.degree_assortativity(nodes(spark, root), edges(spark, root)).select(F.round("assortativity", 9).alias("assortativity"))


@R.query(f"""WITH {BASE}, w AS (SELECT src, dst, weight / (SELECT max(weight) FROM e) AS w FROM e),
t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, cbrt(x.w * y.w * z.w) AS q FROM w x JOIN w y ON x.src = y.src AND x.dst < y.dst JOIN w z ON z.src = x.dst AND z.dst = y.dst),
u AS (SELECT node, count(*) AS triangles, sum(q) AS q FROM (SELECT a AS node, q FROM t UNION ALL SELECT b, q FROM t UNION ALL SELECT c, q FROM t) GROUP BY node)
SELECT g.node, coalesce(triangles, 0) AS triangles, round(coalesce(q / nullif(degree * (degree - 1) / 2, 0), 0), 9) AS clustering FROM g LEFT JOIN u ON u.node = g.node""")
def clustering_coefficient(spark: SparkSession, root: str) -> DataFrame:
    return network.clustering(nodes(spark, root), edges(spark, root)).withColumn("clustering", F.round("clustering", 9))


@R.query(f"""WITH RECURSIVE {BASE}, o AS (SELECT node, other, weight / sum(weight) OVER (PARTITION BY node) AS p FROM b), c AS (SELECT count(*) AS n FROM v),
q AS (SELECT 0 AS it, node, 1.0::DOUBLE / n AS rank FROM g, c
  UNION ALL SELECT any_value(q.it) + 1, x.node, 0.15 / any_value(c.n) + 0.85 * (coalesce(sum(q.rank * o.p) FILTER (o.p IS NOT NULL), 0)
  + (SELECT coalesce(sum(z.rank), 0) FROM q z JOIN g h ON h.node = z.node WHERE h.degree = 0) / any_value(c.n)) FROM g x CROSS JOIN c CROSS JOIN q LEFT JOIN o ON o.node = q.node AND o.other = x.node WHERE q.it < 20 GROUP BY x.node)
SELECT node, round(rank, 8) AS rank FROM q WHERE it = 20""")
def pagerank_20_iterations(spark: SparkSession, root: str) -> DataFrame:
    return network.pagerank(nodes(spark, root), edges(spark, root), 20).select("node", F.round("rank", 8).alias("rank"))


@R.query()
def bridge_table(spark: SparkSession, root: str) -> DataFrame:
    e = edges(spark, root)
    rows = network.betweenness(e).join(network.domain_profile(nodes(spark, root), e), "node")
    ranked = rows.select("node", "domain", F.round("betweenness", 12).alias("betweenness"), "degree", "cross", F.round("share", 6).alias("share"))
    # The limit comes first, so that the numbers are given to 20 rows.
    return ranked.orderBy(F.desc("betweenness"), "node").limit(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("betweenness"), "node")))


@R.query()
def louvain_communities(spark: SparkSession, root: str) -> DataFrame:
    return network.louvain(edges(spark, root))


@R.query(f"""WITH {BASE}, a AS (SELECT db AS domain, count(*) / (SELECT count(*) FROM l) AS share FROM l GROUP BY 1), c AS (SELECT domain, count(*) / (SELECT count(*) FROM v) AS share FROM v GROUP BY 1)
SELECT domain, round(a.share / c.share, 6) AS ratio FROM a JOIN c USING (domain)""")
def revelation_ratio(spark: SparkSession, root: str) -> DataFrame:
    whole = Window.partitionBy()
    a = linked_domains(spark, root).groupBy("domain").agg(F.count("*").alias("n")).select("domain", (F.col("n") / F.sum("n").over(whole)).alias("a"))
    c = nodes(spark, root).groupBy("domain").agg(F.count("*").alias("n")).select("domain", (F.col("n") / F.sum("n").over(whole)).alias("c"))
    return a.join(c, "domain").select("domain", F.round(F.col("a") / F.col("c"), 6).alias("ratio"))


CENTRES_SQL = """f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS d FROM embeddings),
m AS (SELECT label, d, avg(x) AS x FROM f GROUP BY 1, 2), c AS (SELECT label AS category, list(x ORDER BY d) AS c FROM m GROUP BY label),
z AS (SELECT v.vec_id, v.label, c.category, round(list_cosine_similarity(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)), c.c), 6) AS score FROM embeddings v, c),
q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, category) AS place FROM z)"""


def category_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every vector against every category's centroid, with the place of each category; the categories are few and joined as such."""
    from taxoflow.functions.vectors import dot, unit

    v = vectors(spark, root)
    c = similarity.centroids(v, "label", "embedding").select(F.col("label").alias("category"), "centroid")
    scored = v.join(c).select("vec_id", "label", "category", F.round(dot(unit(F.col("embedding")), F.col("centroid")), 6).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "category")))


@R.query(f"WITH {CENTRES_SQL} SELECT vec_id, max(score) FILTER (label = category) AS own, max(score) FILTER (label <> category) AS other, round(0.35 / (1 + exp((max(score) FILTER (label = category) - max(score) FILTER (label <> category)) / 0.05)), 6) AS blend FROM z GROUP BY vec_id")
def centroid_affinity_margin(spark: SparkSession, root: str) -> DataFrame:
    own = F.col("label") == F.col("category")
    g = category_scores(spark, root).groupBy("vec_id").agg(F.max(F.when(own, F.col("score"))).alias("own"), F.max(F.when(~own, F.col("score"))).alias("other"))
    return g.select("vec_id", "own", "other", F.round(0.35 / (1 + F.exp((F.col("own") - F.col("other")) / 0.05)), 6).alias("blend"))


@R.query(f"WITH {CENTRES_SQL} SELECT count(*) AS n, round(avg(CAST(place = 1 AS INTEGER)), 6) AS top_1, round(avg(CAST(place <= 3 AS INTEGER)), 6) AS top_3, round(avg(1.0 / place), 6) AS mrr FROM q WHERE label = category")
def nearest_category_eval(spark: SparkSession, root: str) -> DataFrame:
    rows = category_scores(spark, root).where("label = category")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("place") == 1).cast("int")), 6).alias("top_1"), F.round(F.avg((F.col("place") <= 3).cast("int")), 6).alias("top_3"), F.round(F.avg(1.0 / F.col("place")), 6).alias("mrr"))


@R.query(f"""WITH {CENTRES_SQL}, g AS (SELECT vec_id, label, category AS guess FROM q WHERE place = 1), a AS (SELECT label, count(*) AS n FROM g GROUP BY 1), p AS (SELECT guess AS label, count(*) AS n, count(*) FILTER (guess = label) AS hit FROM g GROUP BY 1)
SELECT a.label, a.n, coalesce(hit, 0) AS hits, round(2.0 * coalesce(hit, 0) / (a.n + coalesce(p.n, 0)), 6) AS f1 FROM a LEFT JOIN p ON p.label = a.label""")
def category_f1(spark: SparkSession, root: str) -> DataFrame:
    g = category_scores(spark, root).where("place = 1")
    a = g.groupBy("label").agg(F.count("*").alias("n"))
    p = g.groupBy(F.col("category").alias("label")).agg(F.count("*").alias("m"), F.count_if(F.col("label") == F.col("category")).alias("hits"))
    return a.join(p, "label", "left").select("label", "n", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(2.0 * F.coalesce("hits", F.lit(0)) / (F.col("n") + F.coalesce("m", F.lit(0))), 6).alias("f1"))


@R.query(f"""WITH {CENTRES_SQL}, {BASE.replace("v AS (", "v AS (", 1)}, w AS (SELECT q.vec_id, q.label = q.category AS a, k.la = k.lb AS b FROM q JOIN k ON k.query = q.vec_id AND k.rank = 1 WHERE q.place = 1)
SELECT count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second, count(*) FILTER (a AND b) AS both FROM w""")
def paired_scorers(spark: SparkSession, root: str) -> DataFrame:
    v = vectors(spark, root)
    first = category_scores(spark, root).where("place = 1").select(F.col("vec_id").alias("query"), "label", (F.col("label") == F.col("category")).alias("a"))
    near = neighbours(spark, root, None).where("rank = 1").join(v.select(F.col("vec_id").alias("item"), F.col("label").alias("other")), "item").select("query", "other")
    rows = first.join(near, "query").withColumn("b", F.col("label") == F.col("other"))
    return rows.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(F.col("b") & ~F.col("a")).alias("only_second"), F.count_if(F.col("a") & F.col("b")).alias("both"))


#: Words that the features of names and stories leave out; a parameter of the features.
STOP = "a an the and or of to in on for by from with without as at is are be that this it its their which when where while into over under than not can may will should has have had".split()
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def _grams_sql(words: str) -> str:
    kept = f"list_filter({words}, lambda w: NOT list_contains({_STOP_SQL}, w))"
    return f"list_concat({kept}, list_transform(list_zip({kept}[1:-2], {kept}[2:]), lambda p: p[1] || ' ' || p[2]))"


_NAME_TEXT = "lower(coalesce(l4_name_en, '') || ' ' || coalesce(l4_name_en, '') || ' ' || coalesce(risk_definition_en, ''))"
TFIDF_SQL = f"""d AS (SELECT l4_id, l1_id, {_grams_sql(f"regexp_extract_all({_NAME_TEXT}, '[a-z]{{3,}}')")} AS w FROM heart_l4_risk_cards), x AS (SELECT l4_id, term, count(*) AS tf FROM d, unnest(w) AS u(term) GROUP BY 1, 2),
y AS (SELECT term, count(*) AS df FROM x GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.75 * (SELECT count(*) FROM d)),
r AS (SELECT l4_id, x.term, (1 + ln(tf)) * (1 + ln((1 + (SELECT count(*) FROM d)) / (1 + df))) AS w FROM x JOIN y ON y.term = x.term),
t AS (SELECT l4_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY l4_id)) AS weight FROM r)"""


def name_weights(spark: SparkSession, root: str) -> DataFrame:
    """Weights of the words and word pairs of every card's name, counted twice, and definition."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("l4_name_en", "l4_name_en", "risk_definition_en")]))
    return matching.weights(table(spark, root, "heart_l4_risk_cards"), "l4_id", matching.grams(F.regexp_extract_all(text, F.lit("([a-z]{3,})"), F.lit(1)), STOP), most=0.75, least=2)


@R.query(f"WITH {TFIDF_SQL} SELECT l4_id, term, round(weight, 6) AS weight FROM t")
def tfidf_weights(spark: SparkSession, root: str) -> DataFrame:
    return name_weights(spark, root).select("l4_id", "term", F.round("weight", 6).alias("weight"))


_PAIRS_SQL = f"{TFIDF_SQL}, s AS (SELECT a.l4_id, b.l4_id AS other, round(sum(a.weight * b.weight), 6) AS score FROM t a JOIN t b ON a.term = b.term AND a.l4_id <> b.l4_id GROUP BY 1, 2)"


@R.query(f"""WITH {_PAIRS_SQL}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l4_id ORDER BY score DESC, other) = 1) SELECT f.* FROM f JOIN d a ON a.l4_id = f.l4_id JOIN d b ON b.l4_id = f.other WHERE score >= 0.55 AND a.l1_id = b.l1_id""")
def name_match_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The best match of every card by name and definition, if it is good enough and of the same domain."""
    t = name_weights(spark, root)
    best = matching.cosine_pairs(t, t, "l4_id", 0.55, k=1)
    cards = table(spark, root, "heart_l4_risk_cards").select("l4_id", "l1_id")
    return best.join(cards, "l4_id").join(cards.select(F.col("l4_id").alias("other"), F.col("l1_id").alias("l1_other")), "other").where("l1_id = l1_other").select("l4_id", "other", "score")


@R.query(f"WITH {_PAIRS_SQL}, n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l4_id ORDER BY score DESC, other) <= 3) SELECT DISTINCT least(l4_id, other) AS src, greatest(l4_id, other) AS dst, score AS weight FROM n WHERE score >= 0.3")
def name_neighbour_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges to the three nearest cards by name and definition, from a similarity of 0.3 on."""
    t = name_weights(spark, root)
    links = matching.cosine_pairs(t, t, "l4_id", 0.3, k=3)
    return links.select(F.least("l4_id", "other").alias("src"), F.greatest("l4_id", "other").alias("dst"), F.col("score").alias("weight")).distinct()


#: Least similarity of a candidate; the records of the tables are less alike than those it is 0.55 for.
MATCH = 0.3
_LATEST_SQL = "SELECT * FROM source_records QUALIFY row_number() OVER (PARTITION BY record_uid ORDER BY source_snapshot DESC NULLS LAST, incident_title ASC NULLS LAST, risk_description ASC NULLS LAST, ai_system ASC NULLS LAST) = 1"
_STORY_SQL = f"""d AS (SELECT record_uid, source, event_year, regexp_matches(coalesce(canonical_aiid_id, ''), '[0-9]') AS linked, {_grams_sql("regexp_extract_all(lower(coalesce(incident_title, '') || ' ' || coalesce(risk_description, '')), '[a-z0-9_]{2,}')")} AS w FROM ({_LATEST_SQL}) WHERE source IN ('AIID', 'OECD AIM')),
x AS (SELECT record_uid, term, count(*) AS tf FROM d, unnest(w) AS u(term) GROUP BY 1, 2), y AS (SELECT term, count(*) AS df FROM x GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 80000),
r AS (SELECT record_uid, x.term, tf * (1 + ln((1 + (SELECT count(*) FROM d)) / (1 + df))) AS w FROM x JOIN y ON y.term = x.term), t AS (SELECT record_uid, term, w / sqrt(sum(w * w) OVER (PARTITION BY record_uid)) AS weight FROM r)"""


def story_weights(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Latest records of the database and the monitor, and the weights of their words and word pairs."""
    order = [F.col("source_snapshot").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("incident_title", "risk_description", "ai_system")]]
    rows = reconcile.keep_last(table(spark, root, "source_records"), ["record_uid"], order).where(F.col("source").isin("AIID", "OECD AIM"))
    text = F.lower(F.concat(F.coalesce("incident_title", F.lit("")), F.lit(" "), F.coalesce("risk_description", F.lit(""))))
    linked = F.coalesce("canonical_aiid_id", F.lit("")).rlike("[0-9]").alias("linked")
    rows = checkpointed(rows.select("record_uid", "source", "event_year", linked, matching.grams(F.regexp_extract_all(text, F.lit("([a-z0-9_]{2,})"), F.lit(1)), STOP).alias("w")))
    return rows, checkpointed(matching.weights(rows, "record_uid", F.col("w"), log_tf=False, features=80_000))


@R.query(f"WITH {_STORY_SQL} SELECT record_uid, count(*) AS terms, round(max(weight), 6) AS heaviest FROM t GROUP BY record_uid")
def story_features(spark: SparkSession, root: str) -> DataFrame:
    _, t = story_weights(spark, root)
    return t.groupBy("record_uid").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("heaviest"))


@R.query(f"""WITH {_STORY_SQL}, s AS (SELECT a.record_uid, b.record_uid AS other, round(sum(a.weight * b.weight), 6) AS score FROM t a JOIN d p ON p.record_uid = a.record_uid AND p.source = 'OECD AIM' JOIN t b ON a.term = b.term JOIN d q ON q.record_uid = b.record_uid AND q.source = 'AIID' GROUP BY 1, 2),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY record_uid ORDER BY score DESC, other) = 1)
SELECT f.record_uid, other, score, abs(p.event_year - q.event_year) AS years FROM f JOIN d p ON p.record_uid = f.record_uid JOIN d q ON q.record_uid = f.other WHERE NOT p.linked AND score >= {MATCH} AND (abs(p.event_year - q.event_year) IS NULL OR abs(p.event_year - q.event_year) <= 1)""")
def record_match_candidates(spark: SparkSession, root: str) -> DataFrame:
    """For monitor records that name no incident the best match in the database, if good enough and not over a year apart."""
    rows, t = story_weights(spark, root)
    of = lambda s: t.join(rows.where(F.col("source") == s).select("record_uid"), "record_uid", "left_semi")
    best = matching.cosine_pairs(of("OECD AIM"), of("AIID"), "record_uid", MATCH, k=1)
    asked = rows.where("NOT linked").select("record_uid", "event_year")
    both = best.join(asked, "record_uid").join(rows.select(F.col("record_uid").alias("other"), F.col("event_year").alias("other_year")), "other")
    both = both.withColumn("years", F.abs(F.col("event_year") - F.col("other_year")))
    return both.where(rules.within_or_unknown(F.col("years"), 1)).select("record_uid", "other", "score", "years")


@R.query(f"""WITH {BASE}, s2 AS (SELECT label, vec_id, e[1] AS x, e[2] AS y FROM v), m AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM s2 GROUP BY label) SELECT label, round(mx, 6) AS x, round(my, 6) AS y,
(SELECT count(*) FROM s2 WHERE s2.label = m.label) AS n FROM m""")
def mean_coordinates(spark: SparkSession, root: str) -> DataFrame:
    rows = vectors(spark, root).select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rows.groupBy("label").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.count("*").alias("n"))


@R.query("""WITH c AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), b AS (SELECT label, min(x) AS low, max(x) AS high, avg(x) AS mean FROM c GROUP BY label), w AS (SELECT c.*, low, high, mean, max(abs(x - mean)) OVER (PARTITION BY label) AS far FROM c JOIN b USING (label))
SELECT vec_id, round((x - low) / nullif(high - low, 0), 6) AS between, round((x - mean) / nullif(far, 0), 6) AS centred FROM w""")
def scaled_coordinates(spark: SparkSession, root: str) -> DataFrame:
    """First coordinates brought between 0 and 1, and centred and scaled to 1, within each label."""
    rows = vectors(spark, root).select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    bounds = rows.groupBy("label").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"))
    far = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    return rows.join(bounds, "label").select("vec_id", F.round(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")), 6).alias("between"), F.round(F.try_divide(F.col("x") - F.col("mean"), far), 6).alias("centred"))


@R.query(f"WITH {BASE}, r AS (SELECT v.label, g.node, round(strength, 6) AS strength FROM g JOIN v ON v.vec_id = g.node) SELECT label, node, strength, strength = max(strength) OVER (PARTITION BY label) AS strongest FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY strength DESC, node) <= 2")
def label_representatives(spark: SparkSession, root: str) -> DataFrame:
    """The two strongest nodes of every label, and whether each has its label's greatest strength."""
    d = network.degrees(nodes(spark, root), edges(spark, root)).select("node", F.round("strength", 6).alias("strength"))
    rows = d.join(vectors(spark, root).select(F.col("vec_id").alias("node"), "label"), "node")
    w = Window.partitionBy("label").orderBy(F.desc("strength"), "node")
    top = rows.withColumn("n", F.row_number().over(w)).where("n <= 2")
    return top.select("label", "node", "strength", (F.col("strength") == F.max("strength").over(Window.partitionBy("label"))).alias("strongest"))


@R.query()
def leading_components(spark: SparkSession, root: str) -> DataFrame:
    """48 coordinates of every vector along the directions of largest variance."""
    return matching.leading_components(table(spark, root, "embeddings"), "vec_id", "embedding", 64, 48)


@R.query(f"""WITH {BASE}, p AS (SELECT node, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS x, rank() OVER (ORDER BY round(strength, 6)) + (count(*) OVER (PARTITION BY round(strength, 6)) - 1) / 2.0 AS y FROM g) SELECT round(corr(x, y), 9) AS rho FROM p""")
def spearman_degree_strength(spark: SparkSession, root: str) -> DataFrame:
    d = checkpointed(network.degrees(nodes(spark, root), edges(spark, root)).withColumn("strength", F.round("strength", 6)))
    rows = stats.average_ranks(stats.average_ranks(d, "degree", "x"), "strength", "y")
    return rows.agg(F.round(F.corr("x", "y"), 9).alias("rho"))


QUERIES, ORACLES = R.queries, R.oracles
