"""Queries on resampling, fits and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.operators import network, numbering, similarity, stats
from taxoflow.operators.components import connected_components
from taxoflow.plans import networks as nw
from taxoflow.plans.registry import Registry
from taxoflow.session import checkpointed
from taxoflow.sources import table

R = Registry()
#: Repetitions, as in the reference: of label permutations by strata, of label shuffles over a network, of resampled
#: shares, of the tail bootstrap.
PERMUTATIONS, SHUFFLES, RESAMPLES, TAIL_REPS = 2000, 1000, 2000, 1000


@R.query(r"""WITH t AS (SELECT actual_harm AS t, regexp_matches(lower(concat_ws(' ', incident_title, risk_description)), 'fall|broken|bruises|dosage|ambulance') AS g FROM source_records WHERE actual_harm IS NOT NULL),
c AS (SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (NOT t AND NOT g) AS tn, count(*) FILTER (t AND NOT g) AS fn FROM t)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def confusion_matrix_mcc(spark: SparkSession, root: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "incident_title", "risk_description"))
    rows = table(spark, root, "source_records").where("actual_harm IS NOT NULL")
    out = stats.confusion(rows, F.col("actual_harm"), text.rlike("fall|broken|bruises|dosage|ambulance"))
    return out.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "mcc")])


@R.query("""WITH u AS (SELECT user_id, count(*) AS events FROM events GROUP BY 1), c AS (SELECT events, count(*) AS n FROM u GROUP BY 1) SELECT events, n, round(sum(n) OVER (ORDER BY events DESC) / sum(n) OVER (), 9) AS share FROM c""")
def ccdf_events_per_user(spark: SparkSession, root: str) -> DataFrame:
    users = table(spark, root, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    return stats.ccdf(users, "events").withColumn("share", F.round("share", 9))


_TAIL_SQL = f"""WITH {nw.BASE}, x AS (SELECT round(strength, 6) AS x FROM g WHERE strength > 0), m AS (SELECT DISTINCT x AS xmin FROM x),
t AS (SELECT xmin, x FROM m JOIN x ON x >= xmin), f AS (SELECT xmin, count(*) AS n, 1 + count(*) / sum(ln(x / xmin)) AS alpha FROM t GROUP BY xmin HAVING count(*) >= 50),
r AS (SELECT t.xmin, n, alpha, x, row_number() OVER (PARTITION BY t.xmin ORDER BY x) AS i FROM t JOIN f ON f.xmin = t.xmin),
fits AS (SELECT xmin, n, alpha, max(abs(i / n - (1 - (x / xmin) ** (1 - alpha)))) AS ks FROM r GROUP BY xmin, n, alpha)
SELECT xmin, n, round(alpha, 6) AS alpha, round(ks, 6) AS ks, row_number() OVER (ORDER BY round(ks, 12), xmin) = 1 AS chosen FROM fits"""


def strengths(spark: SparkSession, root: str) -> DataFrame:
    return checkpointed(network.degrees(nw.nodes(spark, root), nw.edges(spark, root)).withColumn("strength", F.round("strength", 6)))


@R.query(_TAIL_SQL)
def powerlaw_continuous_fit(spark: SparkSession, root: str) -> DataFrame:
    fits = stats.power_law(strengths(spark, root), "strength", 50)
    return fits.select("xmin", "n", F.round("alpha", 6).alias("alpha"), F.round("ks", 6).alias("ks"), "chosen")


@R.query(f"""WITH {nw.BASE}, x AS (SELECT degree AS x FROM g WHERE degree > 0), m AS (SELECT DISTINCT x AS xmin FROM x), t AS (SELECT xmin, x FROM m JOIN x ON x >= xmin),
f AS (SELECT xmin, count(*) AS n, 1 + count(*) / sum(ln(x / (xmin - 0.5))) AS alpha FROM t GROUP BY xmin HAVING count(*) >= 50),
zeta AS (SELECT xmin, sum(CAST(v AS DOUBLE) ** -alpha) + 20000.5 ** (1 - any_value(alpha)) / (any_value(alpha) - 1) AS whole FROM f, (SELECT unnest(range(1, 20001)) AS v) WHERE v >= xmin GROUP BY xmin),
r AS (SELECT t.xmin, n, alpha, x, row_number() OVER (PARTITION BY t.xmin ORDER BY x) AS i FROM t JOIN f ON f.xmin = t.xmin),
h AS (SELECT DISTINCT r.xmin, r.x, r.alpha FROM r), c AS (SELECT h.xmin, h.x, sum(CAST(v AS DOUBLE) ** -alpha) AS part FROM h, (SELECT unnest(range(1, 2001)) AS v) WHERE v >= xmin AND v <= x GROUP BY h.xmin, h.x),
fits AS (SELECT r.xmin, n, alpha, max(abs(i / n - part / whole)) AS ks FROM r JOIN c ON c.xmin = r.xmin AND c.x = r.x JOIN zeta ON zeta.xmin = r.xmin GROUP BY r.xmin, n, alpha)
SELECT CAST(xmin AS BIGINT) AS xmin, n, round(alpha, 6) AS alpha, round(ks, 6) AS ks, row_number() OVER (ORDER BY round(ks, 12), xmin) = 1 AS chosen FROM fits""")
def powerlaw_discrete_fit(spark: SparkSession, root: str) -> DataFrame:
    fits = stats.power_law(strengths(spark, root), "degree", 50, discrete=True)
    return fits.select(F.col("xmin").cast("long").alias("xmin"), "n", F.round("alpha", 6).alias("alpha"), F.round("ks", 6).alias("ks"), "chosen")


@R.query()
def tail_bootstrap_p(spark: SparkSession, root: str) -> DataFrame:
    """Share of resamples whose fit is as far off as that of the data, for strengths and for degrees."""
    s, rows = strengths(spark, root), []
    for value, discrete, seed in (("strength", False, 20261022), ("degree", True, 20261021)):
        best = stats.power_law(s, value, 50, discrete).where("chosen").first()
        if best is not None:
            reps = stats.tail_bootstrap(s, value, best, 50, TAIL_REPS, seed, discrete)
            rows.append(reps.agg(F.lit(value).alias("value"), F.count("*").alias("completed"), F.count_if("exceeds").alias("exceeding"), F.avg(F.col("exceeds").cast("int")).alias("p")))
    if not rows:
        return spark.createDataFrame([], "value string, completed long, exceeding long, p double")
    return rows[0].unionByName(rows[1]) if len(rows) == 2 else rows[0]


def rounded(tested: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return tested.select(*(extra or []), "permutations", *[F.round(c, 6).alias(c) for c in ("observed", "null_mean", "null_sd", "null_p95", "ratio", "p", "z")])


def _tested_sql(beyond: str = ">=") -> str:
    """One row from table ``nulls`` (rep, rate) and table ``seen`` (observed)."""
    return f"""SELECT count(*) AS permutations, round(any_value(observed), 6) AS observed, round(avg(rate), 6) AS null_mean, round(stddev_samp(rate), 6) AS null_sd, round(quantile_cont(rate, 0.95), 6) AS null_p95,
round(any_value(observed) / avg(rate), 6) AS ratio, round((1 + count(*) FILTER (round(rate, 12) {beyond} round(observed, 12))) / (1 + count(*)), 6) AS p, round((any_value(observed) - avg(rate)) / stddev_samp(rate), 6) AS z FROM nulls, seen"""


_LINKS_SQL = f"""{nw.BASE}, o0 AS (SELECT query || '-' || r AS id, query, r AS rank, similarity, da = 'P' AS own, db AS domain FROM l WHERE r <= 3),
cuts AS (SELECT list_sort(list_distinct(quantile_cont(similarity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS cuts FROM o0),
o AS (SELECT o0.*, greatest(len(list_filter(cuts, lambda c: round(c, 9) < similarity)) - 1, 0) AS bin FROM o0, cuts)"""


@R.query(f"""WITH {_LINKS_SQL}, j AS (SELECT *, row_number() OVER (PARTITION BY rank, bin ORDER BY id) AS j FROM o),
p AS (SELECT rep, rank, bin, domain, row_number() OVER (PARTITION BY rep, rank, bin ORDER BY md5('23|' || rep || '|' || id), id) AS j FROM o, (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS rep)),
w AS (SELECT p.rep, j.query, count(DISTINCT p.domain) >= 2 AS crossing FROM j JOIN p ON p.rank = j.rank AND p.bin = j.bin AND p.j = j.j WHERE j.own GROUP BY 1, 2), nulls AS (SELECT rep, avg(CAST(crossing AS INTEGER)) AS rate FROM w GROUP BY rep),
seen AS (SELECT avg(CAST(c AS INTEGER)) AS observed FROM (SELECT query, count(DISTINCT domain) >= 2 AS c FROM o WHERE own GROUP BY query)) {_tested_sql()}""")
def stratified_permutation_null(spark: SparkSession, root: str) -> DataFrame:
    """Share of physical queries whose three links cross domains, against domains permuted within rank and tenth of similarity."""
    own = nw.nodes(spark, root).select(F.col("node").alias("query"), (F.col("domain") == "P").alias("own"))
    links = nw.linked_domains(spark, root).where("rank <= 3").join(own, "query")
    links = links.select(F.concat_ws("-", "query", "rank").alias("id"), "query", "rank", "own", "domain", "similarity")
    rows = checkpointed(stats.quantile_bins(links, "similarity", 10))
    drawn = stats.shuffled(rows, "id", "domain", ["rank", "bin"], PERMUTATIONS, 23).join(rows.where("own").select("id", "query"), "id")
    crossing = drawn.groupBy("rep", "query").agg((F.count_distinct("permuted") >= 2).alias("c"))
    seen = rows.where("own").groupBy("query").agg((F.count_distinct("domain") >= 2).alias("c")).agg(F.avg(F.col("c").cast("int")).alias("observed"))
    return rounded(stats.permutation_test(crossing.groupBy("rep").agg(F.avg(F.col("c").cast("int")).alias("rate")), seen))


@R.query(f"""WITH {nw.BASE}, o AS (SELECT query, any_value(la < 3 OR la = 8) AS flag, max(db) FILTER (r = 1) AS home, count(DISTINCT db) FILTER (r <= 3) >= 2 AS crossing FROM l GROUP BY query), j AS (SELECT *, row_number() OVER (PARTITION BY home ORDER BY query) AS j FROM o),
p AS (SELECT rep, home, flag, row_number() OVER (PARTITION BY rep, home ORDER BY md5('29|' || rep || '|' || query), query) AS j FROM o, (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS rep)),
nulls AS (SELECT p.rep, avg(CAST(crossing AS INTEGER)) AS rate FROM j JOIN p ON p.home = j.home AND p.j = j.j WHERE p.flag GROUP BY p.rep), seen AS (SELECT avg(CAST(crossing AS INTEGER)) AS observed FROM o WHERE flag) {_tested_sql()}""")
def home_stratified_permutation(spark: SparkSession, root: str) -> DataFrame:
    """Share of flagged queries that cross domains, against flags permuted within the domain of the best link."""
    flagged = nw.vectors(spark, root).select(F.col("vec_id").alias("query"), ((F.col("label") < 3) | (F.col("label") == 8)).alias("flag"))
    g = nw.linked_domains(spark, root).where("rank <= 3").groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("domain"))).alias("home"), (F.count_distinct("domain") >= 2).alias("crossing"))
    rows = checkpointed(g.join(flagged, "query"))
    drawn = stats.shuffled(rows, "query", "flag", ["home"], PERMUTATIONS, 29).where("permuted").join(rows.select("query", "crossing"), "query")
    rate = lambda df: F.avg(F.col("crossing").cast("int"))
    return rounded(stats.permutation_test(drawn.groupBy("rep").agg(rate(drawn).alias("rate")), rows.where("flag").agg(rate(rows).alias("observed"))))


@R.query(f"""WITH u AS (SELECT user_id, count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) > 10 AS v FROM events GROUP BY user_id), n AS (SELECT count(*) AS n, count(*) FILTER (v) AS hits FROM u),
d AS (SELECT rep, CAST('0x' || substr(md5('7|' || rep || '|' || i), 1, 12) AS BIGINT) % n < hits AS hit FROM n, (SELECT unnest(range(0, (SELECT n FROM n))) AS i), (SELECT unnest(range(1, {RESAMPLES + 1})) AS rep)),
r AS (SELECT rep, count(*) FILTER (hit) / count(*) AS rate FROM d GROUP BY rep) SELECT (SELECT n FROM n) AS n, round((SELECT hits / n FROM n), 6) AS share, round(avg(rate), 6) AS mean, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM r""")
def bootstrap_rate(spark: SparkSession, root: str) -> DataFrame:
    """Share of users with more than ten events of the first kind, with its 95 % interval."""
    events = table(spark, root, "events")
    users = events.join(events.agg(F.min("event_type").alias("least"))).groupBy("user_id").agg((F.count_if(F.col("event_type") == F.col("least")) > 10).alias("v"))
    return stats.bootstrap_share(users, F.col("v"), RESAMPLES, 7).select("n", *[F.round(c, 6).alias(c) for c in ("share", "mean", "low", "high")])


@R.query(f"""WITH {nw.BASE}, j AS (SELECT vec_id AS node, domain, row_number() OVER (ORDER BY vec_id) AS j FROM v),
p AS (SELECT rep, domain, row_number() OVER (PARTITION BY rep ORDER BY md5('11|' || rep || '|' || node), node) AS j FROM j, (SELECT unnest(range(1, {SHUFFLES + 1})) AS rep)),
n AS (SELECT p.rep, j.node, p.domain FROM j JOIN p ON p.j = j.j), nulls AS (SELECT x.rep, avg(CAST(x.domain <> y.domain AS INTEGER)) AS rate FROM e JOIN n x ON x.node = src JOIN n y ON y.node = dst AND y.rep = x.rep GROUP BY x.rep),
seen AS (SELECT avg(CAST(x.domain <> y.domain AS INTEGER)) AS observed FROM e JOIN v x ON x.vec_id = src JOIN v y ON y.vec_id = dst) {_tested_sql("<=")}""")
def label_shuffle_network(spark: SparkSession, root: str) -> DataFrame:
    """Share of edges between domains against domains shuffled over all nodes; p is of the lower tail."""
    e, v = nw.edges(spark, root), checkpointed(nw.nodes(spark, root))
    labels = checkpointed(stats.shuffled(v, "node", "domain", [], SHUFFLES, 11).select("rep", "node", "permuted"))
    apart = F.avg((F.col("x") != F.col("y")).cast("int"))
    a, b = labels.select("rep", F.col("node").alias("src"), F.col("permuted").alias("x")), labels.select("rep", F.col("node").alias("dst"), F.col("permuted").alias("y"))
    nulls = e.join(a, "src").join(b, ["rep", "dst"]).groupBy("rep").agg(apart.alias("rate"))
    own = e.join(v.select(F.col("node").alias("src"), F.col("domain").alias("x")), "src").join(v.select(F.col("node").alias("dst"), F.col("domain").alias("y")), "dst")
    return rounded(stats.permutation_test(nulls, own.agg(apart.alias("observed")), lower=True))


@R.query(f"""WITH {nw.BASE}, {nw.CENTRES_SQL.replace("f AS (", "f AS (", 1)}, w AS (SELECT g.node, ln(1 + degree) AS y, z.score AS x FROM g JOIN z ON z.vec_id = g.node AND z.label = z.category)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM w""")
def simple_regression(spark: SparkSession, root: str) -> DataFrame:
    own = nw.category_scores(spark, root).where("label = category").select(F.col("vec_id").alias("node"), F.col("score").alias("x"))
    rows = network.degrees(nw.nodes(spark, root), nw.edges(spark, root)).join(own, "node").select(F.log1p("degree").alias("y"), "x")
    return rows.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


_GENERIC_SQL = f"""{nw.BASE}, f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS d FROM embeddings), m AS (SELECT d, avg(x) AS x FROM f GROUP BY d), c AS (SELECT list(x ORDER BY d) AS c FROM m),
w AS (SELECT g.node, g.domain, degree, ln(1 + degree) AS y, round(list_cosine_similarity(v.e, c.c), 9) AS x FROM g JOIN v ON v.vec_id = g.node, c), a AS (SELECT domain, avg(x) AS mx, avg(y) AS my FROM w GROUP BY domain),
slope AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) ** 2) AS b, sum((x - mx) ** 2) AS sxx, count(*) AS n FROM w JOIN a USING (domain)), r AS (SELECT w.*, my + b * (x - mx) AS expected FROM w JOIN a USING (domain), slope)"""


def generic_ness(spark: SparkSession, root: str) -> DataFrame:
    """Every node with its degree and the similarity of its vector to the mean of all vectors."""
    from taxoflow.functions.vectors import dot, unit

    v = nw.vectors(spark, root)
    centre = similarity.centroids(v.withColumn("all", F.lit(1)), "all", "embedding").select("centroid")
    x = v.join(F.broadcast(centre)).select(F.col("vec_id").alias("node"), "domain", F.round(dot(unit(F.col("embedding")), F.col("centroid")), 9).alias("x"))
    return checkpointed(network.degrees(nw.nodes(spark, root), nw.edges(spark, root)).select("node", "degree", F.log1p("degree").alias("y")).join(x, "node"))


@R.query(f"""WITH {_GENERIC_SQL} SELECT any_value(slope.n) AS n, round(any_value(slope.b), 6) AS coefficient, round(1 - sum((y - expected) ** 2) / (sum(y * y) - count(*) * avg(y) ** 2), 6) AS r_squared,
round(any_value(slope.b) / sqrt(sum((y - expected) ** 2) / (count(*) - 1 - (SELECT count(*) FROM a)) / any_value(sxx)), 5) AS t FROM r, slope""")
def ols_fixed_effects(spark: SparkSession, root: str) -> DataFrame:
    """Log degree by similarity to the mean of all vectors with one level per domain: slope, its t, and R squared."""
    fit = stats.within_regression(generic_ness(spark, root), "y", "x", "domain")
    row = fit.select("n", "levels", "slope", "sxx", "rss", "tss")
    t = F.col("slope") / F.sqrt(F.col("rss") / (F.col("n") - 1 - F.col("levels")) / F.col("sxx"))
    return row.select("n", F.round("slope", 6).alias("coefficient"), F.round(1 - F.col("rss") / F.col("tss"), 6).alias("r_squared"), F.round(t, 5).alias("t"))


@R.query(f"""WITH {_GENERIC_SQL} SELECT node, round(x, 6) AS similarity, round(expected, 6) AS expected, CAST(rank() OVER (ORDER BY round(y - expected, 9) DESC) AS BIGINT) AS residual_rank, CAST(rank() OVER (ORDER BY degree DESC) AS BIGINT) AS raw_rank FROM r""")
def hubness_residual_rank(spark: SparkSession, root: str) -> DataFrame:
    """Nodes ranked by how far their degree exceeds what similarity to the mean and domain lead one to expect."""
    rows = generic_ness(spark, root)
    fit = stats.within_regression(rows, "y", "x", "domain").select("slope")
    means = rows.groupBy("domain").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    out = rows.join(means, "domain").join(F.broadcast(fit)).withColumn("expected", F.col("my") + F.col("slope") * (F.col("x") - F.col("mx")))
    out = checkpointed(out.select("node", "degree", "x", "expected", F.round(F.col("y") - F.col("expected"), 9).alias("residual")))
    ranked = numbering.competition_rank(numbering.competition_rank(out, "residual", "residual_rank"), "degree", "raw_rank")
    return ranked.select("node", F.round("x", 6).alias("similarity"), F.round("expected", 6).alias("expected"), "residual_rank", "raw_rank")


@R.query(f"""WITH RECURSIVE {nw.BASE}, t AS (SELECT src, dst FROM e WHERE weight >= 0.35), w AS (SELECT src AS a, dst AS b FROM t UNION SELECT dst, src FROM t UNION SELECT vec_id, vec_id FROM v),
c AS (SELECT a AS node, b AS seen FROM w UNION SELECT c.node, w.b FROM c JOIN w ON w.a = c.seen), p AS (SELECT node, min(seen) AS component FROM c GROUP BY node),
x AS (SELECT label, component, count(*) AS n FROM p JOIN v ON v.vec_id = p.node GROUP BY 1, 2), q AS (SELECT sum(n * (n - 1) / 2.0) AS b, sum(n) AS n FROM x),
r AS (SELECT sum(n * (n - 1) / 2.0) AS ra FROM (SELECT sum(n) AS n FROM x GROUP BY label)), cb AS (SELECT sum(n * (n - 1) / 2.0) AS rb FROM (SELECT sum(n) AS n FROM x GROUP BY component))
SELECT round((b - ra * rb / (n * (n - 1) / 2.0)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2.0)), 9) AS ari FROM q, r, cb""")
def adjusted_rand_index(spark: SparkSession, root: str) -> DataFrame:
    c = connected_components(similarity.union_edges(nw.neighbours(spark, root, 0.35)))
    rows = nw.vectors(spark, root).join(c, F.col("vec_id") == F.col("node"), "left").select("label", F.coalesce("component", "vec_id").alias("component"))
    return stats.adjusted_rand(rows, "label", "component").select(F.round("ari", 9).alias("ari"))


@R.query()
def group_pca_coordinates(spark: SparkSession, root: str) -> DataFrame:
    """Two coordinates of every vector in its label's group: singular vectors, signs fixed by the largest entry, scaled by the largest value."""

    def flat(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"]).astype(np.float64)
        u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        k = min(2, len(s))
        sign = np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])
        xy = np.zeros((len(x), 2))
        xy[:, :k] = u[:, :k] * s[:k] * np.where(sign == 0, 1, sign)
        top = np.abs(xy).max()
        xy = xy / top if top > 0 else xy
        return pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "x": xy[:, 0].round(6), "y": xy[:, 1].round(6)})

    return nw.vectors(spark, root).select("vec_id", "label", "embedding").groupBy("label").applyInPandas(flat, "vec_id long, label int, x double, y double")


QUERIES, ORACLES = R.queries, R.oracles
