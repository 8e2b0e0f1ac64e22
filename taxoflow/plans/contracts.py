"""Queries on contracts, filters, formats and round trips through files."""

from __future__ import annotations

import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflow.functions import text as tx
from taxoflow.operators import quality, rules
from taxoflow.operators.numbering import numbered
from taxoflow.plans.records import RULES, _RULES_SQL
from taxoflow.plans.registry import Registry
from taxoflow.session import shared_folder
from taxoflow.sources import files, table

R = Registry()
PINS = {"verification_desks": 12, "zone_labels": 20, "region": 5, "nation": 25}


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS pinned, {n} AS expected, count(*) AS found, count(*) = {n} AS holds FROM {t}" for t, n in PINS.items()) + " UNION ALL SELECT 'l3 categories', 55, count(DISTINCT l3_id), count(DISTINCT l3_id) = 55 FROM heart_l4_risk_cards")
def cardinality_pins(spark: SparkSession, root: str) -> DataFrame:
    """Counts that a release fixes, each with what is found."""
    counts = {t: (n, table(spark, root, t).agg(F.count("*").alias("found"))) for t, n in PINS.items()}
    counts["l3 categories"] = (55, table(spark, root, "heart_l4_risk_cards").agg(F.count_distinct("l3_id").alias("found")))
    return quality.pinned(counts)


@R.query("""WITH s AS (SELECT case_id, l4_id, max(cosine_similarity) - min(cosine_similarity) AS d FROM case_verification_table WHERE l4_id IS NOT NULL AND NOT isnan(cosine_similarity) GROUP BY 1, 2 HAVING count(*) > 1)
SELECT tolerance, count(*) FILTER (d <= tolerance) AS within, count(*) FILTER (d > tolerance) AS beyond FROM s, (SELECT unnest([1e-12, 2e-6, 0.05]) AS tolerance) GROUP BY tolerance""")
def tolerance_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Cards listed several times in a case: how many of them agree in score by each tolerance."""
    rows = table(spark, root, "case_verification_table").where("l4_id IS NOT NULL AND cosine_similarity IS NOT NULL AND NOT isnan(cosine_similarity)")
    d = rows.groupBy("case_id", "l4_id").agg((F.max("cosine_similarity") - F.min("cosine_similarity")).alias("d"), F.count("*").alias("n")).where("n > 1")
    sums = d.agg(*[F.count_if(F.col("d") <= t).alias(str(i)) for i, t in enumerate(TOLERANCES)], F.count("*").alias("all"))
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("tolerance"), F.col(str(i)).alias("within"), (F.col("all") - F.col(str(i))).alias("beyond")) for i, t in enumerate(TOLERANCES)]))
    return sums.select(pairs.alias("p")).select("p.*")


TOLERANCES = [1e-12, 2e-6, 0.05]


@R.query("""WITH c AS (SELECT l4_id, md5(l4_id) AS h, evidence_url FROM heart_l4_risk_cards), s AS (SELECT l4_id, CASE WHEN starts_with(evidence_url, 'http') THEN 150 + CAST('0x' || substr(h, 1, 4) AS INTEGER) % 400 END AS status FROM c)
SELECT l4_id, status, CASE WHEN status IS NULL THEN 'network_error' WHEN status BETWEEN 200 AND 399 THEN 'reachable' WHEN status IN (401, 403, 429) THEN 'access_controlled' ELSE 'http_error' END AS class FROM s""")
def address_status_classes(spark: SparkSession, root: str) -> DataFrame:
    """Classes of answers of the cards' addresses; the status is drawn from the card's hash, since nothing is fetched here."""
    drawn = 150 + F.conv(F.substring(F.md5(F.col("l4_id").cast("binary")), 1, 4), 16, 10).cast("int") % 400
    rows = table(spark, root, "heart_l4_risk_cards").select("l4_id", F.when(F.col("evidence_url").startswith("http"), drawn).alias("status"))
    return rows.withColumn("class", quality.status_class(F.col("status")))


@R.query("""WITH e AS (SELECT ids, max(text_sha256) AS held, max(model_revision) AS revision FROM semantic_embeddings GROUP BY ids), t AS (SELECT l4_id, sha256(coalesce(l4_name_en, '') || chr(10) || coalesce(risk_definition_en, '')) AS now FROM heart_l4_risk_cards)
SELECT l4_id, now, min(l4_id) OVER (PARTITION BY now) AS computed_by, CASE WHEN held IS NULL THEN 'missing' WHEN held = now THEN 'cached' ELSE 'stale' END AS state FROM t LEFT JOIN e ON ids = l4_id""")
def embedding_cache_state(spark: SparkSession, root: str) -> DataFrame:
    """Whether a card's vector may be taken from the cache by the digest of its text, and which card computes each text once."""
    held = table(spark, root, "semantic_embeddings").groupBy(F.col("ids").alias("l4_id")).agg(F.max("text_sha256").alias("held"))
    now = table(spark, root, "heart_l4_risk_cards").select("l4_id", F.sha2(F.concat(F.coalesce("l4_name_en", F.lit("")), F.lit("\n"), F.coalesce("risk_definition_en", F.lit(""))), 256).alias("now"))
    first = now.groupBy("now").agg(F.min("l4_id").alias("computed_by"))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("held") == F.col("now"), "cached").otherwise("stale")
    return now.join(first, "now").join(held, "l4_id", "left").select("l4_id", "now", "computed_by", state.alias("state"))


@R.query("""SELECT taxonomy_snapshot, count(*) AS n, count(DISTINCT l4_id) AS cards, taxonomy_snapshot = (SELECT max(taxonomy_snapshot) FROM case_verification_table) AS current FROM case_verification_table GROUP BY 1""")
def release_version_guard(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each release and whether it is the current one."""
    v = table(spark, root, "case_verification_table")
    groups = v.groupBy("taxonomy_snapshot").agg(F.count("*").alias("n"), F.count_distinct("l4_id").alias("cards"))
    return groups.join(v.agg(F.max("taxonomy_snapshot").alias("last"))).select("taxonomy_snapshot", "n", "cards", (F.col("taxonomy_snapshot") == F.col("last")).alias("current"))


@R.query(r"""SELECT doc_id, md5(regexp_extract(text, '<([A-Za-z][A-Za-z0-9]*)[^>]*>', 1)) AS tag, md5(regexp_extract(text, '<[A-Za-z][A-Za-z0-9]*[^>]*>([^<]*)</', 1)) AS region FROM documents WHERE regexp_matches(text, '<[A-Za-z]')""")
def markup_regions(spark: SparkSession, root: str) -> DataFrame:
    """Name and text of the first marked-up region of every document that has one."""
    rows = table(spark, root, "documents").where(F.col("text").rlike("<[A-Za-z]"))
    digest = lambda p: F.md5(F.regexp_extract("text", p, 1).cast("binary"))
    return rows.select("doc_id", digest("<([A-Za-z][A-Za-z0-9]*)[^>]*>").alias("tag"), digest("<[A-Za-z][A-Za-z0-9]*[^>]*>([^<]*)</").alias("region"))


@R.query("SELECT record_uid, source_snapshot, list_contains(string_split(harm_types, '; '), 'physical') AS physical FROM source_records WHERE list_contains(string_split(harm_types, '; '), 'physical') OR list_contains(string_split(harm_types, '; '), 'privacy')")
def array_contains_filter(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries whose list of harms holds one of two."""
    harms = F.split("harm_types", "; ")
    rows = table(spark, root, "source_records").where(F.array_contains(harms, "physical") | F.array_contains(harms, "privacy"))
    return rows.select("record_uid", "source_snapshot", F.array_contains(harms, "physical").alias("physical"))


_PUBLISHED_SQL = r"try_cast(nullif(regexp_extract(coalesce(published_date, ''), '\b((?:19|20)[0-9]{2})\b', 1), '') AS INTEGER)"


@R.query(f"SELECT record_uid, source_snapshot, abs(event_year - {_PUBLISHED_SQL}) AS years FROM source_records WHERE abs(event_year - {_PUBLISHED_SQL}) IS NULL OR abs(event_year - {_PUBLISHED_SQL}) <= 1")
def null_tolerant_range(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries published at most a year from the event, or for which that is not known."""
    rows = table(spark, root, "source_records").withColumn("years", F.abs(F.col("event_year") - tx.year_of(F.col("published_date"))))
    return rows.where(rules.within_or_unknown(F.col("years"), 1)).select("record_uid", "source_snapshot", "years")


@R.query("""WITH w AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium,
count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS unspecified, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1)
SELECT o_custkey, concat_ws('; ', CASE WHEN urgent > 1 THEN 'urgent' END, CASE WHEN high > 1 THEN 'high' END, CASE WHEN medium > 1 THEN 'medium' END, CASE WHEN unspecified > 1 THEN 'unspecified' END, CASE WHEN low > 1 THEN 'low' END) AS repeated FROM w""")
def wide_names_above_one(spark: SparkSession, root: str) -> DataFrame:
    """Names of the wide columns whose value is above one, joined in order."""
    named = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    wide = table(spark, root, "orders").groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderpriority") == k).alias(n) for k, n in named.items()])
    return wide.select("o_custkey", tx.flags({n: F.col(n) > 1 for n in named.values()}).alias("repeated"))


@R.query("SELECT l4_id, coalesce(l1_name_en, '') || ' | ' || coalesce(l3_name_en, '') || ' | ' || coalesce(act_type, '') AS label FROM heart_l4_risk_cards")
def joined_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels joined by bars, blanks kept in their places."""
    return table(spark, root, "heart_l4_risk_cards").select("l4_id", F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in ("l1_name_en", "l3_name_en", "act_type")]).alias("label"))


@R.query("""WITH s AS (SELECT DISTINCT CASE source WHEN 'OECD AIM' THEN 'OECD_AIM' WHEN 'MIT AI Incident Tracker' THEN 'MIT' ELSE source END || ':' || source_record_id AS built, record_uid FROM source_records)
SELECT r.record_uid, r.built, c.rows FROM s r LEFT JOIN (SELECT case_id, count(*) AS rows FROM case_verification_table GROUP BY 1) c ON c.case_id = r.built""")
def alternate_key_map(spark: SparkSession, root: str) -> DataFrame:
    """Keys built of a source's short name and its own id, and the case rows that bear them."""
    short = F.when(F.col("source") == "OECD AIM", "OECD_AIM").when(F.col("source") == "MIT AI Incident Tracker", "MIT").otherwise(F.col("source"))
    built = table(spark, root, "source_records").select("record_uid", F.concat(short, F.lit(":"), "source_record_id").alias("built")).distinct()
    cases = table(spark, root, "case_verification_table").groupBy(F.col("case_id").alias("built")).agg(F.count("*").alias("rows"))
    return built.join(cases, "built", "left").select("record_uid", "built", "rows")


@R.query("""SELECT l4_id, CAST(row_number() OVER (ORDER BY CASE l1_id WHEN 'L1_G' THEN 1 WHEN 'L1_A' THEN 2 WHEN 'L1_P' THEN 3 ELSE 4 END, lower(coalesce(l3_name_en, '')), l4_id) AS BIGINT) AS place FROM heart_l4_risk_cards""")
def custom_domain_order(spark: SparkSession, root: str) -> DataFrame:
    """Places in an order of its own: domains as given, then names without regard to case."""
    order = F.coalesce(*[F.when(F.col("l1_id") == d, i) for i, d in enumerate(("L1_G", "L1_A", "L1_P"), 1)], F.lit(4))
    rows = table(spark, root, "heart_l4_risk_cards").select("l4_id", order.alias("o"), F.lower(F.coalesce("l3_name_en", F.lit(""))).alias("n"))
    return numbered(rows, ["o", "n", "l4_id"], "place").select("l4_id", "place")


def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum() or c == "_") for t in texts.to_pylist()], pa.string())


@R.query()
def compatible_form_contains(spark: SparkSession, root: str) -> DataFrame:
    """Cards whose quote holds the text 'agent' once both are in compatible form, without case and all but word characters."""
    folded = F.arrow_udf(_folded, "string").asNondeterministic()
    rows = table(spark, root, "heart_l4_risk_cards").where("evidence_quote IS NOT NULL").select("l4_id", folded("evidence_quote").alias("folded"))
    return rows.where(F.contains("folded", F.lit("agent"))).select("l4_id", F.length("folded").alias("characters"))


@R.query("SELECT DISTINCT l3_id, array_to_string(list_transform(string_split(lower(l3_name_en), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM heart_l4_risk_cards WHERE l3_name_en IS NOT NULL")
def title_case_terms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "heart_l4_risk_cards").where("l3_name_en IS NOT NULL").select("l3_id", F.initcap("l3_name_en").alias("title")).distinct()


@R.query("""WITH g AS (SELECT o_orderstatus AS status, count(*) AS n, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18, 2)))) AS BIGINT) AS total FROM orders GROUP BY 1)
SELECT status, format('{:,}', n) AS thousands, format('{:,}', total) AS total, CAST(n * 1000 // (SELECT sum(n) FROM g) // 10 AS BIGINT) || '.' || CAST(n * 1000 // (SELECT sum(n) FROM g) % 10 AS BIGINT) || '%' AS percent, lpad(CAST(n AS VARCHAR), 9, '0') AS padded FROM g""")
def number_formats(spark: SparkSession, root: str) -> DataFrame:
    """Counts and sums with thousands separators, as percent cut to one digit, and zero-padded."""
    g = table(spark, root, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.floor(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).cast("long").alias("total"))
    mille = F.expr("n * 1000 div sum(n) over ()")
    percent = F.concat(F.expr("string(m div 10)"), F.lit("."), (F.col("m") % 10).cast("string"), F.lit("%"))
    return g.withColumn("m", mille).select("status", F.format_number("n", 0).alias("thousands"), F.format_number("total", 0).alias("total"), percent.alias("percent"), F.lpad(F.col("n").cast("string"), 9, "0").alias("padded"))


@R.query("""WITH m AS (SELECT record_uid, source_snapshot, list_filter([('deployer', deployer), ('developer', developer), ('source', source), ('system', ai_system)], lambda x: nullif(trim(x[2]), '') IS NOT NULL AND x[1] <> 'source') AS m FROM source_records)
SELECT record_uid, source_snapshot, array_to_string(list_transform(m, lambda x: x[1] || '=' || x[2]), '; ') AS parties FROM m""")
def merged_maps(spark: SparkSession, root: str) -> DataFrame:
    """Two maps of a delivery merged, one key and blank values left out, as sorted text."""
    first = F.create_map(F.lit("developer"), F.col("developer"), F.lit("deployer"), F.col("deployer"))
    second = F.create_map(F.lit("system"), F.col("ai_system"), F.lit("source"), F.col("source"))
    kept = F.map_filter(F.map_concat(first, second), lambda k, v: (k != "source") & v.isNotNull() & (F.trim(v) != ""))
    parts = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, root, "source_records").select("record_uid", "source_snapshot", F.array_join(parts, "; ").alias("parties"))


_LENSES = [["robots"], ["robots", "leaks"], ["physical", "", "robots"], ["no such lens"], ["robots", "no such lens"], []]


@R.query(f"""WITH m AS ({_RULES_SQL}), c AS (SELECT l4_id, list(rule) AS held FROM (SELECT h.l4_id, m.rule FROM heart_l4_risk_cards h LEFT JOIN m ON m.l4_id = h.l4_id) GROUP BY 1),
q AS (SELECT unnest([{', '.join("'" + '+'.join(x) + "'" for x in _LENSES)}]) AS lenses)
SELECT lenses, count(c.l4_id) AS n FROM q LEFT JOIN c ON len(list_filter(string_split(lenses, '+'), lambda x: x <> '' AND NOT list_contains(held, x))) = 0 GROUP BY lenses""")
def lens_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many cards several choices of lenses leave; an unknown lens leaves none, no lens all."""
    cards = table(spark, root, "heart_l4_risk_cards")
    members = rules.members(cards, RULES, "l4_id", "l1_id", F.concat_ws(" ", "l4_name_en", "risk_definition_en"))
    parts = [rules.within_lenses(cards.select("l4_id"), "l4_id", members, chosen).agg(F.count("*").alias("n")).select(F.lit("+".join(chosen)).alias("lenses"), "n") for chosen in _LENSES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.query("""WITH h AS (SELECT DISTINCT record_uid, source_snapshot, sha256(concat_ws(chr(10), coalesce(incident_title, ''), coalesce(risk_description, ''))) AS h FROM source_records)
SELECT a.record_uid, a.source_snapshot AS earlier, b.source_snapshot AS later, a.h = b.h AS same_text FROM h a JOIN h b ON a.record_uid = b.record_uid AND a.source_snapshot < b.source_snapshot""")
def hash_verified_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Earlier and later deliveries of a record, and whether their texts have one digest."""
    h = table(spark, root, "source_records").select("record_uid", "source_snapshot", F.sha2(F.concat_ws("\n", F.coalesce("incident_title", F.lit("")), F.coalesce("risk_description", F.lit(""))), 256).alias("h")).distinct()
    a, b = h.select("record_uid", F.col("source_snapshot").alias("earlier"), F.col("h").alias("x")), h.select("record_uid", F.col("source_snapshot").alias("later"), F.col("h").alias("y"))
    return a.join(b, "record_uid").where("earlier < later").select("record_uid", "earlier", "later", (F.col("x") == F.col("y")).alias("same_text"))


@R.query("""WITH j AS (SELECT v.l4_id, v.l4_name_en AS a, c.l4_name_en AS b, v.l3_id AS x, c.l3_id AS y, c.l4_id IS NULL AS gone, v.taxonomy_snapshot AS s FROM case_verification_table v LEFT JOIN heart_l4_risk_cards c ON v.l4_id = c.l4_id)
SELECT s AS taxonomy_snapshot, count(*) AS rows, count(*) FILTER (l4_id IS NULL) AS without_card, count(*) FILTER (l4_id IS NOT NULL AND gone) AS unknown_card, count(*) FILTER (NOT gone AND a IS DISTINCT FROM b) AS other_name,
count(*) FILTER (NOT gone AND x IS DISTINCT FROM y) AS other_category, count(*) FILTER (NOT gone AND a IS NOT DISTINCT FROM b AND x IS NOT DISTINCT FROM y) AS agreeing FROM j GROUP BY 1""")
def contract_summary(spark: SparkSession, root: str) -> DataFrame:
    """One row per release: rows of the case table by how they agree with the master cards; a missing card is an error of its own."""
    v, c = table(spark, root, "case_verification_table").alias("v"), table(spark, root, "heart_l4_risk_cards").alias("c")
    j = v.join(c, F.col("v.l4_id") == F.col("c.l4_id"), "left")
    known, name, category = F.col("c.l4_id").isNotNull(), F.col("v.l4_name_en").eqNullSafe(F.col("c.l4_name_en")), F.col("v.l3_id").eqNullSafe(F.col("c.l3_id"))
    tests = {"without_card": F.col("v.l4_id").isNull(), "unknown_card": F.col("v.l4_id").isNotNull() & ~known, "other_name": known & ~name, "other_category": known & ~category, "agreeing": known & name & category}
    return j.groupBy(F.col("v.taxonomy_snapshot").alias("taxonomy_snapshot")).agg(F.count("*").alias("rows"), *[F.count_if(t).alias(n) for n, t in tests.items()])


@R.query("""SELECT (SELECT count(*) FROM heart_l4_risk_cards) AS cards, (SELECT count(DISTINCT l4_id) FROM heart_l4_risk_cards) AS distinct_cards, (SELECT count(*) FROM semantic_embeddings WHERE vectors IS NULL OR len(vectors) <> 96) AS odd_vectors,
(SELECT count(*) FROM semantic_embeddings WHERE len(list_filter(vectors, lambda x: NOT isfinite(x))) > 0) AS not_finite, (SELECT count(DISTINCT case_id) FROM case_verification_table) AS cases,
(SELECT count(*) FROM case_verification_table WHERE cosine_similarity IS NULL OR isnan(cosine_similarity)) AS without_score, (SELECT count(*) FROM case_verification_table WHERE coalesce(trim(human_verification), '') <> '') AS reserved_filled,
(SELECT count(DISTINCT l4_id) FROM heart_l4_risk_cards) = (SELECT count(*) FROM heart_l4_risk_cards) AND (SELECT count(*) FROM case_verification_table WHERE coalesce(trim(human_verification), '') <> '') = 0 AS passes""")
def release_report(spark: SparkSession, root: str) -> DataFrame:
    """One row that says whether a release holds: keys, finite vectors, scores and reserved columns."""
    bad = F.exists("vectors", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    cards = table(spark, root, "heart_l4_risk_cards").agg(F.count("*").alias("cards"), F.count_distinct("l4_id").alias("distinct_cards"))
    vectors = table(spark, root, "semantic_embeddings").agg(F.count_if(F.col("vectors").isNull() | (F.size("vectors") != 96)).alias("odd_vectors"), F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"))
    v = table(spark, root, "case_verification_table")
    cases = v.agg(F.count_distinct("case_id").alias("cases"), F.count_if(F.col("cosine_similarity").isNull() | F.isnan("cosine_similarity")).alias("without_score"), F.count_if(F.coalesce(F.trim("human_verification"), F.lit("")) != "").alias("reserved_filled"))
    return cards.join(vectors).join(cases).withColumn("passes", (F.col("cards") == F.col("distinct_cards")) & (F.col("reserved_filled") == 0))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_CARD_SQL = "SELECT l4_id, l4_name_en, md5(risk_definition_ko) AS definition, evidence_quote FROM heart_l4_risk_cards"


def _cards(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "heart_l4_risk_cards").select("l4_id", "l4_name_en", F.md5(F.col("risk_definition_ko").cast("binary")).alias("definition"), "evidence_quote")


@R.query("SELECT l4_id, nullif(l4_name_en, '') AS l4_name_en, md5(risk_definition_ko) AS definition, nullif(evidence_quote, '') AS evidence_quote FROM heart_l4_risk_cards")
def csv_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Cards written as compressed CSV with header and read again; empty texts come back as null."""
    path = _folder(spark, "csv")
    files.write_csv(_cards(spark, root), path, compression="gzip")
    return files.read_csv(spark, path, "l4_id string, l4_name_en string, definition string, evidence_quote string")


@R.query("SELECT user_id, count(*) AS n, sum(value) >= 0 AS positive FROM events GROUP BY user_id")
def csv_inferred_types(spark: SparkSession, root: str) -> DataFrame:
    """Events written as CSV and read with inferred types, then summed by user."""
    path = _folder(spark, "csv")
    files.write_csv(table(spark, root, "events").select("event_id", "user_id", "value"), path)
    return files.read_csv(spark, path, infer=True).groupBy("user_id").agg(F.count("*").alias("n"), (F.sum("value") >= 0).alias("positive"))


@R.query(_CARD_SQL)
def json_lines_round_trip(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "lines")
    cards = _cards(spark, root)
    files.write_json_lines(cards, path)
    return files.read_json_lines(spark, path, cards.schema)


@R.query("SELECT desk_id, desk_name, time_zone, date_order FROM verification_desks")
def json_array_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """A small table as one JSON array in one file, and read from it."""
    path = _folder(spark, "array")
    desks = table(spark, root, "verification_desks")
    files.write_json_array(desks, path)
    return files.read_json_array(spark, path, desks.schema)


@R.query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def parquet_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Lines written in partitions by return flag and read again with the partition column left out."""
    path = _folder(spark, "parquet")
    table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").repartition("l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_quantity")


@R.query("SELECT ids, CAST(len(vectors) AS INTEGER) AS size, CAST(vectors[1] AS DOUBLE) AS first, CAST(vectors[96] AS DOUBLE) AS last FROM semantic_embeddings WHERE len(vectors) = 96")
def npz_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Vectors packed into archives of arrays, one per batch of rows, stored, and opened again in the tasks."""
    path = _folder(spark, "npz")
    files.npz_archives(table(spark, root, "semantic_embeddings").where(F.size("vectors") == 96)).write.parquet(path)
    rows = files.vectors_of(spark.read.parquet(path))
    return rows.select("ids", F.size("vectors").alias("size"), F.element_at("vectors", 1).cast("double").alias("first"), F.element_at("vectors", 96).cast("double").alias("last"))


@R.query("SELECT CAST(row_number() OVER (ORDER BY desk_id) AS BIGINT) AS place, desk_id FROM verification_desks")
def manifest_of_files(spark: SparkSession, root: str) -> DataFrame:
    """One text file per desk, found again by the manifest of the folder, with a digest that fits the name."""
    path = _folder(spark, "manifest")
    desks = table(spark, root, "verification_desks").select("desk_id")
    desks.withColumn("value", F.col("desk_id")).repartition("desk_id").write.partitionBy("desk_id").text(path)
    found = files.file_manifest(spark, path).select(F.regexp_extract("path", "desk_id=([^/]+)/", 1).alias("desk_id"), "sha256").where("desk_id <> ''")
    kept = found.where(F.col("sha256") == F.sha2(F.concat("desk_id", F.lit("\n")), 256)).select("desk_id")
    return numbered(kept, ["desk_id"], "place").select("place", "desk_id")


@R.query("SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'")
def resumed_collection(spark: SparkSession, root: str) -> DataFrame:
    """Documents that have not landed yet, where the English ones have."""
    landed, path = table(spark, root, "documents").where("lang = 'en'").select("doc_id"), _folder(spark, "landed")
    landed.write.parquet(path)
    return files.new_rows(spark.read.parquet(path), table(spark, root, "documents").select("doc_id"), "doc_id")


QUERIES, ORACLES = R.queries, R.oracles
