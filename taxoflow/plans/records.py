"""Queries on texts and records: cleaning, reconciling, rules, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxoflow.functions import text as tx
from taxoflow.operators import quality, reconcile, rules
from taxoflow.operators.numbering import numbered
from taxoflow.plans.registry import Registry
from taxoflow.sources import table

R = Registry()
WS = r"[ \t\n\v\f\r]+"
LAST_SQL = "source_snapshot DESC NULLS LAST, incident_title ASC NULLS LAST, risk_description ASC NULLS LAST, ai_system ASC NULLS LAST"


def latest_first() -> list[Column]:
    """Order of the deliveries of a record, the latest first."""
    return [F.col("source_snapshot").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("incident_title", "risk_description", "ai_system")]]


def filled_sql(x: str) -> str:
    return f"nullif(trim(replace({x}, chr(160), ' ')), '')"


@R.query(f"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'), ' ')) AS digest FROM documents")
def doc_clean_hash(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.sha2(tx.clean(F.col("text")), 256).alias("digest"))


def key_sql(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), ' ')"


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'), ' ')"


_ENTITIES_SQL = "coalesce(developer, '') || ' ' || coalesce(deployer, '') || ' ' || coalesce(harmed_entities, '')"


@R.query(f"""SELECT record_uid, source_snapshot, {key_sql('incident_title')} AS title_key, substr({clean_sql('event_date')}, 1, 7) AS month, {key_sql(_ENTITIES_SQL)} AS entities,
substr(sha256(concat_ws('|', {key_sql('incident_title')}, substr({clean_sql('event_date')}, 1, 10), {key_sql(_ENTITIES_SQL)})), 1, 20) AS fingerprint FROM source_records""")
def record_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    entities = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("developer", "deployer", "harmed_entities")])
    title, date = F.col("incident_title"), F.col("event_date")
    rows = table(spark, root, "source_records")
    return rows.select("record_uid", "source_snapshot", tx.title_key(title).alias("title_key"), F.substring(tx.clean(date), 1, 7).alias("month"), tx.title_key(entities).alias("entities"), tx.fingerprint(title, date, entities).alias("fingerprint"))


@R.query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def doc_exact_duplicates(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@R.query(f"SELECT record_uid, source_snapshot, incident_title FROM source_records QUALIFY row_number() OVER (PARTITION BY record_uid ORDER BY {LAST_SQL}) = 1")
def keep_last_delivery(spark: SparkSession, root: str) -> DataFrame:
    return reconcile.keep_last(table(spark, root, "source_records"), ["record_uid"], latest_first()).select("record_uid", "source_snapshot", "incident_title")


@R.query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last_event(spark: SparkSession, root: str) -> DataFrame:
    return reconcile.keep_last(table(spark, root, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@R.query("""SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, lang AS label, md5(text) AS digest FROM documents
UNION ALL SELECT 'card', l4_id, l1_id, md5(risk_definition_en) FROM heart_l4_risk_cards
UNION ALL SELECT 'record', record_uid, source, md5(risk_description) FROM source_records""")
def source_union_canonical_schema(spark: SparkSession, root: str) -> DataFrame:
    def normal(name: str, kind: str, id_: str, label: str, text: str) -> DataFrame:
        return table(spark, root, name).select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), F.col(label).alias("label"), F.md5(F.col(text).cast("binary")).alias("digest"))

    parts = normal("documents", "document", "doc_id", "lang", "text"), normal("heart_l4_risk_cards", "card", "l4_id", "l1_id", "risk_definition_en"), normal("source_records", "record", "record_uid", "source", "risk_description")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query(f"""SELECT record_uid, source_snapshot, coalesce({filled_sql('incident_title')}, {filled_sql('risk_name')}, {filled_sql('ai_system')}) AS name,
CASE WHEN {filled_sql('incident_title')} IS NOT NULL THEN 'title' WHEN {filled_sql('risk_name')} IS NOT NULL THEN 'risk' WHEN {filled_sql('ai_system')} IS NOT NULL THEN 'system' END AS given_by FROM source_records""")
def first_nonblank_coalesce(spark: SparkSession, root: str) -> DataFrame:
    names = {"title": "incident_title", "risk": "risk_name", "system": "ai_system"}
    origin = F.coalesce(*[F.when(tx.filled(F.col(c)).isNotNull(), F.lit(n)) for n, c in names.items()])
    return table(spark, root, "source_records").select("record_uid", "source_snapshot", tx.first_filled(*[F.col(c) for c in names.values()]).alias("name"), origin.alias("given_by"))


NAMED_SQL = """SELECT r.*, CAST(u.n AS BIGINT) AS entity FROM source_records r, unnest(list_distinct(regexp_extract_all(regexp_replace(canonical_aiid_id, '([0-9])[.]0+($|[^0-9])', '\\1\\2', 'g'), '[0-9]+'))) AS u(n)"""


def _named(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries, once per number that they name."""
    whole = F.regexp_replace("canonical_aiid_id", r"(\d)\.0+(?!\d)", "$1")
    return table(spark, root, "source_records").withColumn("entity", F.explode(F.array_distinct(F.regexp_extract_all(whole, F.lit("([0-9]+)"), F.lit(1))))).withColumn("entity", F.col("entity").cast("bigint"))


OVERLAID = ["risk_name", "severity_raw", "severity_normalized", "severity_provenance", "harm_types", "ai_system"]


@R.query(
    f"""WITH d AS ({NAMED_SQL}),
a AS (SELECT * FROM d WHERE source = 'AIID' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY {LAST_SQL}, record_uid) = 1),
m AS (SELECT * FROM d WHERE source = 'MIT AI Incident Tracker' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY {LAST_SQL}, record_uid) = 1),
o AS (SELECT * FROM source_records WHERE source = 'OECD AIM' AND NOT regexp_matches(coalesce(canonical_aiid_id, ''), '[0-9]') QUALIFY row_number() OVER (PARTITION BY record_uid ORDER BY {LAST_SQL}) = 1)
SELECT 'AIID:' || coalesce(a.entity, m.entity) AS canonical_incident_id, CASE WHEN a.entity IS NOT NULL THEN a.incident_title ELSE m.incident_title END AS incident_title, """
    + ", ".join(f"coalesce({filled_sql('m.' + f)}, a.{f}) AS {f}" for f in OVERLAID)
    + """, CASE WHEN m.entity IS NULL THEN 'AIID' WHEN a.entity IS NULL THEN 'MIT Tracker delta' ELSE 'AIID; MIT Tracker' END AS source_coverage FROM a FULL JOIN m ON a.entity = m.entity
UNION ALL SELECT record_uid, incident_title, """
    + ", ".join(OVERLAID)
    + ", 'OECD AIM' FROM o"
)
def full_outer_reconcile(spark: SparkSession, root: str) -> DataFrame:
    """Every incident that the database or the tracker names, the tracker's fields over the database's, and the monitor's
    records that name none."""
    rows = _named(spark, root)
    one = [reconcile.keep_last(rows.where(F.col("source") == s), ["entity"], [*latest_first(), F.col("record_uid")]).select("entity", "incident_title", *OVERLAID) for s in ("AIID", "MIT AI Incident Tracker")]
    linked = reconcile.overlay(one[0], one[1], "entity", OVERLAID, ("AIID; MIT Tracker", "AIID", "MIT Tracker delta"))
    linked = linked.select(F.concat(F.lit("AIID:"), F.col("entity").cast("string")).alias("canonical_incident_id"), "incident_title", *OVERLAID, F.col("coverage").alias("source_coverage"))
    alone = table(spark, root, "source_records").where((F.col("source") == "OECD AIM") & ~F.coalesce("canonical_aiid_id", F.lit("")).rlike("[0-9]"))
    alone = reconcile.keep_last(alone, ["record_uid"], latest_first())
    return linked.unionByName(alone.select(F.col("record_uid").alias("canonical_incident_id"), "incident_title", *OVERLAID, F.lit("OECD AIM").alias("source_coverage")))


def _longest_sql(c: str) -> str:
    f = filled_sql(c)
    return f"max(CASE WHEN {f} IS NOT NULL THEN {{'n': length({f}), 't': {f}}} END).t"


@R.query(
    f"""WITH x AS ({NAMED_SQL}), g AS (SELECT entity, {_longest_sql('incident_title')} AS t, {_longest_sql('risk_description')} AS d, {_longest_sql('ai_system')} AS s,
min(event_year) AS year, array_to_string(list_sort(list_distinct(list({filled_sql('source')}))), '; ') AS sources FROM x GROUP BY entity)
SELECT entity, t AS title, substr(concat_ws('. ', t, d, s), 1, 7000) AS text, year, sources FROM g"""
)
def canonical_texts(spark: SparkSession, root: str) -> DataFrame:
    groups = _named(spark, root).groupBy("entity").agg(
        *[reconcile.longest(F.col(c)).alias(a) for c, a in (("incident_title", "t"), ("risk_description", "d"), ("ai_system", "s"))], F.min("event_year").alias("year"), reconcile.distinct_joined(F.col("source"), "; ").alias("sources")
    )
    return groups.select("entity", F.col("t").alias("title"), tx.joined([F.col("t"), F.col("d"), F.col("s")], ". ", 7000).alias("text"), "year", "sources")


@R.query(f"""SELECT entity, count(*) AS deliveries, coalesce(bool_or(actual_harm), false) AS harmed, count(DISTINCT source) AS sources FROM ({NAMED_SQL}) GROUP BY entity""")
def multi_id_explode_group(spark: SparkSession, root: str) -> DataFrame:
    return _named(spark, root).groupBy("entity").agg(F.count("*").alias("deliveries"), F.coalesce(F.bool_or("actual_harm"), F.lit(False)).alias("harmed"), F.count_distinct("source").alias("sources"))


@R.query("SELECT v.row_id, v.l4_id, coalesce(c.l2_name_en, '') AS l2_name, coalesce(c.l3_name_en, '') AS l3_name FROM case_verification_table v LEFT JOIN heart_l4_risk_cards c ON v.l4_id = c.l4_id")
def left_lookup_enrichment(spark: SparkSession, root: str) -> DataFrame:
    cards = table(spark, root, "heart_l4_risk_cards").select("l4_id", "l2_name_en", "l3_name_en")
    rows = table(spark, root, "case_verification_table").select("row_id", "l4_id").join(cards, "l4_id", "left")
    return rows.select("row_id", "l4_id", F.coalesce("l2_name_en", F.lit("")).alias("l2_name"), F.coalesce("l3_name_en", F.lit("")).alias("l3_name"))


@R.query("SELECT v.row_id, c.l4_name_en, c.l3_id, c.l1_id FROM case_verification_table v LEFT JOIN heart_l4_risk_cards c ON v.l4_id = c.l4_id")
def denormalised_refresh(spark: SparkSession, root: str) -> DataFrame:
    master = table(spark, root, "heart_l4_risk_cards").select("l4_id", "l4_name_en", "l3_id", "l1_id")
    return table(spark, root, "case_verification_table").select("row_id", "l4_id").join(master, "l4_id", "left").drop("l4_id")


@R.query("""SELECT l_orderkey, count(*) AS n, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def array_fk_explode_join(spark: SparkSession, root: str) -> DataFrame:
    lists = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("parts"))
    rows = lists.select("l_orderkey", F.posexplode("parts").alias("at", "p_partkey")).join(table(spark, root, "part").select("p_partkey", "p_brand"), "p_partkey")
    named = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "p_brand"))).alias("b"))
    return named.select("l_orderkey", "n", F.array_join(F.transform("b", lambda s: s["p_brand"]), ",").alias("brands"))


@R.query("SELECT DISTINCT case_id FROM case_verification_table WHERE case_id IN (SELECT record_uid FROM source_records)")
def semi_join_known_cases(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "case_verification_table").select("case_id").distinct().join(table(spark, root, "source_records").select(F.col("record_uid").alias("case_id")), "case_id", "left_semi")


@R.query("SELECT DISTINCT record_uid FROM source_records r WHERE NOT EXISTS (SELECT 1 FROM case_verification_table v WHERE v.case_id = r.record_uid)")
def anti_join_unverified(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_records").select("record_uid").distinct().join(table(spark, root, "case_verification_table").select(F.col("case_id").alias("record_uid")), "record_uid", "left_anti")


@R.query("""WITH e AS (SELECT ids, count(*) AS n, count(DISTINCT text_sha256) AS digests FROM semantic_embeddings GROUP BY ids)
SELECT c.l4_id, e.n AS listed, e.digests = 1 AND e.n = 1 AS one_to_one FROM heart_l4_risk_cards c JOIN e ON c.l4_id = e.ids""")
def one_to_one_validated_join(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "semantic_embeddings").groupBy(F.col("ids").alias("l4_id")).agg(F.count("*").alias("listed"), F.count_distinct("text_sha256").alias("digests"))
    return table(spark, root, "heart_l4_risk_cards").select("l4_id").join(e, "l4_id").select("l4_id", "listed", ((F.col("digests") == 1) & (F.col("listed") == 1)).alias("one_to_one"))


@R.query("""SELECT 'card_keys' AS check_name, count(*) AS violations FROM (SELECT l4_id FROM heart_l4_risk_cards GROUP BY l4_id HAVING count(*) > 1)
UNION ALL SELECT 'case_cards', count(*) FROM case_verification_table v WHERE l4_id IS NOT NULL AND l4_id NOT IN (SELECT l4_id FROM heart_l4_risk_cards)
UNION ALL SELECT 'case_records', count(*) FROM case_verification_table v WHERE case_id NOT IN (SELECT record_uid FROM source_records)
UNION ALL SELECT 'case_desks', count(*) FROM case_verification_table v WHERE desk_id NOT IN (SELECT desk_id FROM verification_desks)
UNION ALL SELECT 'vector_cards', count(*) FROM semantic_embeddings WHERE ids NOT IN (SELECT l4_id FROM heart_l4_risk_cards)
UNION ALL SELECT 'order_customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'reserved_blank', count(*) FROM heart_l4_risk_cards WHERE coalesce(trim(probability), '') <> '' OR coalesce(trim(severity), '') <> ''""")
def referential_integrity_report(spark: SparkSession, root: str) -> DataFrame:
    v, cards = table(spark, root, "case_verification_table"), table(spark, root, "heart_l4_risk_cards")
    return quality.report(
        {
            "card_keys": quality.repeated_keys(cards, ["l4_id"]),
            "case_cards": quality.orphans(v, "l4_id", cards, "l4_id"),
            "case_records": quality.orphans(v, "case_id", table(spark, root, "source_records"), "record_uid"),
            "case_desks": quality.orphans(v, "desk_id", table(spark, root, "verification_desks"), "desk_id"),
            "vector_cards": quality.orphans(table(spark, root, "semantic_embeddings"), "ids", cards, "l4_id"),
            "order_customers": quality.orphans(table(spark, root, "orders"), "o_custkey", table(spark, root, "customer"), "c_custkey"),
            "reserved_blank": cards.where("coalesce(trim(probability), '') <> '' OR coalesce(trim(severity), '') <> ''"),
        }
    )


@R.query(f"SELECT source, lang, md5({_longest_sql('text')}) AS digest, max(length({filled_sql('text')})) AS n FROM documents GROUP BY source, lang")
def longest_text_per_group(spark: SparkSession, root: str) -> DataFrame:
    groups = table(spark, root, "documents").groupBy("source", "lang").agg(reconcile.longest(F.col("text")).alias("t"), F.max(F.length(tx.filled(F.col("text")))).cast("long").alias("n"))
    return groups.select("source", "lang", F.md5(F.col("t").cast("binary")).alias("digest"), "n")


@R.query(f"SELECT l2_id, array_to_string(list_sort(list_distinct(list({filled_sql('evidence_reference_type')}))), ' || ') AS kinds FROM heart_l4_risk_cards GROUP BY l2_id")
def sorted_distinct_concat(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "heart_l4_risk_cards").groupBy("l2_id").agg(reconcile.distinct_joined(F.col("evidence_reference_type"), " || ").alias("kinds"))


PROFILED = """source source_record_id record_uid canonical_aiid_id incident_title risk_name risk_description event_date published_date severity_raw severity_normalized severity_provenance
harm_types harmed_entities countries industry_sector ai_system developer deployer source_url report_urls source_license source_snapshot source_specific_json dedup_title_normalized dedup_date_bucket
dedup_entity_tokens dedup_fingerprint event_year report_count actual_harm near_miss_possible""".split()


@R.query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({filled_sql(f'CAST({c} AS VARCHAR)')} IS NULL) AS blank_rows, round(count(*) FILTER ({filled_sql(f'CAST({c} AS VARCHAR)')} IS NULL) / count(*), 6) AS blank_rate FROM source_records" for c in PROFILED))
def missingness_profile(spark: SparkSession, root: str) -> DataFrame:
    return quality.blank_counts(table(spark, root, "source_records"), PROFILED)


@R.query("""SELECT record_uid, source_snapshot, concat_ws('; ', CASE WHEN actual_harm THEN 'actual harm' END, CASE WHEN near_miss_possible THEN 'near miss' END, CASE WHEN report_count > 1 THEN 'several reports' END) AS basis FROM source_records""")
def flag_labels(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_records").select("record_uid", "source_snapshot", tx.flags({"actual harm": F.col("actual_harm"), "near miss": F.col("near_miss_possible"), "several reports": F.col("report_count") > 1}).alias("basis"))


@R.query("""SELECT l_orderkey, l_linenumber, measure, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME measure VALUE value) WHERE value > 0.05""")
def wide_measures_unpivot(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "measure", "value").where("value > 0.05")


_ITEMS_SQL = """list_transform(regexp_extract_all(trim(canonical_aiid_id), '[^\\[\\],''"]+'), lambda x: trim(x))"""


@R.query(f"""SELECT record_uid, source_snapshot, CASE WHEN lower(trim(coalesce(canonical_aiid_id, ''))) IN ('', 'nan', 'none') THEN '' WHEN starts_with(trim(canonical_aiid_id), '[')
THEN array_to_string(list_filter({_ITEMS_SQL}, lambda x: x <> ''), '|') ELSE trim(canonical_aiid_id) END AS items FROM source_records""")
def tolerant_list_parse(spark: SparkSession, root: str) -> DataFrame:
    items = tx.list_of(F.col("canonical_aiid_id"))
    return table(spark, root, "source_records").select("record_uid", "source_snapshot", F.array_join(items, "|").alias("items"))


@R.query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@R.query("""SELECT record_uid, source_snapshot, '{' || concat_ws(',', CASE WHEN ai_system IS NOT NULL THEN '"ai_system":' || to_json(ai_system) END, CASE WHEN developer IS NOT NULL THEN '"developer":' || to_json(developer) END,
CASE WHEN deployer IS NOT NULL THEN '"deployer":' || to_json(deployer) END, CASE WHEN report_count IS NOT NULL THEN '"report_count":' || report_count END) || '}' AS packed FROM source_records""")
def packed_fields(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "source_records").select("record_uid", "source_snapshot", "ai_system", "developer", "deployer", "report_count")
    return reconcile.packed(rows, ["record_uid", "source_snapshot"], "packed")


@R.query(r"""SELECT year, substr(event_date, 1, 7) AS month, count(*) AS n FROM (SELECT event_date, try_cast(nullif(regexp_extract(coalesce(event_date, ''), '\b((?:19|20)[0-9]{2})\b', 1), '') AS INTEGER) AS year FROM source_records) GROUP BY 1, 2""")
def year_month_buckets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_records").select(tx.year_of(F.col("event_date")).alias("year"), tx.month_of(F.col("event_date")).alias("month")).groupBy("year", "month").agg(F.count("*").alias("n"))


@R.query("""WITH c AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2),
s AS (SELECT p, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM c GROUP BY p)
SELECT s.p AS priority, strftime(s.m, '%Y-%m') AS month, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / max(c.n) OVER (PARTITION BY s.p), 6) AS height FROM s LEFT JOIN c ON s.m = c.m AND s.p = c.p""")
def monthly_bars_with_empty_months(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("n"))
    span = counts.groupBy("priority").agg(F.sequence(F.min("m"), F.max("m"), F.expr("interval 1 month")).alias("m")).select("priority", F.explode("m").alias("m"))
    rows = span.join(counts, ["priority", "m"], "left")
    return rows.select("priority", F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.max("n").over(Window.partitionBy("priority")), 6).alias("height"))


@R.query(r"""WITH u AS (SELECT 'record' AS kind, source_url AS u FROM source_records UNION ALL SELECT 'evidence', evidence_url FROM heart_l4_risk_cards UNION ALL SELECT 'case', primary_report_url FROM case_verification_table)
SELECT kind, nullif(lower(regexp_extract(coalesce(u, ''), '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS host, count(*) AS n, count(*) FILTER (starts_with(u, 'https://')) AS secure FROM u GROUP BY 1, 2""")
def url_hosts(spark: SparkSession, root: str) -> DataFrame:
    columns = {"record": ("source_records", "source_url"), "evidence": ("heart_l4_risk_cards", "evidence_url"), "case": ("case_verification_table", "primary_report_url")}
    parts = [table(spark, root, t).select(F.lit(kind).alias("kind"), F.col(c).alias("u")) for kind, (t, c) in columns.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("kind", tx.host_of(F.col("u")).alias("host"), F.coalesce(F.col("u").startswith("https://"), F.lit(False)).alias("s")).groupBy("kind", "host").agg(F.count("*").alias("n"), F.count_if("s").alias("secure"))


@R.query(f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '{WS}', ' ', 'g'), ' ')) AS digest FROM documents")
def html_strip(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.md5(tx.without_tags(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@R.query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN rtrim(substr(text, 1, 119), ' ') || '…' ELSE text END AS short FROM documents""")
def ellipsis_truncation(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", tx.shortened(F.col("text"), 120).alias("short"))


@R.query("SELECT l4_id, rtrim(regexp_replace(l4_name_en, '(.{1,24})( +|$)', '\\1' || chr(10), 'g'), chr(10)) AS wrapped FROM heart_l4_risk_cards WHERE l4_name_en IS NOT NULL")
def word_wrap(spark: SparkSession, root: str) -> DataFrame:
    """Names in lines of at most 24 characters, broken at blanks."""
    rows = table(spark, root, "heart_l4_risk_cards").where("l4_name_en IS NOT NULL")
    return rows.select("l4_id", tx.wrapped(F.col("l4_name_en"), 24).alias("wrapped"))


RULES = [
    rules.Rule("physical", domain="L1_P"),
    rules.Rule("data", prefixes=["P_DAT", "G_DAT", "A_DAT"]),
    rules.Rule("robots", gate=["L1_P", "L1_A"], terms=["robot", "truck"], patterns=["drones?\\b"]),
    rules.Rule("leaks", terms=["leakage"], exclude=["P_DAT_ZOFIFI_0004628"]),
    rules.Rule("nothing"),
]
_TEXT = "lower(concat_ws(' ', l4_name_en, risk_definition_en))"
_RULES_SQL = f"""SELECT 'physical' AS rule, l4_id FROM heart_l4_risk_cards WHERE l1_id = 'L1_P'
UNION ALL SELECT 'data', l4_id FROM heart_l4_risk_cards WHERE starts_with(l4_id, 'P_DAT_') OR starts_with(l4_id, 'G_DAT_') OR starts_with(l4_id, 'A_DAT_')
UNION ALL SELECT 'robots', l4_id FROM heart_l4_risk_cards WHERE l1_id IN ('L1_P', 'L1_A') AND (contains({_TEXT}, 'robot') OR contains({_TEXT}, 'truck') OR regexp_matches({_TEXT}, 'drones?\\b'))
UNION ALL SELECT 'leaks', l4_id FROM heart_l4_risk_cards WHERE contains({_TEXT}, 'leakage') AND l4_id <> 'P_DAT_ZOFIFI_0004628'"""


def _members(spark: SparkSession, root: str) -> DataFrame:
    return rules.members(table(spark, root, "heart_l4_risk_cards"), RULES, "l4_id", "l1_id", F.concat_ws(" ", "l4_name_en", "risk_definition_en"))


@R.query(_RULES_SQL)
def rule_engine_membership(spark: SparkSession, root: str) -> DataFrame:
    return _members(spark, root)


@R.query(f"WITH m AS ({_RULES_SQL}) SELECT l4_id FROM heart_l4_risk_cards WHERE l4_id IN (SELECT l4_id FROM m WHERE rule = 'robots') AND l4_id IN (SELECT l4_id FROM m WHERE rule = 'physical')")
def lens_intersection(spark: SparkSession, root: str) -> DataFrame:
    return rules.within_lenses(table(spark, root, "heart_l4_risk_cards").select("l4_id"), "l4_id", _members(spark, root), ["robots", "", "physical"])


@R.query("""SELECT l4_id, l4_name_en FROM heart_l4_risk_cards WHERE l1_id = 'L1_G' AND contains(lower(concat_ws(' ', l4_id, l4_name_en, l4_name_ko, risk_definition_en, risk_definition_ko, l3_name_en, facet, act_type)), 'agent') ORDER BY l4_id LIMIT 48 OFFSET 0""")
def faceted_search(spark: SparkSession, root: str) -> DataFrame:
    fields = ["l4_id", "l4_name_en", "l4_name_ko", "risk_definition_en", "risk_definition_ko", "l3_name_en", "facet", "act_type"]
    return rules.faceted(table(spark, root, "heart_l4_risk_cards"), {"l1_id": "L1_G", "facet": None}, fields, "Agent").select("l4_id", "l4_name_en").orderBy("l4_id").limit(48)


@R.query("""SELECT l4_id, l4_name_en FROM heart_l4_risk_cards ORDER BY l1_id, l3_id, l4_id LIMIT 48 OFFSET 48""")
def second_page(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "heart_l4_risk_cards").orderBy("l1_id", "l3_id", "l4_id").offset(48).limit(48).select("l4_id", "l4_name_en")


@R.query(r"""WITH t AS (SELECT record_uid, source_snapshot, lower(concat_ws(' ', incident_title, risk_description)) AS t FROM source_records)
SELECT record_uid, source_snapshot, count(*) AS n FROM t WHERE regexp_matches(t, 'robot|drone|vehicle|truck|shuttle') AND NOT regexp_matches(t, 'chat|essay|hiring') GROUP BY 1, 2""")
def regex_pos_neg_screen(spark: SparkSession, root: str) -> DataFrame:
    t = F.lower(F.concat_ws(" ", "incident_title", "risk_description"))
    rows = table(spark, root, "source_records").where(t.rlike("robot|drone|vehicle|truck|shuttle") & ~t.rlike("chat|essay|hiring"))
    return rows.groupBy("record_uid", "source_snapshot").agg(F.count("*").alias("n"))


SCREEN = {"request": ("asked|request|instruction", 2), "harm": ("fall|damage|bruises|broken", 2), "agent": ("agent", 1)}


@R.query(r"""WITH t AS (SELECT doc_id, lower(text) AS t, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS base FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, base, regexp_matches(t, 'asked|request|instruction') AS a, regexp_matches(t, 'fall|damage|bruises|broken') AS b, regexp_matches(t, 'agent') AS c FROM t)
SELECT doc_id, CAST(2 * CAST(a AS INTEGER) + 2 * CAST(b AS INTEGER) + CAST(c AS INTEGER) + base AS INTEGER) AS score, concat_ws('; ', CASE WHEN a THEN 'request' END, CASE WHEN b THEN 'harm' END, CASE WHEN c THEN 'agent' END) AS reasons FROM h WHERE a OR b OR c""")
def scored_screening(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents").where("text IS NOT NULL")
    return rules.screened(rows, F.col("text"), SCREEN, F.when(F.col("lang") == "en", 1).otherwise(0)).select("doc_id", "score", "reasons")


@R.query("""SELECT substr(l4_id, 1, 5) AS prefix, count(*) AS n, count(*) FILTER (starts_with(evidence_url, 'http')) AS linked, count(DISTINCT l3_id) AS l3s FROM heart_l4_risk_cards GROUP BY 1""")
def prefix_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "heart_l4_risk_cards").groupBy(F.substring("l4_id", 1, 5).alias("prefix")).agg(F.count("*").alias("n"), F.count_if(F.col("evidence_url").startswith("http")).alias("linked"), F.count_distinct("l3_id").alias("l3s"))


@R.query("SELECT l4_id, len(list_filter(string_split_regex(trim(evidence_quote), ' +'), lambda x: x <> '')) AS words FROM heart_l4_risk_cards WHERE evidence_quote IS NOT NULL")
def quote_word_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "heart_l4_risk_cards").where("evidence_quote IS NOT NULL")
    return rows.select("l4_id", F.size(F.filter(F.split(F.trim("evidence_quote"), " +"), lambda x: x != "")).cast("long").alias("words"))


@R.query("""SELECT l4_id, 'HV-' || lpad(CAST(row_number() OVER (ORDER BY l1_id, l3_id, l4_id) AS VARCHAR), 6, '0') AS sequence_id FROM heart_l4_risk_cards""")
def padded_sequence_ids(spark: SparkSession, root: str) -> DataFrame:
    rows = numbered(table(spark, root, "heart_l4_risk_cards").select("l4_id", "l1_id", "l3_id"), ["l1_id", "l3_id", "l4_id"], "at")
    return rows.select("l4_id", F.concat(F.lit("HV-"), F.lpad(F.col("at").cast("string"), 6, "0")).alias("sequence_id"))


@R.query("""WITH m AS (SELECT * FROM (VALUES ('L1_P', 'Physical'), ('L1_A', 'Agentic')) AS t(k, v)) SELECT l4_id, coalesce(m.v, 'General') AS domain_name FROM heart_l4_risk_cards LEFT JOIN m ON l1_id = m.k""")
def value_map_with_default(spark: SparkSession, root: str) -> DataFrame:
    named = F.create_map(F.lit("L1_P"), F.lit("Physical"), F.lit("L1_A"), F.lit("Agentic"))
    return table(spark, root, "heart_l4_risk_cards").select("l4_id", F.coalesce(F.try_element_at(named, F.coalesce("l1_id", F.lit(""))), F.lit("General")).alias("domain_name"))


QUERIES, ORACLES = R.queries, R.oracles
