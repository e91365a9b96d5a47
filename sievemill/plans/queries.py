"""Registered queries over the given tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import keys, text, times
from sievemill.operators import aggregates, joins, relevance, tables, windows

NOW = "2024-06-01 12:00:00"
TITLES = [
    "Data Engineer", "Machine Learning Engineer", "Python Backend Developer", "Senior Python Developer", "Recruiter", "Delineante BIM", "Diseñador gráfico", "Soldador", "Programador PLC", "Robotics Engineer IoT",
    "Developer", "Data Analyst", "Automation Engineer", "Ingeniero de Caminos", "Camarero", "Sales Manager", "Técnico SCADA Python", "Django Developer", "Analista SQL", "AI Researcher",
]
LOCATIONS = ["Valencia", "Madrid", "Remoto", "Barcelona", "Paterna, Valencia", "España", "Teletrabajo", ""]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings_view(docs: DataFrame, *more: str) -> DataFrame:
    """Documents seen as listings: a pure projection. Columns of ``more`` are kept."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    d = F.col("doc_id")
    return docs.select(
        d.cast("string").alias("job_id"),
        F.when(d % 3 == 0, "linkedin").otherwise(F.col("source")).alias("source"),
        pick(TITLES, d % 20).alias("title"),
        F.concat(F.lit("Company "), (d % 37).cast("string")).alias("company"),
        pick(LOCATIONS, d % 8).alias("location"),
        F.concat(F.lit("HTTPS://Jobs.Example.com/View//"), (d % 500 + 100000).cast("string"), F.lit("/?utm_source=x&ref=y&f_TPR=r"), (d % 5 * 900).cast("string"), F.lit("&id="), d.cast("string"), F.lit("#top")).alias("url"),
        F.col("text").alias("description"),
        F.concat(F.lit("Hace "), (d % 90).cast("string"), F.lit(" minutos")).alias("posted_text"),
        d.alias("seq"), *more,
    )


VIEW = f"""WITH v AS (SELECT CAST(doc_id AS VARCHAR) job_id, CASE WHEN doc_id % 3 = 0 THEN 'linkedin' ELSE source END AS source,
  {_sql_list(TITLES)}[doc_id % 20 + 1] title, 'Company ' || (doc_id % 37) company, {_sql_list(LOCATIONS)}[doc_id % 8 + 1] AS location,
  'HTTPS://Jobs.Example.com/View//' || (doc_id % 500 + 100000) || '/?utm_source=x&ref=y&f_TPR=r' || (doc_id % 5 * 900) || '&id=' || doc_id || '#top' url,
  text description, 'Hace ' || (doc_id % 90) || ' minutos' posted_text, doc_id seq FROM documents) """


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings_view(table(spark, sf_dir, "documents"))


def q_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return listings(spark, sf_dir).select(
        "job_id", *[keys.canonical_url(u, m).alias(f"url_{m}") for m in ("key", "view", "tracked", "exact")], keys.url_param(u, "F_tpr").alias("window"), keys.window_seconds(u, "f_TPR").alias("seconds"),
        keys.set_url_param(u, "f_TPR", 60).alias("rewritten"), keys.job_key(F.col("source"), F.col("job_id"), u).alias("key"), keys.stable_id(F.col("source"), u, F.col("title"), F.col("company"), F.col("location")).alias("stable_id"),
        keys.numeric_id(F.col("job_id"), u).alias("numeric_id"), keys.canonical_identity(F.col("job_id"), u).alias("identity"), keys.content_fingerprint("v1", F.col("title"), F.col("company"), F.col("location")).alias("fingerprint"),
    )


O_KEYS = (
    VIEW
    + r"""SELECT job_id, 'https://jobs.example.com/View//' || (seq % 500 + 100000) url_key, 'HTTPS://Jobs.Example.com/View//' || (seq % 500 + 100000) url_view,
 'https://jobs.example.com/View/' || (seq % 500 + 100000) || '/?f_TPR=r' || (seq % 5 * 900) || '&id=' || seq url_tracked, regexp_replace(url, '#.*$', '') url_exact,
 'r' || (seq % 5 * 900) AS window, CASE WHEN seq % 5 > 0 THEN seq % 5 * 900 END AS seconds, regexp_replace(url, 'f_TPR=[^&#]*', 'f_TPR=r60') rewritten,
 substr(sha256(source || chr(31) || job_id || chr(31) || 'https://jobs.example.com/View//' || (seq % 500 + 100000)), 1, 24) AS key,
 source || '_' || substr(sha256('https://jobs.example.com/View/' || (seq % 500 + 100000) || '/?f_TPR=r' || (seq % 5 * 900) || '&id=' || seq), 1, 20) stable_id,
 coalesce(nullif(regexp_extract(job_id, '(\d{6,})', 1), ''), regexp_extract(url, '(\d{6,})', 1)) numeric_id, 'id:' || coalesce(nullif(regexp_extract(job_id, '(\d{6,})', 1), ''), regexp_extract(url, '(\d{6,})', 1)) AS identity,
 sha256('v1' || chr(31) || lower(title) || chr(31) || lower(company) || chr(31) || lower(location)) fingerprint FROM v"""
)

TERMS = ["the", "of", "und", "que", "mit license", "token"]


def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.norm_text(F.col("description"))
    rows = listings(spark, sf_dir).withColumn("n", t)
    return rows.select("job_id", F.array_join(text.match_terms(F.col("n"), TERMS), ",").alias("terms"), text.phrase_match(F.col("title"), "data  ENGINEER").alias("phrase"), F.array_join(text.named_features(F.col("title"), {"data": ["data", "datos"], "dev": [r"developer\b"]}), ",").alias("labels"))


O_TERMS = (
    VIEW
    + """SELECT job_id, array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN regexp_matches(translate(lower(description), 'áàâäãåéèêëíìîïóòôöõúùûüýÿñç', 'aaaaaaeeeeiiiiooooouuuuyync'), '(^|[^a-z0-9]){t.replace(' ', chr(92) + 's+')}([^a-z0-9]|$)') THEN '{t}' END" for t in TERMS)
    + """], lambda x: x IS NOT NULL), ',') terms, title = 'Data Engineer' phrase,
 array_to_string(list_filter([CASE WHEN regexp_matches(lower(title), 'data|datos') THEN 'data' END, CASE WHEN regexp_matches(lower(title), 'developer') THEN 'dev' END], lambda x: x IS NOT NULL), ',') labels FROM v"""
)


def q_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    raw = F.when(d % 4 == 0, (d + 1700000000).cast("string")).when(d % 4 == 1, F.concat(F.lit("2024-03-0"), (d % 9 + 1).cast("string"), F.lit("T10:20:30Z"))).when(d % 4 == 2, F.concat(F.lit("Mon, 0"), (d % 9 + 1).cast("string"), F.lit(" Jan 2024 08:00:00 +0200"))).otherwise("soon")
    said = F.when(d % 4 == 0, F.concat(F.lit("Hace "), d.cast("string"), F.lit(" horas"))).when(d % 4 == 1, F.concat(d.cast("string"), F.lit(" days ago"))).when(d % 4 == 2, "Just now").otherwise("2 meses")
    rows = e.select("doc_id", raw.alias("raw"), said.alias("said"))
    return rows.select("doc_id", F.unix_timestamp(times.parse_ts(F.col("raw"))).alias("ts"), times.relative_age_seconds(F.col("said")).alias("age"), times.published_age_seconds(F.col("raw"), F.lit(NOW).cast("timestamp")).alias("published_age"), times.nonneg_int(F.when(d % 2 == 0, (d - 10).cast("string")).otherwise("x")).alias("n"))


O_TIMES = """SELECT doc_id,
 CASE doc_id % 4 WHEN 0 THEN doc_id + 1700000000 WHEN 1 THEN CAST(epoch(CAST('2024-03-0' || (doc_id % 9 + 1) || ' 10:20:30' AS TIMESTAMP)) AS BIGINT) WHEN 2 THEN CAST(epoch(CAST('2024-01-0' || (doc_id % 9 + 1) || ' 06:00:00' AS TIMESTAMP)) AS BIGINT) END ts,
 CASE doc_id % 4 WHEN 0 THEN doc_id * 3600 WHEN 1 THEN doc_id * 86400 WHEN 2 THEN 0 END age,
 CASE doc_id % 4 WHEN 1 THEN CAST(epoch(TIMESTAMP '2024-06-01 12:00:00') - epoch(CAST('2024-03-0' || (doc_id % 9 + 1) || ' 10:20:30' AS TIMESTAMP)) AS BIGINT) WHEN 2 THEN CAST(epoch(TIMESTAMP '2024-06-01 12:00:00') - epoch(CAST('2024-01-0' || (doc_id % 9 + 1) || ' 06:00:00' AS TIMESTAMP)) AS BIGINT) END published_age,
 CASE WHEN doc_id % 2 = 0 THEN greatest(doc_id - 10, 0) ELSE 0 END n FROM documents"""


def q_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.classify_relevance(listings(spark, sf_dir)).select("job_id", "decision.status", "decision.score", "decision.family", "decision.needs_description")


def _sql_norm(c: str) -> str:
    """Normal form of a text in SQL."""
    return rf"trim(regexp_replace(lower(translate({c}, '{text._ACCENTED}', '{text._PLAIN}')), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def _sql_any(c: str, terms: list[str]) -> str:
    return rf"regexp_matches({c}, '(^|[^a-z0-9])({'|'.join(map(re.escape, terms))})([^a-z0-9]|$)')"


def _sql_score(c: str, terms: list[str], rules: relevance.RulePack) -> str:
    """Sum of the best weights of the terms: by what stands in the 60 characters before a hit."""
    no, weak = "|".join(rules.negations), "|".join(rules.weak)
    hits = lambda t: rf"regexp_extract_all({c}, '(.{{0,59}}?(?:^|[^a-z0-9])){re.escape(t)}(?:[^a-z0-9]|$)', 1)"
    return "(" + " + ".join(f"coalesce(list_max(list_transform({hits(t)}, lambda w: CASE WHEN regexp_matches(w, '{no}') THEN 0 WHEN regexp_matches(w, '{weak}') THEN 1 ELSE 4 END)), 0)" for t in terms) + ")"


def _sql_relevance() -> str:
    """The waterfall over the listings view, from the same term lists."""
    r = relevance.RulePack()
    heads, bodies = ("unwanted", "hr", "cad", "graphic", "mechanical", "plc"), ("ai", "data", "software", "generic", "industrial", "analytics", "automation")
    flags = ", ".join([f"{_sql_any('head', getattr(r, n))} {n}" for n in heads] + [f"{_sql_any('body', getattr(r, n))} {n}_" for n in bodies])
    contains = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    score = lambda n: _sql_score("body", getattr(r, n), r)
    return (
        VIEW
        + f""", n AS (SELECT *, {_sql_norm("title || ' ' || company")} head, {_sql_norm("coalesce(description, '')")} detail FROM v), t AS (SELECT *, trim(head || ' ' || detail) body FROM n), f AS (SELECT *, {flags} FROM t),
 g AS (SELECT *, ai_ OR data_ OR software_ OR industrial_ digital, {contains("head", r.plausible)} plausible FROM f),
 h AS (SELECT *, CASE WHEN unwanted THEN 'rol_no_tecnico_o_gestion' WHEN hr THEN 'rrhh_nominas' WHEN cad THEN 'cad_bim' WHEN graphic THEN 'diseno_grafico' WHEN mechanical AND NOT digital THEN 'mecanica_fabricacion' WHEN plc AND NOT digital THEN 'plc_scada_puro'
 WHEN ai_ THEN 'ai_ml' WHEN data_ THEN 'data' WHEN industrial_ AND (software_ OR {contains("body", r.context)}) THEN 'industrial_digital' WHEN software_ THEN 'python_api' WHEN generic_ AND length(trim(coalesce(description, ''))) > 50 THEN 'software_generico'
 WHEN generic_ AND source = 'linkedin' THEN 'linkedin_search_candidate' WHEN generic_ THEN 'software_sin_stack_objetivo' WHEN analytics_ THEN 'analytics' WHEN automation_ THEN 'automation' ELSE 'sin_evidencia_digital' END family FROM g),
 r AS (SELECT *, CASE WHEN family IN ('ai_ml', 'data', 'industrial_digital', 'python_api', 'software_generico') THEN 'accepted' WHEN family IN ('linkedin_search_candidate', 'analytics', 'automation') THEN 'warning' ELSE 'rejected' END status,
 CAST(CASE family WHEN 'plc_scada_puro' THEN 20 WHEN 'ai_ml' THEN least(100, 80 + least(18, {score("ai")})) WHEN 'data' THEN least(95, 74 + least(20, {score("data")})) WHEN 'industrial_digital' THEN least(88, 72 + {score("industrial")} + least(6, {score("software")}))
 WHEN 'python_api' THEN least(85, 70 + least(15, {score("software")})) WHEN 'software_generico' THEN 75 WHEN 'linkedin_search_candidate' THEN 65 WHEN 'software_sin_stack_objetivo' THEN 20 WHEN 'analytics' THEN least(69, 56 + {score("analytics")}) WHEN 'automation' THEN least(69, 56 + {score("automation")})
 WHEN 'sin_evidencia_digital' THEN CASE WHEN plausible THEN 35 ELSE 0 END ELSE 0 END AS INTEGER) score, family = 'linkedin_search_candidate' OR (family = 'sin_evidencia_digital' AND plausible AND detail = '') needs_description FROM h)"""
    )


_RELEVANCE = _sql_relevance()
O_RELEVANCE = _RELEVANCE + " SELECT job_id, status, score, family, needs_description FROM r"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(listings(spark, sf_dir))


def decide(rows: DataFrame) -> DataFrame:
    """New, relevant and eligible listings, and why every other one was dropped."""
    rows = rows.withColumn("aliases", F.array(F.concat(F.lit("alias-"), "job_id")))
    rows = relevance.classify_relevance(rows)
    seen = rows.where("seq % 11 = 0").select("source", "job_id")
    fresh = joins.anti_seen(rows, seen).select("source", "job_id", F.lit(False).alias("is_seen"))
    rows = rows.join(fresh, ["source", "job_id"], "left").withColumn("is_seen", F.coalesce("is_seen", F.lit(True)))
    viable = relevance.is_local(F.col("location"), F.col("title"), ["valencia", "paterna"]) | F.col("location").isin("Remoto", "Teletrabajo")
    reason = relevance.filter_reason(rows, viable, ["data", "python", "iot", "ai"], ["Company 5"])
    recent = relevance.recency_decision(F.array("url"), F.array("posted_text"), F.lit(NOW), F.col("source") == "linkedin")
    return rows.select("job_id", "source", relevance.outcome(recent["state"], F.col("is_seen"), F.col("decision"), reason, F.lit(False), F.col("seq") % 7 > 0).alias("outcome"))


O_OUTCOMES = (
    _RELEVANCE
    + r""" SELECT job_id, source, CASE WHEN source = 'linkedin' AND seq % 5 > 0 AND (seq % 90) * 60 > seq % 5 * 900 THEN 'discarded_time_window' WHEN source = 'linkedin' AND seq % 5 = 0 THEN 'unverified_time_window'
 WHEN seq % 11 = 0 THEN 'seen' WHEN status = 'rejected' THEN 'discarded_relevance:' || family WHEN location NOT IN ('Valencia', 'Paterna, Valencia', 'Remoto', 'Teletrabajo') THEN 'discarded_location'
 WHEN source <> 'linkedin' AND NOT regexp_matches(lower(concat_ws(' ', title, company, location, description)), '(^|[^\p{L}\p{M}\p{N}_])(data|python|iot|ai)([^\p{L}\p{M}\p{N}_]|$)') THEN 'discarded_include' WHEN seq % 37 = 5 THEN 'discarded_exclude' WHEN seq % 7 > 0 THEN 'sent' ELSE 'delivery_failed' END outcome FROM r"""
)


def q_outcome_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).withColumnRenamed("source", "provider")
    return aggregates.process_stats(rows, ["seen", "sent", "delivery_failed", "discarded_location", "discarded_include", "discarded_exclude", "discarded_time_window", "unverified_time_window"])


O_STATS = f"""SELECT source provider, count(*) detected, {", ".join(f"count(*) FILTER (WHERE outcome = '{n}') {n}" for n in ("seen", "sent", "delivery_failed", "discarded_location", "discarded_include", "discarded_exclude", "discarded_time_window", "unverified_time_window"))} FROM ({O_OUTCOMES}) GROUP BY 1"""


TERMINAL = ["seen", "sent", "delivery_failed", "discarded_location", "discarded_include", "discarded_exclude", "discarded_time_window", "unverified_time_window"]


def told(rows: DataFrame) -> DataFrame:
    """(source, key, outcome) of listings; some are left without an outcome."""
    return decide(rows).select("source", F.col("job_id").alias("key"), F.when(F.col("job_id").cast("long") % 13 > 0, F.col("outcome")).alias("outcome"))


def q_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.build_ledger_batches(told(listings(spark, sf_dir)), TERMINAL)
    return out.withColumn("outcomes", F.size("outcomes"))


O_LEDGER = f"""SELECT lower(source) provider, count(*) detected, count(*) FILTER (WHERE o IS NOT NULL) AS terminal, count(*) FILTER (WHERE o IS NULL) unaccounted, count(*) = count(o) AS complete, CAST(count(DISTINCT o) AS INTEGER) outcomes
 FROM (SELECT source, CASE WHEN CAST(job_id AS BIGINT) % 13 > 0 THEN outcome END o FROM ({O_OUTCOMES})) GROUP BY 1"""


def q_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), "o_totalprice")
    return tables.insert_ignore(o.where("seq % 3 = 0"), o.where("seq % 3 > 0"), ["k"], "seq")


O_INSERT = """SELECT o_custkey k, min(o_orderkey) seq, arg_min(o_totalprice, o_orderkey) o_totalprice FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1"""


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), "o_totalprice")
    return tables.upsert_latest(o.where("seq % 3 = 0"), o.where("seq % 3 = 1"), ["k"], "seq")


O_UPSERT = """SELECT o_custkey k, arg_max(o_orderkey, (o_orderkey % 3 = 1, o_orderkey)) seq, arg_max(o_totalprice, (o_orderkey % 3 = 1, o_orderkey)) o_totalprice FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1"""


def q_recent_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return tables.recent_unique(o, "1998-08-02 00:00:00", 720, 300, "id", "seq").select("id", "seq")


O_RECENT = """SELECT id, seq FROM (SELECT o_custkey id, max(o_orderkey) seq FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 720 DAY GROUP BY 1) ORDER BY seq DESC LIMIT 300"""


def q_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("search"), F.col("l_partkey").alias("key"), "l_linenumber").distinct()
    side = lambda n: li.where(f"l_linenumber % 2 = {n}").select("search", "key").distinct()
    return joins.compare_inventories(side(0), side(1).withColumn("eligible", F.col("key") % 3 == 0))


O_INVENTORIES = """WITH p AS (SELECT DISTINCT l_suppkey % 10 AS search, l_partkey AS key FROM lineitem WHERE l_linenumber % 2 = 0), r AS (SELECT DISTINCT l_suppkey % 10 AS search, l_partkey AS key FROM lineitem WHERE l_linenumber % 2 = 1)
 SELECT coalesce(p.search, r.search) AS search, count(*) FILTER (WHERE p.key IS NOT NULL AND r.key IS NOT NULL) matches, count(*) FILTER (WHERE r.key IS NULL) only_production, count(*) FILTER (WHERE p.key IS NULL) only_reference, count(*) FILTER (WHERE p.key IS NULL AND r.key % 3 = 0) eligible_absences
 FROM p FULL JOIN r ON p.search = r.search AND p.key = r.key GROUP BY 1"""


def q_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 150).cast("string"), (F.col("doc_id") % 2).cast("string")).alias("url"), F.md5("text").alias("fingerprint"))
    return joins.match_by_any_key(d.where("id % 2 = 0 OR id % 5 = 0"), d.where("id % 2 = 1"))


O_MATCH = """WITH d AS (SELECT doc_id id, 'u' || (doc_id % 150) || (doc_id % 2) url, md5(text) f FROM documents), r AS (SELECT * FROM d WHERE id % 2 = 0 OR id % 5 = 0), x AS (SELECT * FROM d WHERE id % 2 = 1)
 SELECT id, CASE WHEN url IN (SELECT url FROM x) OR f IN (SELECT f FROM x) THEN 'matched' ELSE 'missing' END status FROM r UNION ALL SELECT id, 'extra' FROM x WHERE url NOT IN (SELECT url FROM r) AND f NOT IN (SELECT f FROM r)"""


def q_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = joins.asof_close(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts"), 6 * 3600, ["user_id"])
    return out.select("event_id", F.unix_micros("closed_ts").alias("closed"), "pending")


O_ASOF = """WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
 j AS (SELECT event_id, c.ts, (SELECT min(p.ts) FROM p WHERE p.user_id = c.user_id AND p.ts >= c.ts) nxt FROM c)
 SELECT event_id, CASE WHEN floor(epoch(nxt)) - floor(epoch(ts)) <= 21600 THEN epoch_us(nxt) END closed, coalesce(floor(epoch(nxt)) - floor(epoch(ts)) > 21600, true) pending FROM j"""


def q_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), F.date_trunc("day", "ts").alias("ts")).agg(F.count("*").alias("n"))
    rows = e.select("source", "ts", (F.col("n") * 4 * (F.col("source") % 3)).alias("count"), F.when(F.day("ts") % 9 == 0, "http_403").alias("blocked"))
    return windows.volume_anomaly(rows).select("source", F.unix_timestamp("ts").alias("at"), "previous", "anomaly")


O_ANOMALIES = """WITH o AS (SELECT user_id AS source, date_trunc('day', ts) t, count(*) * 4 * (user_id % 3) c FROM events GROUP BY user_id, 2), l AS (SELECT *, lag(c) OVER (PARTITION BY source ORDER BY t) previous FROM o)
 SELECT source, CAST(epoch(t) AS BIGINT) AS at, previous, CASE WHEN day(t) % 9 = 0 THEN 'blocked_or_http_error' WHEN previous > 0 AND c = 0 THEN 'zero_after_success' WHEN previous >= 10 AND c > 0 AND 3 * c <= previous THEN 'strong_volume_drop' END anomaly FROM l"""


def q_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("provider"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_returnflag") != "R").alias("ok"))
    return windows.cap_per_group(li, 5, ["provider"], "seq", "ok").groupBy("provider").agg(F.count_if("limited").alias("limited"), F.count("*").alias("n"))


O_QUOTA = """WITH w AS (SELECT l_suppkey provider, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) used FROM lineitem)
 SELECT provider, count(*) FILTER (WHERE used >= 5) limited, count(*) n FROM w GROUP BY 1"""


def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = listings(spark, sf_dir).withColumn("key", F.col("seq") % 200).withColumn("is_fresh", F.col("seq") % 50 == 0).withColumn("aliases", F.array("job_id", (F.col("seq") % 7).cast("string")))
    out = aggregates.merge_duplicates(v, "key", "seq", ["España"])
    return out.select("key", "title", "company", "location", F.md5("description").alias("description"), "is_fresh", F.array_join("aliases", ",").alias("aliases"))


O_MERGE = (
    VIEW
    + """, a AS (SELECT seq % 200 AS key, seq, unnest([job_id, CAST(seq % 7 AS VARCHAR)]) al, unnest([0, 1]) pos FROM v), f AS (SELECT key, al, min(seq * 2 + pos) p FROM a GROUP BY 1, 2)
 SELECT v.seq % 200 AS key, arg_max(title, seq) title, arg_max(company, seq) company, coalesce(arg_max(location, seq) FILTER (WHERE location NOT IN ('', 'España')), arg_min(location, seq)) AS location,
 md5(arg_max(description, (length(description), -seq))) description, bool_or(seq % 50 = 0) is_fresh, any_value(al.aliases) aliases FROM v JOIN (SELECT key, string_agg(al, ',' ORDER BY p) aliases FROM f GROUP BY 1) al ON al.key = v.seq % 200 GROUP BY 1"""
)


def q_cycle_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("cycle"), F.col("event_type").alias("provider"), F.lit(1).alias("detected"))
    return aggregates.cycle_totals(e, ["detected"])


O_CYCLES = "SELECT strftime(ts, '%Y-%m-%d') AS cycle, event_type provider, CAST(count(*) AS BIGINT) detected FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'), event_type)"


def q_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = listings(spark, sf_dir)
    stack = text.match_terms(text.norm_text(F.col("title")), ["python", "sql", "django", "iot", "data", "ai"])
    return aggregates.market_report(v.select("company", "source", stack.alias("stack"), F.when(F.col("seq") % 4 == 0, "consultancy").otherwise("product").alias("company_type"), F.col("location").contains("Valencia").alias("is_local"), F.when(F.col("title").contains("Senior"), "Senior").otherwise("Junior").alias("level")))


O_MARKET = (
    VIEW
    + """, p AS (SELECT 'total' section, 'all' AS key FROM v UNION ALL SELECT 'type', CASE WHEN seq % 4 = 0 THEN 'consultancy' ELSE 'product' END FROM v UNION ALL SELECT 'area', CASE WHEN contains(location, 'Valencia') THEN 'local' ELSE 'elsewhere' END FROM v
 UNION ALL SELECT 'company', company FROM v UNION ALL SELECT 'level', CASE WHEN contains(title, 'Senior') THEN 'Senior' ELSE 'Junior' END FROM v UNION ALL SELECT 'source', upper(source) FROM v
 UNION ALL SELECT 'technology', t FROM v, (SELECT unnest(['python', 'sql', 'django', 'iot', 'data', 'ai']) t) WHERE regexp_matches(lower(title), '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')),
 c AS (SELECT section, key, count(*) n FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, key) k FROM c)
 SELECT section, key, n, round(100 * n / (SELECT count(*) FROM v), 1) percent FROM r WHERE (section = 'company' AND k <= 5) OR (section = 'technology' AND k <= 6) OR section NOT IN ('company', 'technology')"""
)


def q_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("title"))
    return aggregates.group_topk_examples(o, "company", "title", 25).withColumn("samples", F.array_join("samples", ","))


O_EXAMPLES = "SELECT l_suppkey company, CAST(count(*) AS BIGINT) postings, count(DISTINCT l_returnflag || l_linenumber) distinct_items, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linenumber))[1:3], ',') samples FROM lineitem GROUP BY 1 ORDER BY postings DESC, company LIMIT 25"


def q_sym_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id")).distinct(), o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("id")).distinct()
    return joins.symmetric_diff(a, b)


O_SYM = """WITH a AS (SELECT DISTINCT o_custkey id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey id FROM orders WHERE o_orderkey % 2 = 1)
 SELECT id, 'only_a' side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'only_b' FROM b WHERE id NOT IN (SELECT id FROM a)"""

QUERIES = {
    "keys_and_urls": (q_keys, O_KEYS), "term_matches": (q_terms, O_TERMS), "times_and_ages": (q_times, O_TIMES), "relevance": (q_relevance, O_RELEVANCE), "listing_outcomes": (_outcomes, O_OUTCOMES), "outcome_stats": (q_outcome_stats, O_STATS), "ledger_batches": (q_ledger, O_LEDGER),
    "insert_ignore": (q_insert_ignore, O_INSERT), "upsert_latest": (q_upsert, O_UPSERT), "recent_unique": (q_recent_unique, O_RECENT), "compare_inventories": (q_inventories, O_INVENTORIES), "match_by_any_key": (q_match_any, O_MATCH), "asof_close": (q_asof, O_ASOF), "volume_anomaly": (q_anomalies, O_ANOMALIES),
    "quota": (q_quota, O_QUOTA), "merge_duplicates": (q_merge, O_MERGE), "cycle_totals": (q_cycle_totals, O_CYCLES), "market_report": (q_market, O_MARKET), "group_examples": (q_examples, O_EXAMPLES), "symmetric_diff": (q_sym_diff, O_SYM),
}
