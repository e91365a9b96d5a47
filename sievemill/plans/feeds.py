"""Registered queries of feeds, pages, text facts, coverage and streams, each with DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.functions import features
from sievemill.operators import coverage
from sievemill.plans.queries import LOCATIONS, O_LEDGER, listings_view, table, told
from sievemill.plans.queries import TERMINAL as TERMINALS
from sievemill.sources import feeds
from sievemill.streaming import streams

PHRASES = ["No remoto, trabajo en oficina", "Modalidad híbrida", "100% remoto desde casa", "Presencial en planta", "Trabajo remoto posible", "", "2 días de teletrabajo a la semana", "25 días de vacaciones"]
NOW = "2024-01-31 00:00:00"
COUNTS = ["detected", "sent", "http_429", "delivery_failed"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def q_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    years = F.when(d % 3 == 0, F.concat((d % 9).cast("string"), F.lit("-"), (d % 9 + 2).cast("string"), F.lit(" años de Python"))).when(d % 3 == 1, F.concat(F.lit("Al menos "), (d % 9).cast("string"), F.lit("+ years"))).otherwise("Empresa con 20 años")
    pay = F.when(d % 2 == 0, F.concat(F.lit("Salario "), (d % 30 + 20).cast("string"), F.lit(".000 € - "), (d % 30 + 30).cast("string"), F.lit(".000 €"))).when(d % 5 == 0, F.concat((d % 900 + 1000).cast("string"), F.lit(" € al mes"))).otherwise("según valía")
    rows = table(spark, sf_dir, "documents").select("doc_id", pick(PHRASES, d % 8).alias("mode"), pick(LOCATIONS, F.floor(d / 8) % 8).alias("location"), years.alias("years"), pay.alias("pay"))
    exp, pay = features.experience(F.col("years")), features.salary_range(F.col("pay"))
    return rows.select(
        "doc_id", features.modality(F.col("mode"), F.col("location"), ["Valencia", "Madrid", "Barcelona"]).alias("modality"), exp["min"].alias("low"), exp["max"].alias("high"), exp["level"].alias("level"),
        pay["min"].alias("pay_low"), pay["max"].alias("pay_high"), features.freshness(d % 4 == 0, F.col("mode")).alias("freshness"), features.score_band(d % 100).alias("band"), features.company_type(F.col("location"), F.col("mode"), ["madrid"], ["en planta"]).alias("kind"),
    )


O_FACTS = f"""WITH d AS (SELECT doc_id, doc_id % 8 m, {_list(LOCATIONS)}[doc_id // 8 % 8 + 1] loc, doc_id % 9 y FROM documents),
 e AS (SELECT *, loc IN ('Valencia', 'Madrid', 'Barcelona') city, loc IN ('Remoto', 'Teletrabajo') away, CASE doc_id % 3 WHEN 2 THEN NULL ELSE CAST(y AS INTEGER) END low, CASE doc_id % 3 WHEN 0 THEN CAST(y + 2 AS INTEGER) END high FROM d)
 SELECT doc_id, CASE WHEN m IN (0, 3) THEN 'on-site' WHEN m IN (1, 6) THEN 'hybrid' WHEN m = 2 THEN 'remote' WHEN m = 4 THEN CASE WHEN city THEN 'hybrid' ELSE 'remote' END WHEN away THEN 'remote' WHEN city THEN 'on-site' ELSE 'unspecified' END modality,
 low, high, CASE WHEN low IS NULL THEN 'unspecified' WHEN coalesce(high, low) <= 2 THEN 'Junior' WHEN coalesce(high, low) <= 4 THEN 'Mid' WHEN coalesce(high, low) <= 7 THEN 'Senior' ELSE 'Lead / Principal' END AS level,
 CAST(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 30 + 20) * 1000 WHEN doc_id % 5 = 0 THEN (doc_id % 900 + 1000) * 12 END AS INTEGER) pay_low, CAST(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 30 + 30) * 1000 WHEN doc_id % 5 = 0 THEN (doc_id % 900 + 1000) * 12 END AS INTEGER) pay_high,
 CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'recent' END freshness, CASE WHEN doc_id % 100 >= 90 THEN 'top' WHEN doc_id % 100 >= 80 THEN 'high' ELSE 'normal' END band, CASE WHEN loc = 'Madrid' OR m = 3 THEN 'consultancy' ELSE 'product' END kind FROM e"""


def q_json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 7 > 0, F.struct(F.col("p_brand").alias("name"))).alias("company"), "p_size")
    part = table(spark, sf_dir, "part")
    raw = part.groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("jobs"))).alias("body")).select(F.lit("feed").alias("source"), "body")
    i = F.col("item")
    return feeds.parse_json_feed(raw.union(raw), "jobs array<struct<id long, title string, company struct<name string>, p_size long>>", "jobs", {"id": i["id"], "title": i["title"], "company": F.coalesce(i["company"]["name"], F.lit("-")), "size": i["p_size"]})


O_JSON_FEED = "SELECT 'feed_' || p_partkey id, p_name title, 'feed' AS source, CASE WHEN p_partkey % 7 > 0 THEN p_brand ELSE '-' END company, CAST(p_size AS BIGINT) size FROM part WHERE trim(p_name) <> ''"


def q_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    item = F.concat(F.lit("<item><title><![CDATA["), "p_brand", F.lit(": "), "p_name", F.lit("]]></title><link>https://x.example/"), k.cast("string"), F.lit("</link><pubDate>Mon, 0"), (k % 9 + 1).cast("string"), F.lit(" Jan 2024 08:00:00 +0000</pubDate></item>"))
    raw = table(spark, sf_dir, "part").groupBy(F.floor(k / 100).alias("page")).agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), "\n"), F.lit("</rss>")).alias("body"))
    return feeds.parse_rss_feed(raw.select(F.lit("rss").alias("source"), "body")).withColumn("published", F.unix_timestamp("published"))


O_RSS = "SELECT substr(md5('https://x.example/' || p_partkey), 1, 12) id, 'rss' AS source, p_brand company, p_name title, 'https://x.example/' || p_partkey url, CAST(epoch(CAST('2024-01-0' || (p_partkey % 9 + 1) || ' 08:00:00' AS TIMESTAMP)) AS BIGINT) published FROM part"


def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.extract_links(table(spark, sf_dir, "pages"), "^/[A-Za-z]")


O_LINKS = r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) head, unnest(l) a, unnest(range(len(l))) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>') l FROM pages)),
 h AS (SELECT *, regexp_replace(regexp_extract(a, 'href="([^"]*)"', 1), '#.*$', '') href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) title FROM a),
 u AS (SELECT *, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//') THEN head || href ELSE href END url FROM h)
 SELECT page_id, url, arg_min(title, pos) title FROM u WHERE head <> '' AND starts_with(url, head) AND regexp_matches(substr(url, length(head) + 1), '^/[A-Za-z]') AND length(title) BETWEEN 1 AND 300 GROUP BY 1, 2"""


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as cycles and pairs of event type and user group as providers."""
    e = table(spark, sf_dir, "events")
    n, group = F.count("*"), F.col("user_id") % 6
    rows = e.groupBy(F.date_trunc("day", "ts").alias("cycle"), F.concat_ws("-", "event_type", group.cast("string")).alias("provider"), group.alias("g")).agg(F.max("ts").alias("ts"), n.alias("detected"), F.count_if(F.col("value") > 100).alias("sent"), F.count_if(F.col("value") > 250).alias("http_429"))
    rows = rows.where("g <> 1 OR day(cycle) % 3 = 0").where("g <> 2 OR day(cycle) % 4 > 0")
    return rows.withColumns({"delivery_failed": F.when(F.col("g") == 3, F.col("sent") - 5).otherwise(0), "blocked_reason": F.when((F.col("g") == 4) & (F.day("cycle") % 5 == 0), F.concat(F.lit("http_"), (F.col("detected") % 2 + 403).cast("string"))), "validation_anomaly": F.when((F.col("g") == 5) & (F.day("cycle") == 7), "skipped_not_validated:x")}).drop("g")


_CYCLES = """WITH e AS (SELECT date_trunc('day', ts) AS cycle, event_type || '-' || user_id % 6 provider, user_id % 6 g, max(ts) ts, count(*) detected, count(*) FILTER (WHERE value > 100) sent, count(*) FILTER (WHERE value > 250) http_429 FROM events GROUP BY 1, 2, 3),
 c AS (SELECT *, CASE WHEN g = 3 THEN sent - 5 ELSE 0 END delivery_failed, CASE WHEN g = 4 AND day(cycle) % 5 = 0 THEN 'http_' || detected % 2 + 403 END blocked, g = 5 AND day(cycle) = 7 skip FROM e WHERE (g <> 1 OR day(cycle) % 3 = 0) AND (g <> 2 OR day(cycle) % 4 > 0))"""
STALE = 2880


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = _cycles(spark, sf_dir)
    expected = cycles.select("provider").union(table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("absent")))
    return coverage.provider_summary(cycles, COUNTS, NOW, STALE, providers=expected)


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ",")).withColumn("blocked_reason", F.coalesce(F.array_join(F.transform(F.map_entries("blocked_reason"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","), F.lit(""))).drop("validation_status")


O_SUMMARY = f"""{_CYCLES}, p AS (SELECT DISTINCT provider FROM c UNION SELECT 'absent'), w AS (SELECT count(DISTINCT cycle) n FROM c),
 h AS (SELECT provider, string_agg(blocked || ':' || k, ',' ORDER BY blocked) b FROM (SELECT provider, blocked, count(*) k FROM c WHERE blocked IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT p.provider, count(DISTINCT cycle) cycles, CAST(coalesce(sum(detected), 0) AS BIGINT) detected, CAST(coalesce(sum(sent), 0) AS BIGINT) sent, CAST(coalesce(sum(http_429), 0) AS BIGINT) http_429, CAST(coalesce(sum(greatest(delivery_failed, 0)), 0) AS BIGINT) delivery_failed,
 CAST(greatest(0, round((epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts)))) / 60)) AS BIGINT) age_minutes, coalesce(bool_or(skip), false) skipped, count(DISTINCT cycle) / (SELECT n FROM w) sh, count(cycle) = 0 gone FROM p LEFT JOIN c ON c.provider = p.provider GROUP BY 1),
 r AS (SELECT s.*, coalesce(h.b, '') b, CASE WHEN skipped THEN 'disabled_pending_human_validation' WHEN gone THEN 'provider_missing_from_all_recorded_cycles' END early,
 concat_ws(',', CASE WHEN age_minutes > {STALE} THEN 'provider_evidence_stale' WHEN sh < 0.5 THEN 'provider_present_in_less_than_half_of_cycles' WHEN sh < 0.8 THEN 'provider_missing_from_some_cycles' END,
 CASE WHEN http_429 > 0 THEN 'http_429_observed' END, CASE WHEN h.b IS NOT NULL THEN 'provider_block_or_parse_issue_observed' END, CASE WHEN delivery_failed > 0 THEN 'delivery_failure_observed' END) said FROM s LEFT JOIN h ON h.provider = s.provider)
 SELECT provider, cycles, detected, sent, http_429, delivery_failed, round(sh, 3) ratio, CASE WHEN NOT gone THEN age_minutes END age_minutes, CASE WHEN skipped THEN 'not_monitored' WHEN gone OR age_minutes > {STALE} OR sh < 0.5 THEN 'critical' WHEN said <> '' THEN 'warning' ELSE 'ok' END status,
 coalesce(early, said) reasons, b blocked_reason FROM r"""


def q_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.overall_rollup(_summaries(spark, sf_dir).where("provider NOT LIKE '%-1' AND provider <> 'absent'"), 0.7)


O_ROLLUP = f"""WITH s AS (SELECT status FROM ({O_SUMMARY}) WHERE provider NOT LIKE '%-1' AND provider <> 'absent'), n AS (SELECT count(*) FILTER (WHERE status = 'ok') ok, count(*) FILTER (WHERE status = 'warning') warning, count(*) FILTER (WHERE status = 'insufficient_data') insufficient_data, count(*) FILTER (WHERE status = 'critical') critical, count(*) FILTER (WHERE status = 'not_monitored') not_monitored FROM s)
 SELECT CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' WHEN insufficient_data > 0 THEN 'insufficient_data' ELSE 'ok' END status, CAST(round_even(least(70, (100 * ok + 55 * warning + 25 * insufficient_data) / (ok + warning + insufficient_data + critical)), 0) AS BIGINT) score, * FROM n"""

TERMINAL = ["seen", "sent", "delivery_failed"]


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger batches half an hour before the cycles they belong to; the last day's are open."""
    d, g = F.col("detected"), F.col("provider").substr(-1, 1)
    jobs = F.transform(F.sequence(F.lit(1).cast("long"), d), lambda i: F.struct(i.cast("string").alias("key"), F.when((g == "3") & (i == 1), "odd").otherwise("seen").alias("outcome")))
    outcomes = F.when(g == "4", F.lit(None)).otherwise(F.create_map(F.lit("sent"), F.col("sent"), F.lit("seen"), d - F.col("sent")))
    return _cycles(spark, sf_dir).where("provider NOT LIKE 'error-%'").select(
        "provider", (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30))).alias("ts"), (F.day("cycle") == 30).alias("pending"), "detected", F.when(g == "0", F.col("sent")).otherwise(d).alias("terminal"), F.lit(0).alias("unaccounted"), (g != "2").alias("complete"), F.when(g != "3", outcomes).alias("outcomes"), F.when(g == "3", jobs).alias("jobs"),
    )


def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = _cycles(spark, sf_dir)
    expected = coverage.detected_in(cycles.where("day(cycle) < 30")).select("provider", (F.col("expected") + F.when(F.col("provider") == "click-1", 1).otherwise(0)).alias("expected"), (F.col("provider") != "view-1").alias("monitored"))
    return coverage.reconcile(_batches(spark, sf_dir), expected, TERMINAL).withColumn("reasons", F.array_join("reasons", ","))


O_RECONCILE = f"""{_CYCLES}, b AS (SELECT provider, g, day(cycle) = 30 pending, detected d, CASE WHEN g = 0 THEN sent ELSE detected END t, CASE WHEN g = 4 THEN 0 ELSE detected END items, CASE WHEN g = 3 THEN 1 WHEN g = 4 THEN detected WHEN g = 0 THEN detected - sent ELSE 0 END bad FROM c WHERE provider NOT LIKE 'error-%'),
 s AS (SELECT provider, count(*) FILTER (WHERE NOT pending) batches, CAST(coalesce(sum(d) FILTER (WHERE NOT pending), 0) AS BIGINT) detected, CAST(coalesce(sum(t) FILTER (WHERE NOT pending), 0) AS BIGINT) "terminal", CAST(coalesce(sum(items) FILTER (WHERE NOT pending), 0) AS BIGINT) item_rows, CAST(coalesce(sum(bad) FILTER (WHERE NOT pending), 0) AS BIGINT) invalid_items,
 count(*) FILTER (WHERE NOT pending AND g = 2) incomplete_batches, count(*) FILTER (WHERE pending) pending_batches, CAST(coalesce(sum(d) FILTER (WHERE pending), 0) AS BIGINT) pending_detected FROM b GROUP BY 1),
 x AS (SELECT provider, CAST(sum(detected) + CASE WHEN provider = 'click-1' THEN 1 ELSE 0 END AS BIGINT) expected FROM c WHERE day(cycle) < 30 GROUP BY 1),
 j AS (SELECT x.provider, expected, coalesce(batches, 0) batches, coalesce(detected, 0) detected, coalesce("terminal", 0) "terminal", 0 unaccounted, coalesce(item_rows, 0) item_rows, coalesce(invalid_items, 0) invalid_items, coalesce(incomplete_batches, 0) incomplete_batches, coalesce(pending_batches, 0) pending_batches, coalesce(pending_detected, 0) pending_detected FROM x LEFT JOIN s ON s.provider = x.provider),
 r AS (SELECT *, CASE WHEN provider = 'view-1' THEN 'provider_not_monitored' WHEN batches = 0 AND pending_batches > 0 THEN 'cycle_in_progress_not_yet_persisted' WHEN batches = 0 THEN 'missing_per_job_ledger' END early,
 concat_ws(',', CASE WHEN detected <> expected THEN 'detected_count_mismatch' END, CASE WHEN item_rows <> detected THEN 'job_rows_count_mismatch' END, CASE WHEN "terminal" <> detected OR invalid_items > 0 OR incomplete_batches > 0 THEN 'unaccounted_or_nonterminal_job' END) said FROM j)
 SELECT * EXCLUDE (early, said), coalesce(early, said) reasons, CASE WHEN provider = 'view-1' THEN 'not_applicable' WHEN batches = 0 AND pending_batches > 0 THEN 'in_progress' WHEN batches = 0 THEN 'insufficient_data' WHEN said <> '' THEN 'critical' ELSE 'ok' END state FROM r"""


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = _cycles(spark, sf_dir)
    out = coverage.coverage_report(cycles, _batches(spark, sf_dir).drop("pending"), cycles.select("provider").distinct(), COUNTS, TERMINAL, NOW, 24 * 40, 86_400, STALE, delay_seconds=3600)
    return out.withColumn("reasons", F.array_join("reasons", ","))


#: Folders made by ``_scratch`` in this session, for ``sweep``.
_FOLDERS: list[str] = []


def _scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; a temporary one serves in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _FOLDERS.append(f"{found or tempfile.mkdtemp(prefix='spark-sievemill-')}/stream-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def sweep(spark: SparkSession) -> None:
    """Delete what queries wrote below ``_scratch`` folders in this session, once their results are written."""
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    streams.windows_kept(streams.table_stream(spark, sf_dir, "events"), "ts", "event_type", "15 minutes", "1 day", f"{path}/out", f"{path}/state")
    return streams.latest_windows(spark, f"{path}/out", "event_type").withColumn("start", F.unix_timestamp("start"))


O_WINDOWS = "SELECT CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS start, event_type, count(*) n FROM events GROUP BY 1, 2"


def q_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    streams.listing_cycles(listings_view(streams.table_stream(spark, sf_dir, "documents")), told, TERMINALS, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").drop("batch").withColumn("outcomes", F.size("outcomes"))


def q_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    runs = streams.table_stream(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "ts", (F.col("event_type") == "purchase").alias("complete"))
    streams.missing_heartbeats(runs, "source", 43_200).writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("source long, ts timestamp").parquet(f"{path}/out")


def q_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    first = streams.seen_with_ttl(streams.table_stream(spark, sf_dir, "events").select("user_id", "ts"), "ts", ["user_id"], "60 days")
    first.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, ts timestamp").parquet(f"{path}/out").groupBy("user_id").agg(F.count("*").alias("n"))


O_FIRST_SEEN = "SELECT user_id, 1 n FROM events GROUP BY 1"


def q_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = table(spark, sf_dir, "conversations").withColumn("place", place)
    cards = F.array(F.struct(F.col("place").cast("string").alias("id"), F.col("text").alias("title"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("url")))
    search = F.struct("place", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("searchUrl"), F.when(F.col("turn") % 2 == 0, "complete").otherwise("odd").alias("state"), F.when(F.col("role") == "user", cards).alias("jobs"), F.when(F.col("role") != "user", cards).alias("reference_jobs"))
    runs = c.groupBy("conv_id").agg(F.to_json(F.struct(F.concat(F.lit("run-"), F.first("conv_id").cast("string")).alias("runId"), F.array_sort(F.collect_list(search)).alias("searches"))).alias("body"))
    return feeds.flatten_run_payload(runs).select("run_id", "search_url", "state", "role", "id", F.md5("title").alias("title"), "url")


O_PAYLOAD = r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) place FROM conversations)
 SELECT 'run-' || conv_id run_id, 's' || turn search_url, CASE WHEN turn % 2 = 0 THEN 'complete' ELSE 'partial' END state, CASE WHEN role = 'user' THEN 'production' ELSE 'reference' END AS role, CAST(place AS VARCHAR) id, md5(text) title, 'u' || turn url
 FROM c WHERE role IS NOT NULL AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''"""


def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = F.col("n"), F.col("event_type")
    state = lambda c: F.element_at(F.array(*[F.lit(s) for s in ("ok", " Blocked", "rate_limited", "complete", "HTTP 429")]), (c % 5 + 1).cast("int"))
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.max("ts").alias("ts"), F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("m"))
    urls = F.when(e != "view", F.array(F.struct(state(n).alias("extension"), state(F.col("m")).alias("api")), F.struct(state(n + 1).alias("extension"), F.lit(None).cast("string").alias("api"))))
    runs = days.select(
        "event_type", "ts", ((e != "click") & (n % 2 == 0)).alias("complete"), F.when(n % 3 == 0, True).alias("partial"), (e != "error").alias("valid"), (e == "signup").alias("correct"),
        F.when(e == "purchase", F.lit(1)).otherwise(-1).alias("absences"), n.alias("unique_jobs"), F.col("m").alias("duplicates"), urls.alias("urls"),
    )
    return coverage.run_summary(runs, ["event_type"], 35, NOW, 2000).withColumn("reasons", F.array_join("reasons", ","))


_STATE = "['ok', 'blocked', 'rate_limited', 'complete', 'http 429']"
O_RUNS = f"""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, max(ts) ts, count(*) n, count(*) FILTER (WHERE value > 100) m FROM events GROUP BY 1, 2),
 x AS (SELECT *, CASE WHEN event_type = 'view' THEN [] ELSE [{_STATE}[n % 5 + 1], {_STATE}[m % 5 + 1], {_STATE}[(n + 1) % 5 + 1]] END st FROM d),
 s AS (SELECT event_type, count(*) runs, CAST(greatest(0, round((epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts)))) / 60)) AS BIGINT) age_minutes, count(*) FILTER (WHERE event_type <> 'click' AND n % 2 = 0) complete, count(*) FILTER (WHERE n % 3 = 0) partial,
 count(*) FILTER (WHERE event_type <> 'error') AS valid, count(*) FILTER (WHERE event_type = 'signup') correct, count(*) FILTER (WHERE event_type = 'purchase') absences, CAST(sum(n) AS BIGINT) unique_jobs, CAST(sum(m) AS BIGINT) duplicates, count(*) FILTER (WHERE event_type <> 'view') * 2 urls,
 CAST(sum(len(list_filter(st, lambda v: v IN ('rate_limited', 'http 429')))) AS BIGINT) rate_limited, CAST(sum(len(list_filter(st, lambda v: v = 'blocked'))) AS BIGINT) blocked FROM x GROUP BY 1),
 f AS (SELECT *, CASE WHEN age_minutes > 2000 THEN 'evidence_stale' WHEN complete = 0 THEN 'no_complete_batch' WHEN runs / 35 < 0.5 THEN 'too_few_runs' END fatal,
 concat_ws(',', CASE WHEN runs / 35 < 0.8 THEN 'below_expected_ratio' END, CASE WHEN partial > 0 THEN 'partial_batches' END, CASE WHEN absences > 0 THEN 'eligible_absence' END, CASE WHEN valid = 0 THEN 'no_valid_audit' WHEN correct = 0 THEN 'audit_not_correct' END,
 CASE WHEN rate_limited > 0 THEN 'rate_limited' END, CASE WHEN blocked > 0 THEN 'blocked' END) listed FROM s)
 SELECT event_type, runs, round(runs / 35, 3) ratio, age_minutes, complete, partial, valid, correct, absences, unique_jobs, duplicates, urls, rate_limited, blocked, coalesce(fatal, listed) reasons,
 CASE WHEN fatal IS NOT NULL OR absences > 0 THEN 'critical' WHEN listed <> '' THEN 'warning' ELSE 'ok' END status FROM f"""


QUERIES = {
    "run_summary": (q_runs, O_RUNS),
    "run_payload": (q_payload, O_PAYLOAD),
    "text_facts": (q_facts, O_FACTS), "json_feed": (q_json_feed, O_JSON_FEED), "rss_feed": (q_rss, O_RSS), "page_links": (q_links, O_LINKS), "provider_summary": (q_summary, O_SUMMARY), "coverage_rollup": (q_rollup, O_ROLLUP), "reconcile": (q_reconcile, O_RECONCILE), "coverage_report": (q_report, None),
    "stream_ledger": (q_stream_ledger, O_LEDGER), "stream_heartbeats": (q_heartbeats, None), "stream_first_seen": (q_first_seen, O_FIRST_SEEN), "stream_windows": (q_windows, O_WINDOWS),
}
