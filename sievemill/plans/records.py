"""Registered queries of listings as a whole: work modes, drops, matches, and names of a large catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import modality as m
from sievemill.operators import cycles, inventory, names, records, relevance
from sievemill.plans.feeds import _scratch
from sievemill.plans.queries import _RELEVANCE, NOW, VIEW, listings, table
from sievemill.sources import scans

PLACES = m.Places(("valencia", "paterna"), ("madrid", "barcelona"))
#: Sentences put behind the texts, so that every rung of the ladder is told somewhere.
SAID = ["", "No se admite teletrabajo.", "Tres o 2 días en oficina y 3 días remoto", "hasta 2 días de teletrabajo", "2 días de casa y 23 días de vacaciones", "modelo 3/2", "teletrabajo al 40% ", "Full remote", "Trabajo presencial", "Remoto posible", "nada", "not remote"]


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("seq")
    said = F.element_at(F.array(*[F.lit(s) for s in SAID]), (F.floor(n / 8) % len(SAID) + 1).cast("int"))
    urls = F.when(n % 3 > 0, F.array(F.concat(F.lit("https://www.linkedin.com/jobs/search?f_WT="), F.when(n % 4 < 3, "2").otherwise("1"))))
    return listings(spark, sf_dir).withColumn("description", F.concat_ws(" ", "description", said)).withColumn("source", F.when(n % 2 == 0, "linkedin").otherwise("board")).withColumn("urls", urls)


def q_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.drop_reason(_said(spark, sf_dir), PLACES, ["data", "python", "iot", "ai"], ["Company 5"], urls="urls")
    return rows.select("job_id", "mode", "viable", "reason")


def _sql_any(c: str, patterns) -> str:
    return f"regexp_matches({c}, '(?i){'|'.join(f'(?:{p})' for p in patterns)}')"


def _sql_words(c: str, words) -> str:
    return _sql_any(c, [rf"\b{w}\b" for w in words])


_SAID = "[" + ", ".join("'" + s + "'" for s in SAID) + "]"
_HOLDS = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_AROUND = f"regexp_extract(f, '(?is)^.*?(?:{m.DAYS}).{{0,25}}', 0)"
O_MODES = VIEW + rf""", s AS (SELECT * EXCLUDE (source, description), concat_ws(' ', description, {_SAID}[CAST(floor(seq / 8) AS INTEGER) % {len(SAID)} + 1]) description, CASE WHEN seq % 2 = 0 THEN 'linkedin' ELSE 'board' END AS source, seq % 3 > 0 AND seq % 4 < 3 AS asked FROM v),
 t AS (SELECT *, lower(location) w, lower(array_to_string(list_filter([title, description, location], lambda x: x <> ''), ' ') || ' ' || location) f FROM s),
 d AS (SELECT *, {_AROUND} around, regexp_extract(f, '(?is)^.*?({m.DAYS})(.{{0,25}})', ['hit', 'behind']) g FROM t),
 k AS (SELECT *, {_sql_any("f", [m.DAYS])} AND NOT {_sql_any("substr(around, greatest(length(around) - length(g.hit) - length(g.behind) - 9, 1))", [m.HOLIDAYS])} AS worked FROM d),
 o AS (SELECT *, CASE WHEN {_sql_any("f", m.NO_REMOTE)} THEN '{m.ON_SITE}' WHEN {_sql_any("f", [m.SPLIT])} OR worked OR {_sql_any("f", [*m.SHARES, *m.HYBRIDS])} THEN '{m.HYBRID}' WHEN {_sql_any("f", m.REMOTES)} THEN '{m.REMOTE}' WHEN {_sql_words("f", m.ON_SITES)} THEN '{m.ON_SITE}'
  WHEN {_sql_words("f", m.REMOTE_WORDS)} THEN CASE WHEN {_HOLDS("w", (*PLACES.home, *PLACES.others))} AND NOT {_HOLDS("w", ("remoto", "remote", "teletrabajo"))} THEN '{m.HYBRID}' ELSE '{m.REMOTE}' END WHEN {_HOLDS("w", (*PLACES.home, *PLACES.others))} THEN '{m.BY_PLACE}' ELSE '{m.UNSAID}' END AS mode FROM k),
 c AS (SELECT *, {_sql_words("lower(location || ' ' || title)", PLACES.home)} OR mode = '{m.REMOTE}' OR (source = 'linkedin' AND asked AND NOT {_HOLDS("w", PLACES.others)} AND NOT {_sql_words("lower(description)", PLACES.others)} AND NOT contains(mode, 'Presencial') AND NOT contains(mode, 'Híbrido') AND (w IN ({", ".join(f"'{x}'" for x in m.COUNTRIES)}) OR contains(mode, 'Remoto'))) AS viable FROM o)
 SELECT job_id, mode, viable, CASE WHEN regexp_matches(title, '(?i)\b(?:senior|sr\.?|lead)\b') THEN 'exclude' WHEN NOT viable THEN 'location' WHEN source <> 'linkedin' AND NOT regexp_matches(lower(concat_ws(' ', title, company, location, description)), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(data|python|iot|ai)([^\p{{L}}\p{{M}}\p{{N}}_]|$)') THEN 'include' WHEN seq % 37 = 5 THEN 'exclude' END reason FROM c"""


def q_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.match_record(listings(spark, sf_dir).withColumn("is_fresh", F.col("seq") % 4 == 0), PLACES, ["company 3"])
    return rows.select("job_id", "match.score", F.array_join("match.tags", ",").alias("tags"), "match.kind", "match.mode", F.col("match.pay.min").alias("low"), F.col("match.pay.max").alias("high"), F.col("match.pay.told").alias("told"), "match.experience", "match.freshness", F.array_join("match.stack", ",").alias("stack"))


def q_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark passages as a catalog."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("alias")).distinct()
    aliases = words.select(F.pmod(F.xxhash64("alias"), F.lit(1 << 30)).cast("int").alias("place"), F.col("alias").alias("name"), "alias", F.lit(None).cast("string").alias("pattern"))
    told = names.names_told(table(spark, sf_dir, "documents"), aliases)
    return told.select("doc_id", F.size("names").alias("n"), F.array_join(F.array_sort("names"), ",").alias("names"))


O_NAMES = r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) alias FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) alias FROM documents),
 h AS (SELECT doc_id, count(*) n, string_agg(alias, ',' ORDER BY alias) AS names FROM w SEMI JOIN a USING (alias) GROUP BY 1)
 SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) n, coalesce(names, '') AS names FROM documents LEFT JOIN h USING (doc_id)"""


def q_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in cycles of 50, with every switch set in some cycle."""
    n = F.col("seq")
    rows = relevance.classify_relevance(listings(spark, sf_dir)).withColumn("cycle", F.floor(n / 50))
    viable = relevance.is_local(F.col("location"), F.col("title"), ["valencia", "paterna"]) | F.col("location").isin("Remoto", "Teletrabajo")
    rows = rows.withColumn("reason", relevance.filter_reason(rows, viable, ["data", "python", "iot", "ai"], ["Company 5"]))
    recent = relevance.recency_decision(F.array("url"), F.array("posted_text"), F.lit(NOW), F.col("source") == "linkedin")
    rows = rows.withColumn("recency", recent["state"]).withColumn("is_seen", n % 11 == 0).withColumn("is_fresh", n % 2 == 0).withColumn("delivered", n % 7 > 0).withColumn("undescribed", F.length(F.coalesce("description", F.lit(""))) < 600).withColumn("duplicates", n % 3)
    c = F.col("cycle") % 4
    return cycles.cycle_stats(cycles.cycle_outcomes(rows, "cycle", "seq", c != 1, c == 2, c == 1, 3), ["cycle"])


O_CYCLES = (
    _RELEVANCE
    + r""", based AS (SELECT seq, seq // 50 AS cycle, status, description, CASE WHEN source = 'linkedin' AND seq % 5 > 0 AND (seq % 90) * 60 > seq % 5 * 900 THEN 'discarded_time_window' WHEN source = 'linkedin' AND seq % 5 = 0 THEN 'unverified_time_window' WHEN seq % 11 = 0 THEN 'seen' END early,
 CASE WHEN status = 'rejected' THEN 'discarded_relevance' WHEN location NOT IN ('Valencia', 'Paterna, Valencia', 'Remoto', 'Teletrabajo') THEN CASE WHEN regexp_matches(title, '(?i)\b(?:senior|sr\.?|lead)\b') THEN 'discarded_exclude' ELSE 'discarded_location' END WHEN regexp_matches(title, '(?i)\b(?:senior|sr\.?|lead)\b') THEN 'discarded_exclude'
 WHEN source <> 'linkedin' AND NOT regexp_matches(lower(concat_ws(' ', title, company, location, description)), '(^|[^\p{L}\p{M}\p{N}_])(data|python|iot|ai)([^\p{L}\p{M}\p{N}_]|$)') THEN 'discarded_include' WHEN seq % 37 = 5 THEN 'discarded_exclude' END late FROM r),
 dropped AS (SELECT *, coalesce(early, late) gone, cycle % 4 k FROM based),
 holding AS (SELECT *, CASE WHEN gone IS NULL AND k = 1 AND seq % 2 > 0 THEN 'alerts_disabled' WHEN gone IS NULL AND k = 2 THEN 'paused' END held FROM dropped),
 counting AS (SELECT *, count(*) FILTER (WHERE gone IS NULL AND held IS NULL AND seq % 7 > 0) OVER (PARTITION BY cycle ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) sends FROM holding),
 ending AS (SELECT *, coalesce(gone, held, CASE WHEN sends >= 3 THEN 'notification_limit' WHEN seq % 7 > 0 THEN 'sent' ELSE 'delivery_failed' END) outcome FROM counting)
 SELECT cycle, count(*) detected, count(*) FILTER (WHERE gone IS NULL) eligible, count(*) FILTER (WHERE early IS NULL AND status = 'warning') relevance_warning, count(*) FILTER (WHERE length(coalesce(description, '')) < 600) description_unavailable, 0 discarded_description_unavailable, CAST(sum(seq % 3) AS BIGINT) duplicate_channels,
 count(*) FILTER (WHERE outcome = 'sent' OR (outcome = 'alerts_disabled' AND k = 1)) saved, """
    + ", ".join(f"count(*) FILTER (WHERE outcome = '{n}') {n}" for n in ("discarded_time_window", "unverified_time_window", "discarded_location", "discarded_include", "discarded_exclude", "discarded_relevance", "seen", "paused", "notification_limit", "alerts_disabled", "delivery_failed", "sent"))
    + " FROM ending GROUP BY 1"
)


def q_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts")).withColumn("tags", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('["'), "event_type", F.lit('", "x"]'))).when(F.col("event_id") % 2 == 0, "[broken"))
    return scans.scan_newest_first(e, "day", "event_id", ["tags"], f"{_scratch(spark)}/scan").select("event_id", "place", F.size("tags").alias("tags"))


O_SCAN = """SELECT event_id, row_number() OVER (ORDER BY date_trunc('day', ts) DESC NULLS LAST, event_id) place, CASE WHEN event_id % 3 > 0 THEN 2 ELSE 0 END tags FROM events"""


def q_last_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("status"), F.date_trunc("hour", "ts").alias("ts"))
    return inventory.last_decisions(e, "2024-01-20 00:00:00", 48).select("key", "status", "place", "n")


O_LAST_DECISIONS = """WITH e AS (SELECT event_id AS key, event_type status, date_trunc('hour', ts) t FROM events WHERE date_trunc('hour', ts) > TIMESTAMP '2024-01-18')
 SELECT key, status, CAST(row_number() OVER (PARTITION BY status ORDER BY t DESC, key) AS INTEGER) place, count(*) OVER (PARTITION BY status) n FROM e QUALIFY row_number() OVER (PARTITION BY status ORDER BY t DESC, key) <= 10"""


QUERIES = {"ordered_scan": (q_scan, O_SCAN), "last_decisions": (q_last_decisions, O_LAST_DECISIONS), "cycle_counters": (q_cycles, O_CYCLES), "work_modes": (q_modes, O_MODES), "match_records": (q_matches, None), "names_told": (q_names, O_NAMES)}
