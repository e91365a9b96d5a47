"""Registered queries of streams with state of their own: what arrives comes in several files, with a stop after each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.operators import relevance
from sievemill.plans.feeds import _scratch
from sievemill.plans.queries import _RELEVANCE, NOW, TERMINAL, listings_view, table
from sievemill.streaming import stateful


def in_turn(spark: SparkSession, parts: list[DataFrame], path: str, take: Callable[[DataFrame], None]) -> None:
    """Let ``parts`` arrive one after the other; the stream is started anew for each and takes what is there."""
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        take(spark.readStream.schema(part.schema).parquet(f"{path}/in"))


HOURS = 12


def q_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("complete"))
    weeks = [runs.where(F.ceil(F.day("ts") / 8) == n) for n in range(1, 5)]

    def take(stream: DataFrame) -> None:
        alarms = stateful.missing_heartbeats(stream, "source", timedelta(hours=HOURS))
        alarms.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()

    in_turn(spark, weeks, path, take)
    return spark.read.schema("source long, ts timestamp").parquet(f"{path}/out").groupBy("source", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("alarms"), F.sum(F.unix_millis("ts")).alias("ms")).withColumn("day", F.unix_timestamp("day"))


O_SILENCES = f"""WITH e AS (SELECT user_id source, epoch_us(ts) // 1000 ms, event_type = 'purchase' AS complete FROM events), w AS (SELECT max(ms) w FROM e),
 m AS (SELECT source, ms FROM e WHERE complete UNION SELECT source, min(ms) FROM e GROUP BY 1), n AS (SELECT source, ms, lead(ms) OVER (PARTITION BY source ORDER BY ms) until FROM m),
 a AS (SELECT source, unnest(range(ms + 2 * {HOURS * 3600_000}, least(coalesce(until, w + 1), w + 1), {HOURS * 3600_000})) ms FROM n, w)
 SELECT source, CAST(floor(ms / 86400000) * 86400 AS BIGINT) AS day, count(*) alarms, CAST(sum(ms) AS BIGINT) ms FROM a GROUP BY 1, 2"""


def if_new(rows: DataFrame, delivered) -> DataFrame:
    """Listings with what becomes of each if its key is new; all of it Columns, so it runs on streams."""
    rows = relevance.classify_relevance(rows)
    viable = relevance.is_local(F.col("location"), F.col("title"), ["valencia", "paterna"]) | F.col("location").isin("Remoto", "Teletrabajo")
    reason = relevance.filter_reason(rows, viable, ["data", "python", "iot", "ai"], ["Company 5"])
    recent = relevance.recency_decision(F.array("url"), F.array("posted_text"), F.lit(NOW), F.col("source") == "linkedin")
    return rows.select("job_id", "source", "file", relevance.outcome(recent["state"], F.lit(False), F.col("decision"), reason, F.lit(False), delivered).alias("outcome"))


def q_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    parts = [docs.where((d % 3 == n) | ((d % 2 == 0) & (d % 3 < n))).withColumn("file", F.lit(n)) for n in range(3)]

    def take(stream: DataFrame) -> None:
        rows = listings_view(stream, "file")
        stateful.listings_once(if_new(rows, (F.col("seq") + F.col("file")) % 7 > 0), ["source", "job_id"], "file", TERMINAL, f"{path}/out", f"{path}/state")

    in_turn(spark, parts, path, take)
    return spark.read.parquet(f"{path}/out/outcomes").select("job_id", "source", "file", "outcome")


_IF_NEW = (
    _RELEVANCE
    + r""", c AS (SELECT job_id, source, f.file, seq, CASE WHEN source = 'linkedin' AND seq % 5 > 0 AND (seq % 90) * 60 > seq % 5 * 900 THEN 'discarded_time_window' WHEN source = 'linkedin' AND seq % 5 = 0 THEN 'unverified_time_window'
 WHEN status = 'rejected' THEN 'discarded_relevance:' || family WHEN location NOT IN ('Valencia', 'Paterna, Valencia', 'Remoto', 'Teletrabajo') THEN 'discarded_location'
 WHEN source <> 'linkedin' AND NOT regexp_matches(lower(concat_ws(' ', title, company, location, description)), '(^|[^\p{L}\p{M}\p{N}_])(data|python|iot|ai)([^\p{L}\p{M}\p{N}_]|$)') THEN 'discarded_include' WHEN seq % 37 = 5 THEN 'discarded_exclude' WHEN (seq + f.file) % 7 > 0 THEN 'sent' ELSE 'delivery_failed' END outcome
 FROM r JOIN (SELECT unnest([0, 1, 2]) file) f ON seq % 3 = f.file OR (seq % 2 = 0 AND seq % 3 < f.file))"""
)
O_ONCE = _IF_NEW + """ SELECT job_id, source, file, CASE WHEN outcome NOT IN ('discarded_time_window', 'unverified_time_window') AND coalesce(bool_or(outcome = 'sent') OVER (PARTITION BY source, job_id ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'seen' ELSE outcome END outcome FROM c"""


def q_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("user_id").alias("source"), F.floor(F.unix_timestamp("ts") / 86_400).alias("run"), (F.col("value") > 50).alias("young"), ((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("whole"))
    days = F.col("run") - 19_723
    parts = [rows.where((days >= 10 * n) & (days < 10 * n + 10)) for n in range(3)]
    in_turn(spark, parts, path, lambda stream: stateful.recovered(stream, "source", "run", F.col("young"), F.col("whole"), f"{path}/out", f"{path}/state"))
    return spark.read.parquet(f"{path}/out/rows").select("event_id", "source", "run")


O_RECOVERY = """WITH e AS (SELECT event_id, user_id source, CAST(floor(epoch(ts) / 86400) AS BIGINT) run, value > 50 young, event_type = 'purchase' AND value > 60 AS whole FROM events),
 w AS (SELECT *, min(CASE WHEN whole THEN run END) OVER (PARTITION BY source) ends FROM e)
 SELECT event_id, source, run FROM w WHERE coalesce(young, false) OR coalesce(run > ends, false)"""


def q_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    third = rows.agg(F.ceil((F.max("event_id") + 1) / 3).alias("n")).first()["n"] or 1
    parts = [rows.where((F.col("event_id") >= n * third) & (F.col("event_id") < (n + 1) * third)) for n in range(3)]
    in_turn(spark, parts, path, lambda stream: stateful.append_unseen(stream, f"{path}/out", f"{path}/state", ["user_id"], "event_id"))
    return spark.read.schema("user_id long, event_id long").option("recursiveFileLookup", "true").parquet(f"{path}/out")


O_UNSEEN = "SELECT user_id, min(event_id) event_id FROM events GROUP BY 1"


QUERIES = {
    "stream_silences": (q_silences, O_SILENCES), "stream_outcomes": (q_outcomes, O_ONCE), "stream_recovery": (q_recovery, O_RECOVERY), "stream_unseen": (q_unseen, O_UNSEEN),
}
