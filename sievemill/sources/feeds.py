"""Reading feeds, logs and pages into rows. Bodies are parsed in the JVM, one row per response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions.text import squash
from sievemill.functions.times import parse_ts


def read_jsonl_window(spark: SparkSession, path: str | list[str], start: str, end: str, time_field: str = "timestamp") -> DataFrame:
    """JSON lines as (value, ts, state); state is ok, malformed or invalid_timestamp.

    Blank lines are skipped, objects outside start..end (both included) dropped; the others are
    kept to be counted.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = F.try_parse_json("value")
    ts = parse_ts(F.get_json_object("value", f"$.{time_field}"))
    rows = lines.select("value", (whole.isNotNull() & F.ltrim("value").startswith("{")).alias("ok"), ts.alias("ts"))
    state = F.when(~F.col("ok"), "malformed").when(F.col("ts").isNull(), "invalid_timestamp").otherwise("ok")
    inside = F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return rows.select("value", F.when(F.col("ok"), F.col("ts")).alias("ts"), state.alias("state")).where((F.col("state") != "ok") | inside)


def import_seen_text(spark: SparkSession, path: str, now: str) -> DataFrame:
    """Lines ``key|epoch`` or ``key`` as (key, ts); a bad epoch is now, the first line of a key wins."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at")).where("value <> ''")
    epoch = F.split_part("value", F.lit("|"), F.lit(2)).try_cast("double")
    rows = lines.select(F.split_part("value", F.lit("|"), F.lit(1)).alias("key"), F.coalesce(F.timestamp_seconds(epoch), F.lit(now).cast("timestamp")).alias("ts"), "at")
    return rows.groupBy("key").agg(F.min_by("ts", "at").alias("ts"))


def parse_json_feed(raw: DataFrame, schema: str, items: str, mapping: dict[str, Column]) -> DataFrame:
    """Bodies (source, body) to listings: ``mapping`` gives each output column from ``item``.

    Items without id or title are skipped; ids get the source as a prefix. Of rows with the same
    id, which are repeats of one posting, one with the smallest title stays.
    """
    parsed = raw.select("source", F.explode(F.from_json("body", schema)[items]).alias("item"))
    rows = parsed.select("source", *[c.alias(name) for name, c in mapping.items()])
    rows = rows.where(F.col("id").isNotNull() & (squash(F.col("title")) != "")).withColumn("id", F.concat_ws("_", "source", "id"))
    rest = [c for c in rows.columns if c not in ("id", "title")]
    return rows.groupBy("id").agg(F.min(F.struct("title", *rest)).alias("__row")).select("id", "__row.*")


def parse_rss_feed(raw: DataFrame) -> DataFrame:
    """RSS bodies (source, body) to (id, source, company, title, url, published)."""
    item = raw.select("source", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("item"))
    field = lambda tag: squash(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1"))
    rows = item.select("source", field("title").alias("said"), field("link").alias("url"), parse_ts(field("pubDate")).alias("published"))
    named = F.col("said").contains(":")
    return rows.where("url <> ''").select(
        F.substring(F.md5("url"), 1, 12).alias("id"), "source", F.when(named, F.trim(F.split_part("said", F.lit(":"), F.lit(1)))).alias("company"),
        F.when(named, F.trim(F.regexp_replace("said", r"^[^:]*:", ""))).otherwise(F.col("said")).alias("title"), "url", "published",
    )


def extract_links(pages: DataFrame, path: str) -> DataFrame:
    """Anchors of pages (page_id, url, html) to the same host whose path matches: page_id, url, title.

    The first anchor of each target counts; titles have 1 to 300 characters, markup removed and
    character references as they stand.
    """
    head = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    anchors = pages.select("page_id", head.alias("head"), F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))).alias("at", "a"))
    href = F.regexp_replace(F.regexp_extract("a", r'href="([^"]*)"', 1), "#.*$", "")
    full = F.when(href.startswith("/") & ~href.startswith("//"), F.concat("head", href)).otherwise(href)
    rows = anchors.select("page_id", "head", "at", full.alias("url"), squash(F.regexp_replace("a", r"(?s)<[^>]*>", "")).alias("title"))
    rest = F.substring(F.col("url"), F.length("head") + 1, F.length("url"))
    kept = rows.where((F.col("head") != "") & F.col("url").startswith(F.col("head")) & rest.rlike(path) & F.length("title").between(1, 300))
    return kept.groupBy("page_id", "url").agg(F.min_by("title", "at").alias("title"))


def import_decision_map(raw: DataFrame) -> DataFrame:
    """Bodies holding one object ``key -> {fingerprint, decision, timestamp}`` as rows; broken bodies give none."""
    entry = "map<string, struct<fingerprint: string, decision: struct<status: string, score: string, family: string, positive_evidence: array<string>, negative_evidence: array<string>, needs_description: boolean>, timestamp: string>>"
    rows = raw.select(F.explode(F.from_json("body", entry)).alias("key", "e"))
    return rows.select("key", F.col("e.fingerprint").alias("fingerprint"), decode_decision(F.col("e.decision")).alias("decision"), parse_ts(F.col("e.timestamp")).alias("ts"))


def decode_decision(stored: Column) -> Column:
    """A stored decision, score clipped to 0..100; null if the status is unknown or the score no number.

    A missing score is 0 and a missing family the one without evidence.
    """
    score = F.coalesce(stored["score"], F.lit("0")).try_cast("double").cast("int")
    fine = stored["status"].isin("accepted", "warning", "rejected") & score.isNotNull()
    return F.when(fine, F.struct(stored["status"].alias("status"), F.least(F.greatest(score, F.lit(0)), F.lit(100)).alias("score"), F.coalesce(F.nullif(stored["family"], F.lit("")), F.lit("sin_evidencia_digital")).alias("family")))


def flatten_run_payload(runs: DataFrame) -> DataFrame:
    """Run payloads (body) to one row per run, search, role and card.

    ``role`` is production or reference. An unknown state is partial; cards without title or url
    are dropped; run ids keep 128 characters.
    """
    card = "array<struct<id: string, title: string, company: string, location: string, url: string, posted: string, postedAt: string, published_at: string, publishedAt: string>>"
    schema = f"run_id string, runId string, searches array<struct<url: string, searchUrl: string, state: string, jobs: {card}, referenceJobs: {card}, reference_jobs: {card}>>"
    body = runs.select(F.from_json("body", schema).alias("r"))
    search = body.select(F.substring(F.coalesce("r.run_id", "r.runId"), 1, 128).alias("run_id"), F.posexplode("r.searches").alias("search", "s"))
    state = F.when(F.col("s.state").isin("complete", "empty", "partial", "blocked", "rate_limited", "failed"), F.col("s.state")).otherwise("partial")
    sides = F.array(F.struct(F.lit("production").alias("role"), F.col("s.jobs").alias("cards")), F.struct(F.lit("reference").alias("role"), F.coalesce("s.referenceJobs", "s.reference_jobs").alias("cards")))
    side = search.select("run_id", "search", F.coalesce("s.url", "s.searchUrl").alias("search_url"), state.alias("state"), F.explode(sides).alias("side"))
    rows = side.select("run_id", "search", "search_url", "state", F.col("side.role").alias("role"), F.posexplode("side.cards").alias("position", "c"))
    kept = rows.where((squash(F.col("c.title")) != "") & (squash(F.col("c.url")) != ""))
    return kept.select("run_id", "search", "search_url", "state", "role", "position", "c.id", "c.title", "c.company", "c.location", "c.url", F.coalesce("c.posted", "c.postedAt").alias("posted"), F.coalesce("c.published_at", "c.publishedAt").alias("published_at"))
