"""Channels, captures and audits of what searches found, and lists of what was decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.aggregates import merge_duplicates
from sievemill.operators.windows import latest_per_key


def search_complete(state: Column, diagnostics: Column) -> Column:
    """A search that ended well: enough seen, the target whole, and no challenge.

    ``diagnostics`` maps reachedEnd, stableRounds, firstPageTargetReached, firstPageTargetComplete
    (true if absent) and challengeDetected to text; null maps are empty.
    """
    flag = lambda name, default: F.coalesce(F.lower(F.try_element_at(diagnostics, F.lit(name))) == "true", F.lit(default))
    rounds = F.coalesce(F.try_element_at(diagnostics, F.lit("stableRounds")).try_cast("int"), F.lit(0))
    enough = flag("firstPageTargetReached", False) | (flag("reachedEnd", False) & (rounds >= 3))
    return F.coalesce(state, F.lit("")).isin("complete", "empty") & enough & flag("firstPageTargetComplete", True) & ~flag("challengeDetected", False)


def channel_union(cards: DataFrame, searches: DataFrame) -> DataFrame:
    """Per run the union of its searches: unique cards, channel duplicates, completeness.

    ``cards`` (run_id, search, key), ``searches`` (run_id, search, complete), one row per expected
    search. A card counts once per search; what several searches found again is a duplicate.
    """
    per = cards.select("run_id", "search", "key").distinct()
    found = per.groupBy("run_id", "key").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("unique_cards"), F.sum("n").alias("found"))
    whole = searches.groupBy("run_id").agg(F.count("*").alias("searches"), F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"))
    rows = whole.join(found, "run_id", "left")
    unique = F.coalesce("unique_cards", F.lit(0))
    return rows.select("run_id", "searches", "complete", unique.alias("unique_cards"), F.greatest(F.coalesce("found", F.lit(0)) - unique, F.lit(0)).alias("channel_duplicates"))


def channel_cards(cards: DataFrame, placeholders: list[str]) -> DataFrame:
    """(run_id, key, …): the distinct cards of a run, merged over its searches in arrival order.

    ``cards`` has run_id, key, seq and the fields that ``merge_duplicates`` reads; ``channel_union``
    has their numbers.
    """
    return merge_duplicates(cards, ["run_id", "key"], "seq", placeholders)


def capture_validity(captures: DataFrame, tolerance: int = 120) -> DataFrame:
    """Add ``reasons`` and ``valid`` to captures of a production and a reference side.

    Reads complete, target_complete, challenge, production_at, reference_at (times), production and
    reference (numbers of cards). Nulls are false, missing times too far apart.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    apart = F.abs(F.unix_timestamp("production_at") - F.unix_timestamp("reference_at"))
    said = [
        (~flag("complete"), "search_incomplete"), (~flag("target_complete"), "target_incomplete"), (F.coalesce(apart > tolerance, F.lit(True)), "captures_too_far_apart"), (flag("challenge"), "challenge_detected"),
        ((F.coalesce("production", F.lit(0)) > 0) & (F.coalesce("reference", F.lit(0)) == 0), "reference_missing"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in said]))
    return captures.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


# What in a failure's name says that a source is shut off.
SHUT = ("http_403", "http_429", "challenge")


def audit_source(reference: DataFrame, extracted: DataFrame, eligible: Callable[[DataFrame], Column], failures: DataFrame | None = None) -> DataFrame:
    """Per source: matched, missing, extra and eligible rows missing, with status and reason.

    Both sides have source and key; ``eligible`` tells a reference row that should have been found.
    ``failures`` (source, reference_failure, blocked_reason; one row each, texts may be null) comes
    first: a shut-off reference or source is ``blocked``, other failures are ``degraded``. Else the
    source is ``pending_validation`` without a reference, ``degraded`` if eligible rows are missing,
    and ``validated``.
    """
    want = reference.withColumn("__wanted", eligible(reference)).groupBy("source", "key").agg(F.bool_or("__wanted").alias("wanted"))
    got = extracted.select("source", "key", F.lit(True).alias("got")).distinct()
    rows = want.withColumn("told", F.lit(True)).join(got, ["source", "key"], "full_outer")
    told, has = F.coalesce("told", F.lit(False)), F.coalesce("got", F.lit(False))
    out = rows.groupBy("source").agg(F.count_if(told & has).alias("matched"), F.count_if(told & ~has).alias("missing"), F.count_if(~told).alias("extra"), F.count_if(told & ~has & F.coalesce("wanted", F.lit(False))).alias("eligible_missing"))
    if failures is None:
        failures = out.select("source", F.lit("").alias("reference_failure"), F.lit("").alias("blocked_reason")).limit(0)
    out = out.join(failures.select("source", "reference_failure", "blocked_reason"), "source", "full_outer").fillna(0, ["matched", "missing", "extra", "eligible_missing"])
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    shut = lambda c: F.coalesce(F.col(c), F.lit("")).rlike("|".join(SHUT))
    ref, own = name("reference_failure"), name("blocked_reason")
    verdict = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    ladder = (
        F.when(shut("reference_failure"), verdict("blocked", ref))
        .when(shut("blocked_reason"), verdict("blocked", own))
        .when(own != "", verdict("degraded", own))
        .when(ref != "", verdict("degraded", ref))
        .when(F.col("matched") + F.col("missing") == 0, verdict("pending_validation", "reference_empty"))
        .when(F.col("eligible_missing") > 0, verdict("degraded", "eligible_offers_missing"))
        .otherwise(verdict("validated", "coverage_ok"))
    )
    return out.withColumn("__v", ladder).select("source", "matched", "missing", "extra", "eligible_missing", "__v.status", "__v.reason")


def comparison_counts(runs: DataFrame) -> DataFrame:
    """Per run what its audit found: matches, only_production, only_reference, api_rate_limited, eligible_absences.

    ``runs`` has run_id, the audit's numbers ``matches``, ``only_bot``, ``only_reference`` and
    ``eligible_absences`` (null: 0) and ``urls``, an array of structs whose ``api`` is a state; a null
    array has none.
    """
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    limited = F.coalesce(F.size(F.filter("urls", lambda u: u["api"] == "rate_limited")), F.lit(0))
    return runs.select("run_id", number("matches").alias("matches"), number("only_bot").alias("only_production"), number("only_reference").alias("only_reference"), F.greatest(limited, F.lit(0)).cast("long").alias("api_rate_limited"), number("eligible_absences").alias("eligible_absences"))


def channel_ages(runs: DataFrame, now: str, by: list[str]) -> DataFrame:
    """Per ``by`` the seconds since the last extension run, complete one, API run and fallback; null without one.

    ``runs`` has ts, channel (extension or api), complete and fallback; null flags are false.
    """
    old = lambda which: (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(F.when(which, F.col("ts"))))).cast("long")
    mine, flag = F.col("channel") == "extension", lambda c: F.coalesce(F.col(c), F.lit(False))
    api = F.col("channel") == "api"
    ages = [old(mine).alias("extension_received"), old(mine & flag("complete")).alias("extension_complete"), old(api).alias("api_run"), old(api & flag("fallback")).alias("fallback")]
    return runs.groupBy(*by).agg(*ages, F.coalesce(F.max_by(flag("complete"), F.when(api, F.col("ts"))) & (F.count_if(api) > 0), F.lit(False)).alias("last_api_ok"))


def last_n_per_group(df: DataFrame, n: int, by: str, order: str, reach: int | None = None) -> DataFrame:
    """The newest ``n`` rows of each group, among the newest ``reach`` rows if that is given."""
    rows = df.orderBy(F.desc(order)).limit(reach) if reach else df
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("place") <= n)


def decision_counts(decisions: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """How many decisions of each status the last ``hours`` brought."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return decisions.where(F.col("ts") >= since).groupBy("status").agg(F.count("*").alias("n"))


def last_decisions(decisions: DataFrame, now: str, hours: int = 24, n: int = 10) -> DataFrame:
    """The newest ``n`` decisions of each status of the last ``hours``, with ``place`` from 1 and the status's total ``n``.

    Reads key, status and ts; ties by key. A list of ``n`` per status is the report; the totals count all.
    """
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = decisions.where(F.col("ts") > since)
    newest = Window.partitionBy("status").orderBy(F.desc("ts"), "key")
    listed = recent.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)
    return listed.join(recent.groupBy("status").agg(F.count("*").alias("n")), "status")


def term_frequency(df: DataFrame, stack: Column, description: str, leak: str, key: str, short: int = 50) -> DataFrame:
    """Per technology: distinct listings naming it, how many say little, how many hold a leak phrase."""
    text = F.coalesce(F.col(description), F.lit(""))
    rows = df.groupBy(key).agg(F.max_by(F.struct(stack.alias("stack"), (F.length(F.trim(text)) <= short).alias("little"), F.lower(text).contains(leak.lower()).alias("leak")), F.length(text)).alias("r"))
    return rows.select(F.explode("r.stack").alias("term"), "r.little", "r.leak").groupBy("term").agg(F.count("*").alias("listings"), F.count_if("little").alias("short_texts"), F.count_if("leak").alias("leaks"))


def health_board(stats: DataFrame, enabled: DataFrame) -> DataFrame:
    """State and reason of every provider of the newest cycle, and of enabled ones absent from it (quarantine).

    ``stats`` has cycle, provider, validation_status (a boolean, null: none), http_429, blocked_reason
    and detected; ``enabled`` has provider and, where told, reason. In this order: a failed
    validation is ``paused``, any 429 ``blocked``, a reason ``error``, detected rows ``ok``, else ``empty``.
    """
    newest = stats.agg(F.max("cycle").alias("cycle"))
    now = latest_per_key(stats.join(F.broadcast(newest), "cycle", "left_semi"), "provider", "cycle").drop("reason")  # one row
    told = F.col("reason") if "reason" in enabled.columns else F.lit(None).cast("string")
    asked = enabled.select("provider", told.alias("__told")).groupBy("provider").agg(F.max("__told").alias("__told"))
    why = F.nullif(F.col("blocked_reason"), F.lit(""))
    verdict = lambda state, reason: F.struct(F.lit(state).alias("state"), reason.cast("string").alias("reason"))
    none = F.lit(None)
    state = (
        F.when(F.col("cycle").isNull(), verdict("quarantine", F.coalesce("__told", F.lit("Pendiente de validación"))))
        .when(F.coalesce(~F.col("validation_status"), F.lit(False)), verdict("paused", F.coalesce(why, F.lit("Validación pendiente"))))
        .when(F.coalesce("http_429", F.lit(0)) > 0, verdict("blocked", F.lit("Rate Limit / Captcha")))
        .when(why.isNotNull(), verdict("error", why))
        .when(F.coalesce("detected", F.lit(0)) > 0, verdict("ok", none))
        .otherwise(verdict("empty", none))
    )
    return asked.join(now, "provider", "full_outer").select("provider", state.alias("v")).select("provider", "v.*")


def count_keys(store: DataFrame, key: str) -> DataFrame:
    """How many distinct keys a store holds."""
    return store.agg(F.count_distinct(key).alias("keys"))


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of both sides once, with the set that holds it: both, left or right."""
    side = lambda df, name: df.select(key, F.lit(name).alias("side"))
    held = side(left, "left").unionByName(side(right, "right")).groupBy(key).agg(F.collect_set("side").alias("sides"))
    return held.select(key, F.when(F.size("sides") == 2, "both").otherwise(F.col("sides")[0]).alias("side"))


def lookup_cascade(df: DataFrame, args: DataFrame, order: str, most: int = 10_000) -> DataFrame:
    """For each argument the first listing that it names: by place, part of id, company or title.

    ``args`` (arg) is a small table of what users typed, of a checked size: at most ``most`` distinct
    ones are broadcast, more are an error. ``df`` has job_id, company, title and ``place`` from 1. A
    blank argument names the first listing. A number of under six digits is a place and nothing else,
    so one out of range names nothing.

    Arguments are found by the first three characters they have: rows are joined on the pieces of
    their texts that some argument begins with, and only those pairs are compared in full.
    """
    few = args.select(F.trim(F.coalesce("arg", F.lit(""))).alias("arg")).distinct().withColumn("low", F.lower("arg"))
    if few.limit(most + 1).count() > most:
        raise ValueError(f"look up at most {most} arguments at once")
    is_place = F.col("arg").rlike("^[0-9]{1,5}$")
    by_place = few.where(is_place | (F.col("arg") == "")).select("arg", F.when(F.col("arg") == "", 1).otherwise(F.col("arg").cast("int")).alias("place"))
    placed = df.select("place", "job_id", F.col(order).alias("__order")).join(F.broadcast(by_place), "place").select("arg", F.lit(1).alias("rank"), "__order", "job_id")
    words = few.where(~is_place & (F.col("arg") != "")).withColumn("piece", F.substring("low", 1, 3))
    sizes = [r["n"] for r in words.select(F.length("piece").alias("n")).distinct().collect()]  # at most 1, 2, 3
    texts = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lower(F.coalesce(F.col(c), F.lit(""))).alias("said")) for rank, c in ((2, "job_id"), (3, "company"), (4, "title"))])
    rows = df.select("job_id", F.col(order).alias("__order"), F.explode(texts).alias("t")).select("job_id", "__order", "t.*")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("said") - n + 1, F.lit(1))), lambda at: F.substring("said", at, F.lit(n)))
    pieces = F.array_distinct(F.flatten(F.array(*map(cut, sizes)))) if sizes else F.array().cast("array<string>")
    found = rows.withColumn("piece", F.explode(pieces)).join(F.broadcast(words), "piece").where(F.contains("said", "low")).select("arg", "rank", "__order", "job_id")
    best = placed.unionByName(found).groupBy("arg").agg(F.min_by(F.struct("job_id", "rank"), F.struct("rank", "__order")).alias("r"))
    return best.select("arg", "r.job_id", "r.rank")


def gap_fallback(runs: DataFrame, interval_seconds: int, start: str, by: str) -> DataFrame:
    """Add ``due``: no complete run of the key in the last two intervals, counted from ``start`` at least.

    The rule that a fallback isn't repeated within an interval keeps state and is in the stream
    operator of missing runs.
    """
    at = F.unix_timestamp("ts")
    before = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("complete"), at), ignorenulls=True).over(before)
    wait = 2 * interval_seconds
    begun = F.unix_timestamp(F.lit(start).cast("timestamp"))
    return runs.withColumn("due", (at >= begun + wait) & (last.isNull() | (at - last >= wait)))


def cycle_history(cycles: DataFrame, keep: int = 20, shown: int = 8) -> DataFrame:
    """The newest ``shown`` of the newest ``keep`` cycles; both are limits of the view."""
    return cycles.orderBy(F.desc("cycle")).limit(keep).orderBy(F.desc("cycle")).limit(shown)
