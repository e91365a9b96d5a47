"""Coverage of sources over cycles, and whether every detected row has an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.joins import asof_close


# What a status is worth as evidence; sources that aren't monitored have no value.
EVIDENCE = {"ok": 100, "warning": 55, "insufficient_data": 25, "critical": 0}


def _count(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0)).cast("long"), F.lit(0))


def _histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per ``by`` a map from each non-blank value to its number; values are few by nature."""
    said = rows.withColumn("__v", F.trim(F.coalesce(F.col(value), F.lit("")))).where("__v <> ''").groupBy(by, "__v").agg(F.count("*").alias("__n"))
    return said.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias(value))


def _reasons(*said: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in said]))


def expected_runs(seconds: int, interval_seconds: int) -> int:
    """How many runs a time span should hold, at least one."""
    return max(1, seconds // max(1, interval_seconds))


def age_minutes(now: str, ts: Column) -> Column:
    """Whole minutes from ``ts`` to ``now``, at least 0; null without a time."""
    return F.when(ts.isNotNull(), F.greatest(F.lit(0), F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)) / 60).cast("long")))


def provider_summary(cycles: DataFrame, counts: list[str], now: str, stale_minutes: int = 50, min_ratio: float = 0.8, providers: DataFrame | None = None) -> DataFrame:
    """Per provider of (cycle, provider, ts, counts…): cycles, sums, ratio, age, status, reasons, histograms.

    ``counts`` includes http_429 and delivery_failed where they are known. Optional columns:
    blocked_reason, validation_status, validation_anomaly and instrumented (true if absent).
    ``providers`` (provider) lists those expected; one without a cycle is critical. Evidence that is
    stale, or in under half or under ``min_ratio`` of all cycles, comes first; then rate limits,
    blocks and failed deliveries are listed, each of which makes an ok source a warning.
    """
    has = lambda c, t="string": F.col(c) if c in cycles.columns else F.lit(None).cast(t)
    rows = cycles.withColumns({"blocked_reason": has("blocked_reason"), "validation_status": has("validation_status"), "__skip": F.coalesce(has("validation_anomaly").startswith("skipped_not_validated"), F.lit(False)), "__told": F.coalesce(has("instrumented", "boolean"), F.lit(True))})
    whole = cycles.agg(F.count_distinct("cycle").alias("all_cycles"))
    sums = rows.groupBy("provider").agg(F.count_distinct("cycle").alias("cycles"), F.max("ts").alias("last"), *[F.sum(_count(F.col(c))).alias(c) for c in counts], F.bool_or("__skip").alias("skipped"), F.bool_or("__told").alias("told"))
    out = sums if providers is None else providers.select("provider").distinct().join(sums, "provider", "left")
    for c in ("blocked_reason", "validation_status"):
        out = out.join(_histogram(rows, "provider", c), "provider", "left")
    out = out.join(F.broadcast(whole)).withColumns({"cycles": F.coalesce("cycles", F.lit(0).cast("long")), **{c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}})  # one row
    share, age = F.coalesce(F.col("cycles") / F.nullif(F.col("all_cycles"), F.lit(0)), F.lit(0.0)), age_minutes(now, F.col("last"))
    out = out.withColumn("age_minutes", age)
    stale = F.coalesce(F.col("age_minutes") > stale_minutes, F.lit(False))
    first = F.when(F.coalesce("skipped", F.lit(False)), "disabled_pending_human_validation").when(F.col("all_cycles") == 0, "no_scheduler_cycle_evidence").when(F.col("cycles") == 0, "provider_missing_from_all_recorded_cycles").when(~F.col("told"), "legacy_cycle_metrics_without_outcome_counts")
    main = F.when(stale, "provider_evidence_stale").when(share < 0.5, "provider_present_in_less_than_half_of_cycles").when(share < min_ratio, "provider_missing_from_some_cycles")
    over = lambda c: F.col(c) > 0 if c in counts else F.lit(False)
    more = _reasons((over("http_429"), "http_429_observed"), (F.col("blocked_reason").isNotNull(), "provider_block_or_parse_issue_observed"), (over("delivery_failed"), "delivery_failure_observed"))
    reasons = F.when(first.isNotNull(), F.array(first)).otherwise(F.concat(F.array_compact(F.array(main)), more))
    early = F.when(F.coalesce("skipped", F.lit(False)), "not_monitored").when(F.col("all_cycles") == 0, "insufficient_data").when(F.col("cycles") == 0, "critical").when(~F.col("told"), "insufficient_data")
    status = F.coalesce(early, F.when(stale | (share < 0.5), "critical").when(F.size(reasons) > 0, "warning").otherwise("ok"))
    return out.select("provider", "cycles", *counts, F.round(share, 3).alias("ratio"), "age_minutes", status.alias("status"), reasons.alias("reasons"), "blocked_reason", "validation_status")


def reconcile(batches: DataFrame, expected: DataFrame, terminal_outcomes: list[str]) -> DataFrame:
    """Ledger batches against the detected counts of (provider, expected, monitored): state and reasons.

    ``batches`` has provider, pending, detected, terminal, unaccounted, complete, ``outcomes`` (a
    map to counts) and ``jobs`` (an array of key and outcome, null where only totals are kept).
    Pending batches belong to work that no cycle has closed; alone they are in progress. Outcomes
    that are not terminal make items invalid. A source that isn't monitored is not applicable.
    """
    done = lambda o: F.coalesce(o.isin(*terminal_outcomes) | o.startswith("discarded_relevance:"), F.lit(False))
    add = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
    entries = F.map_entries("outcomes")
    fine = add(F.transform(F.filter(entries, lambda e: done(e["key"])), lambda e: _count(e["value"])))
    bad = add(F.transform(F.filter(entries, lambda e: ~done(e["key"])), lambda e: _count(e["value"])))
    items = F.when(F.col("jobs").isNotNull(), F.size("jobs").cast("long")).when(F.col("outcomes").isNull(), F.lit(0).cast("long")).otherwise(fine)
    invalid = F.when(F.col("jobs").isNotNull(), F.size(F.filter("jobs", lambda j: ~done(j["outcome"]))).cast("long")).when(F.col("outcomes").isNull(), _count(F.col("detected"))).otherwise(bad + F.abs(fine - _count(F.col("terminal"))))
    open_ = F.coalesce("pending", F.lit(False))
    total = lambda c, when: F.sum(F.when(when, c).otherwise(0))
    rows = batches.withColumns({"__items": items, "__invalid": invalid})
    sums = rows.groupBy("provider").agg(
        F.count_if(~open_).alias("batches"), *[total(_count(F.col(c)), ~open_).alias(n) for c, n in (("detected", "detected"), ("terminal", "terminal"), ("unaccounted", "unaccounted"))],
        total(F.col("__items"), ~open_).alias("item_rows"), total(F.col("__invalid"), ~open_).alias("invalid_items"), F.count_if(~open_ & ~F.coalesce("complete", F.lit(False))).alias("incomplete_batches"), F.count_if(open_).alias("pending_batches"), total(_count(F.col("detected")), open_).alias("pending_detected"),
    )
    numbers = ["batches", "detected", "terminal", "unaccounted", "item_rows", "invalid_items", "incomplete_batches", "pending_batches", "pending_detected"]
    want = expected.groupBy("provider").agg(F.sum(_count(F.col("expected"))).alias("expected"), F.bool_or("monitored").alias("monitored"))
    out = want.join(sums, "provider", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers})
    none = F.col("batches") == 0
    said = _reasons((F.col("detected") != F.col("expected"), "detected_count_mismatch"), (F.col("item_rows") != F.col("detected"), "job_rows_count_mismatch"), ((F.col("terminal") != F.col("detected")) | (F.col("unaccounted") > 0) | (F.col("invalid_items") > 0) | (F.col("incomplete_batches") > 0), "unaccounted_or_nonterminal_job"))
    early = F.when(~F.col("monitored"), "provider_not_monitored").when(none & (F.col("pending_batches") > 0), "cycle_in_progress_not_yet_persisted").when(none, F.when(F.col("expected") > 0, "missing_per_job_ledger").otherwise("no_provider_items_in_ledger_window"))
    reasons = F.when(early.isNotNull(), F.array(early)).otherwise(said)
    state = F.when(~F.col("monitored"), "not_applicable").when(none & (F.col("pending_batches") > 0), "in_progress").when(none, "insufficient_data").when(F.size(reasons) > 0, "critical").otherwise("ok")
    return out.select("provider", "expected", *numbers, reasons.alias("reasons"), state.alias("state"))


def apply_reconciliation(summaries: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Summaries whose status and reasons take in what the reconciliation found."""
    rows = summaries.join(reconciled.select("provider", F.col("state").alias("__state")), "provider", "left")
    failed, unknown = F.col("__state") == "critical", (F.col("__state") == "insufficient_data") & (F.col("status") == "ok")
    more = F.when(failed, F.array(F.lit("per_job_reconciliation_failed"))).when(unknown, F.array(F.lit("per_job_reconciliation_unavailable"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"reasons": F.concat("reasons", more), "status": F.when(failed, "critical").when(unknown, "insufficient_data").otherwise(F.col("status"))}).withColumnRenamed("__state", "reconciliation")


def overall_rollup(summaries: DataFrame, cycle_ratio: float = 1.0) -> DataFrame:
    """One row: overall status, evidence score and the number of each status.

    The worst of critical, warning and insufficient data counts; without a source that has a value
    the data are insufficient and the score is 0. The score is the mean value of the sources, at
    most the share of expected cycles in percent, rounded half to even.
    """
    value = F.lit(None).cast("int")
    for status, points in EVIDENCE.items():
        value = F.when(F.col("status") == status, points).otherwise(value)
    n = lambda s: F.count_if(F.col("status") == s)
    worst = F.when(n("critical") > 0, "critical").when(n("warning") > 0, "warning").when(n("insufficient_data") > 0, "insufficient_data").when(F.count(value) > 0, "ok").otherwise("insufficient_data")
    score = F.coalesce(F.bround(F.least(F.lit(100.0), F.lit(100.0 * cycle_ratio), F.avg(value))).cast("long"), F.lit(0).cast("long"))
    score = F.when(F.count(value) > 0, score).otherwise(0)
    return summaries.agg(worst.alias("status"), score.alias("score"), *[n(s).alias(s) for s in (*EVIDENCE, "not_monitored")])


def ledger_started_at(batches: DataFrame, origins: list[str]) -> DataFrame:
    """One row: the time of the first ledger batch of a normal run."""
    return batches.where(F.trim("origin").isin(*origins)).agg(F.min("ts").alias("started"))


def completed_cycles(cycles: DataFrame, closed: DataFrame) -> DataFrame:
    """The cycles that closed a batch of their provider: ``closed`` has provider and closed_ts."""
    keys = closed.where("closed_ts IS NOT NULL").select("provider", F.col("closed_ts").alias("ts")).distinct()
    return cycles.join(keys, ["provider", "ts"], "left_semi")


def detected_in(cycles: DataFrame) -> DataFrame:
    """Per provider the detected rows of some cycles, as (provider, expected)."""
    return cycles.groupBy("provider").agg(F.sum(_count(F.col("detected"))).alias("expected"))


def expected_detected(cycles: DataFrame, closed: DataFrame) -> DataFrame:
    """(provider, expected): rows detected in the cycles that closed a batch of the provider.

    A provider without a closed batch has all its cycles counted, so that its ledger is found
    missing instead of empty.
    """
    ended = closed.where("closed_ts IS NOT NULL").select("provider").distinct()
    return detected_in(completed_cycles(cycles, closed)).unionByName(detected_in(cycles.join(ended, "provider", "left_anti")))


def validation_snapshot(statuses: DataFrame) -> DataFrame:
    """How many sources have each status; a missing one is unknown."""
    name = F.trim(F.coalesce("status", F.lit("")))
    return statuses.groupBy(F.when(name == "", "unknown").otherwise(name).alias("status")).agg(F.count("*").alias("n"))


def coverage_report(cycles: DataFrame, batches: DataFrame, providers: DataFrame, counts: list[str], terminal_outcomes: list[str], now: str, lookback_hours: int = 26, interval_seconds: int = 900, stale_minutes: int = 50, min_ratio: float = 0.8, delay_seconds: int = 1800) -> DataFrame:
    """The daily report, one row per provider behind one row of all: section, status, reasons, numbers.

    ``cycles`` (provider, ts, counts…) are written when a cycle ends and close the ledger
    ``batches`` (provider, ts, detected, …) before them, within ``delay_seconds``; later batches are
    pending. Only cycles that closed a batch of the provider are held against its ledger.
    """
    inside = F.col("ts").between(F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(lookback_hours)), F.lit(now).cast("timestamp"))
    cycles, batches = cycles.where(inside).withColumn("cycle", F.col("ts")), batches.where(inside)
    summary = provider_summary(cycles, counts, now, stale_minutes, min_ratio, providers)
    closed = asof_close(batches, cycles.select("provider", "ts"), delay_seconds, ["provider"])
    monitored = summary.select("provider", (F.col("status") != "not_monitored").alias("monitored"))
    expected = monitored.join(expected_detected(cycles, closed), "provider", "left")
    told = reconcile(closed, expected, terminal_outcomes)
    each = apply_reconciliation(summary, told).join(told.select("provider", "expected", F.col("detected").alias("audited"), "pending_detected"), "provider", "left")
    seen = cycles.select("ts").distinct().count()
    ratio = min(1.0, seen / expected_runs(lookback_hours * 3600, interval_seconds))
    whole = overall_rollup(each, ratio)
    none = F.lit(None)
    total = whole.select(F.lit("all").alias("provider"), "status", F.array().cast("array<string>").alias("reasons"), F.col("score").alias("score"), none.cast("string").alias("reconciliation"), *[none.cast("long").alias(c) for c in ("cycles", "expected", "audited", "pending_detected")])
    return total.unionByName(each.select("provider", "status", "reasons", none.cast("long").alias("score"), "reconciliation", "cycles", "expected", "audited", "pending_detected"))


def run_summary(runs: DataFrame, by: list[str], expected: int, now: str, stale_minutes: int = 50, min_ratio: float = 0.8) -> DataFrame:
    """Per ``by`` (one row overall if empty): runs against ``expected``, counters, reasons and status.

    ``runs`` has ts, complete, partial, valid, correct, absences, unique_jobs, duplicates and urls,
    an array of (extension, api) states. Negative and null counts are 0, null flags false. A stale,
    incomplete or too rare source has that single reason; else all that apply are listed.
    """
    flag, total = (lambda c: F.count_if(F.coalesce(c, F.lit(False)))), (lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))), F.lit(0)))
    state = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    states = F.concat(F.transform("urls", lambda u: state(u["extension"])), F.transform("urls", lambda u: state(u["api"])))
    limited, stopped = (lambda s: s.contains("rate_limit") | s.contains("429")), (lambda s: s.isin("blocked", "challenge", "failed"))
    sums = runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.max("ts").alias("last"), flag(F.col("complete")).alias("complete"), flag(F.col("partial")).alias("partial"), flag(F.col("valid")).alias("valid"), flag(F.col("correct")).alias("correct"),
        *[total(F.col(c)).alias(c) for c in ("absences", "unique_jobs", "duplicates")], total(F.size("urls")).alias("urls"), total(F.size(F.filter(states, limited))).alias("rate_limited"), total(F.size(F.filter(states, stopped))).alias("blocked"),
    )
    age = F.greatest(F.lit(0), F.round((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 60).cast("long"))
    rows = sums.withColumn("age_minutes", age).withColumn("ratio", F.round(F.col("runs") / F.lit(expected), 3))
    share = F.col("runs") / F.lit(expected)
    fatal = F.when(F.col("runs") == 0, "no_run_evidence").when(F.col("age_minutes") > stale_minutes, "evidence_stale").when(F.col("complete") == 0, "no_complete_batch").when(share < 0.5, "too_few_runs")
    audit = F.when(F.col("valid") == 0, "no_valid_audit").when(F.col("correct") == 0, "audit_not_correct")
    said = [(share < min_ratio, "below_expected_ratio"), (F.col("partial") > 0, "partial_batches"), (F.col("absences") > 0, "eligible_absence")]
    more = [(F.col("rate_limited") > 0, "rate_limited"), (F.col("blocked") > 0, "blocked")]
    listed = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in said], audit, *[F.when(c, F.lit(r)) for c, r in more]))
    reasons = F.when(fatal.isNotNull(), F.array(fatal)).otherwise(listed)
    status = F.when(fatal.isNotNull() | (F.col("absences") > 0), "critical").when(F.size(listed) > 0, "warning").otherwise("ok")
    return rows.select(*by, "runs", "ratio", "age_minutes", "complete", "partial", "valid", "correct", "absences", "unique_jobs", "duplicates", "urls", "rate_limited", "blocked", reasons.alias("reasons"), status.alias("status"))
