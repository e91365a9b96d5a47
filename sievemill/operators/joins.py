"""Comparisons of listings with what was seen, cached, captured or closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.keys import set_url_param


def anti_seen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """``df`` (source, job_id, aliases) without rows of which the id or any alias was seen.

    One equi join on exploded ids finds the rows, one drops them; the planner broadcasts what
    is small.
    """
    ids = df.select("source", "job_id", F.explode(F.array_union(F.array("job_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("any_id"))
    known = seen.select("source", F.col("job_id").alias("any_id"))
    hit = ids.join(known, ["source", "any_id"], "left_semi").select("source", "job_id").distinct()
    return df.join(hit, ["source", "job_id"], "left_anti")


def cached_decision(df: DataFrame, cache: DataFrame, now: str, ttl_days: int = 7) -> DataFrame:
    """Add ``cached``: the stored decision where key and fingerprint agree and it is young enough."""
    fresh = cache.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(ttl_days)))
    return df.join(fresh.select("source", "job_id", "fingerprint", F.col("decision").alias("cached")), ["source", "job_id", "fingerprint"], "left")


def decision_with_cache(df: DataFrame, cache: DataFrame, now: str, ttl_days: int = 7) -> DataFrame:
    """``df`` with the stored ``decision`` where there is a young one for its key and fingerprint, else its own."""
    known = cached_decision(df, cache, now, ttl_days)
    return known.withColumn("decision", F.coalesce("cached", "decision")).select(*df.columns)


def compare_inventories(production: DataFrame, reference: DataFrame, search: str = "search", key: str = "key") -> DataFrame:
    """Per search: matches, only_production, only_reference and eligible absences.

    Both sides have distinct (search, key); the reference also has ``eligible``.
    """
    both = production.select(search, key, F.lit(True).alias("p")).join(reference.select(search, key, F.lit(True).alias("r"), "eligible"), [search, key], "full_outer")
    p, r = F.col("p").isNotNull(), F.col("r").isNotNull()
    return both.groupBy(search).agg(
        F.count_if(p & r).alias("matches"), F.count_if(p & ~r).alias("only_production"), F.count_if(r & ~p).alias("only_reference"), F.count_if(r & ~p & F.col("eligible")).alias("eligible_absences")
    )


def match_by_any_key(reference: DataFrame, extracted: DataFrame) -> DataFrame:
    """Rows of both sides with their status: matched and missing references, extra extracts.

    A reference is matched by its URL or its fingerprint: two equi joins instead of one with OR.
    """
    hit = reference.join(extracted.select("url"), "url", "left_semi").select("id").union(reference.join(extracted.select("fingerprint"), "fingerprint", "left_semi").select("id")).distinct()
    told = reference.join(hit.withColumn("hit", F.lit(True)), "id", "left").select("id", F.when(F.col("hit"), "matched").otherwise("missing").alias("status"))
    extra = extracted.join(reference.select("url"), "url", "left_anti").join(reference.select("fingerprint"), "fingerprint", "left_anti")
    return told.union(extra.select("id", F.lit("extra").alias("status")))


def asof_close(batches: DataFrame, cycles: DataFrame, tolerance_seconds: int, by: list[str]) -> DataFrame:
    """Each batch with the first cycle of its key that closes it: ``closed_ts`` and ``pending``.

    Both sides are merged and a frame looks ahead for the next cycle, so one shuffle by ``by``
    and one sort replace a range join. Batches come before cycles of the same time.
    """
    rows = batches.select(*by, "ts", F.lit(0).alias("side"), F.struct(*batches.columns).alias("row"), F.lit(None).cast("timestamp").alias("cycle"))
    rows = rows.unionByName(cycles.select(*by, "ts", F.lit(1).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("ts").alias("cycle")))
    # From late to early, so that the frame grows row by row.
    ahead = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("next", F.last("cycle", ignorenulls=True).over(ahead)).where("side = 0")
    closed = F.when(F.unix_timestamp("next") - F.unix_timestamp("ts") <= tolerance_seconds, F.col("next"))
    return rows.select("row.*", closed.alias("closed_ts"), closed.isNull().alias("pending"))


def match_by_run(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """Add ``complete``: the batch's run is known, or it names none and is not after the last run."""
    latest = runs.agg(F.max("ts").alias("latest"))
    known = runs.select("run_id").distinct().withColumn("known", F.lit(True))
    rows = batches.join(known, "run_id", "left").crossJoin(F.broadcast(latest))  # one row
    named = F.coalesce("run_id", F.lit("")) != ""
    return rows.withColumn("complete", F.coalesce(F.when(named, F.col("known")).otherwise(F.col("ts") <= F.col("latest")), F.lit(False))).drop("known", "latest")


def runs_for_ledger(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs that the ledger's ``batches`` stand for: those they name, never by closeness in time.

    Where some batch names no run, all runs from the time of the first such batch on count too. Both
    sides have run_id and ts; a null run_id names none.
    """
    name = F.trim(F.coalesce("run_id", F.lit("")))
    named = batches.where(name != "").select(name.alias("__named")).distinct().withColumn("__known", F.lit(True))
    unnamed = batches.where(name == "").agg(F.min("ts").alias("__since"))
    rows = runs.join(named, F.trim("run_id") == F.col("__named"), "left").crossJoin(F.broadcast(unnamed))  # one row
    return rows.where(F.coalesce("__known", F.lit(False)) | F.coalesce(F.col("ts") >= F.col("__since"), F.lit(False))).select(*runs.columns)


def alias_dim_join(batches: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Add ``provider``: the name that the batch's own name or alias stands for."""
    rows = [(a, name) for name, others in aliases.items() for a in dict.fromkeys([name, *others])]
    dim = batches.sparkSession.createDataFrame(rows, "name string, provider string")
    return batches.join(F.broadcast(dim), "name")  # as many rows as the parameter has


def attach_outcome(metrics: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add the last recorded outcome of each metric's key, or ``None`` as text."""
    last = ledger.groupBy("key").agg(F.max_by("outcome", "seq").alias("outcome"))
    return metrics.join(last, "key", "left").withColumn("outcome", F.coalesce("outcome", F.lit("None")))


def expected_left_join(expected: DataFrame, actual: DataFrame, key: str, state: str = "state") -> DataFrame:
    """Every expected key with its state, ``missing`` where there is none."""
    return expected.join(actual, key, "left").withColumn(state, F.coalesce(state, F.lit("missing")))


def symmetric_diff(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows found on one side only, with the side."""
    left = a.join(b.select(key), key, "left_anti").withColumn("side", F.lit("only_a"))
    return left.unionByName(b.join(a.select(key), key, "left_anti").withColumn("side", F.lit("only_b")), allowMissingColumns=True)


def expand_searches(searches: DataFrame, windows: list[int], url: str = "url", param: str = "f_TPR") -> DataFrame:
    """Each search once for each valid window; without any, as it is."""
    valid = [w for w in dict.fromkeys(windows) if w > 0]
    if not valid:
        return searches.select(url).distinct()
    return searches.select(F.explode(F.array(*[set_url_param(F.col(url), param, w) for w in valid])).alias(url)).distinct()
