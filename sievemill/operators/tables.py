"""Table maintenance: keyed writes, purges, ledgers and cycle metrics as DataFrames to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows to append: the first new row of each key that the target doesn't have."""
    return dedupe_first(new, key, order).join(target.select(*key), key, "left_anti")


def upsert_latest(target: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table after the last write of each key has replaced earlier ones."""
    rows = target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in target.columns if c not in key]), F.struct("__new", order)).alias("__row"))
    return last.select(*key, "__row.*").select(*target.columns)


def dedupe_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in arrival order; aggregates before the shuffle."""
    first = df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("__row"))
    return first.select(*key, "__row.*").select(*df.columns)


def purge_older_than(df: DataFrame, days: int, now: str, keep_undated: bool = False) -> DataFrame:
    """Rows of the last ``days``; those without a time stay only if asked for."""
    young = F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return df.where(young | F.col("ts").isNull() if keep_undated else young)


def purge_counted(df: DataFrame, days: int, now: str, keep_undated: bool = False) -> tuple[DataFrame, Observation]:
    """``purge_older_than`` with an observation whose ``removed`` is the number of rows left out, once the rows are written."""
    seen = Observation()
    kept = F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    kept = F.coalesce(kept, F.lit(keep_undated))
    marked = df.withColumn("__kept", kept).observe(seen, F.count_if(~F.col("__kept")).alias("removed"))
    return marked.where("__kept").drop("__kept"), seen


def ledger_items(jobs: DataFrame) -> DataFrame:
    """(provider, key, outcome): the rows behind ``build_ledger_batches``, which has their counts.

    They are a table of their own, as a provider's rows have no bound; no titles, URLs or texts are kept.
    """
    name = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    return jobs.select(F.when(name == "", "unknown").otherwise(name).alias("provider"), "key", "outcome")


def keep_last_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n`` newest rows."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def recent_unique(df: DataFrame, now: str, days: int, n: int, key: str, seq: str) -> DataFrame:
    """The last-written row of each key of the last ``days``, newest first, at most ``n``."""
    rows = purge_older_than(df.where(F.col(key).isNotNull()), days, now)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), seq).alias("__row"))
    return last.select(key, "__row.*").select(*df.columns).orderBy(F.desc(seq)).limit(n)


def build_ledger_batches(jobs: DataFrame, terminal: list[str]) -> DataFrame:
    """Per provider: detected, terminal, unaccounted, complete and a count per outcome.

    ``jobs`` has source, key and outcome; no titles, URLs or texts are kept. Outcomes are
    terminal when listed or of the form ``discarded_relevance:…``.
    """
    name = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    rows = jobs.select(F.when(name == "", "unknown").otherwise(name).alias("provider"), "key", "outcome")
    done = F.col("outcome").isin(*terminal) | F.col("outcome").startswith("discarded_relevance:")
    counts = rows.groupBy("provider", "outcome").agg(F.count("*").alias("n"), F.count_if(done).alias("done"))
    outcomes = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("outcome").isNotNull(), F.struct("outcome", "n")))))
    return counts.groupBy("provider").agg(F.sum("n").alias("detected"), F.sum("done").alias("terminal"), outcomes.alias("outcomes")).select(
        "provider", "detected", "terminal", (F.col("detected") - F.col("terminal")).alias("unaccounted"), (F.col("detected") == F.col("terminal")).alias("complete"), "outcomes"
    )


def build_cycle_metric(stats: DataFrame, cycle: str, provider: str, counts: list[str]) -> DataFrame:
    """Per cycle a map from provider to its counts, clipped at zero."""
    entry = F.struct(provider, F.struct(*[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in counts]))
    return stats.groupBy(cycle).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("providers"))


def first_n_per_group(df: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")
