"""Reports and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_duplicates(df: DataFrame, key: str | list[str], seq: str, placeholders: list[str]) -> DataFrame:
    """Merge the rows of each key in arrival order.

    The last title, company and location that are no placeholder and the last non-empty url win;
    of descriptions the longest, earlier on ties; flags are or-ed and aliases united in order. A
    null list of aliases has none. Aliases are made distinct before they are gathered, so a key of
    many rows gathers no more than it gives.
    """
    keys = [key] if isinstance(key, str) else key
    told = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", *placeholders)
    last = lambda c: F.max_by(c, F.when(told(c), F.col(seq)))
    text = F.coalesce("description", F.lit(""))
    merged = df.groupBy(*keys).agg(
        *[F.coalesce(last(c), F.min_by(c, seq)).alias(c) for c in ("title", "company", "location", "url")],
        F.max_by(text, F.struct(F.length(text), -F.col(seq))).alias("description"),
        F.bool_or("is_fresh").alias("is_fresh"),
    )
    named = [F.col(k).alias(f"__{k}") for k in keys]
    single = df.select(*named, F.col(seq).alias("__seq"), F.posexplode("aliases").alias("__pos", "__alias"))
    firsts = single.groupBy(*[f"__{k}" for k in keys], "__alias").agg(F.min(F.struct("__seq", "__pos")).alias("__first"))
    united = firsts.groupBy(*[f"__{k}" for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__alias"))), lambda x: x["__alias"]).alias("aliases"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return merged.join(united, same, "left").select(*merged.columns, F.coalesce("aliases", F.array().cast(df.schema["aliases"].dataType)).alias("aliases"))


def process_stats(outcomes: DataFrame, names: list[str]) -> DataFrame:
    """Per provider one count for each outcome, and how many were detected."""
    return outcomes.groupBy("provider").agg(F.count("*").alias("detected"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def cycle_totals(stats: DataFrame, counts: list[str]) -> DataFrame:
    """Sums per cycle and provider, per cycle and overall."""
    return stats.rollup("cycle", "provider").agg(*[F.sum(c).alias(c) for c in counts])


def group_topk_examples(df: DataFrame, group: str, item: str, k: int, examples: int = 3) -> DataFrame:
    """The ``k`` largest groups with their size, distinct items and first examples.

    Items are made distinct first, and only the first ``examples`` of a group are gathered.
    """
    per = df.groupBy(group, item).agg(F.count("*").alias("n"))
    top = per.groupBy(group).agg(F.sum("n").alias("postings"), F.count(item).alias("distinct_items")).orderBy(F.desc("postings"), group).limit(k)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(item)))
    first = per.withColumn("rank", rank).where(F.col("rank") <= examples).groupBy(F.col(group).alias("__of")).agg(F.array_sort(F.collect_list(item)).alias("samples"))
    out = top.join(first, top[group].eqNullSafe(F.col("__of")), "left")
    return out.select(group, "postings", "distinct_items", F.coalesce("samples", F.array().cast(first.schema["samples"].dataType)).alias("samples"))


def market_report(metrics: DataFrame, top_companies: int = 5, top_terms: int = 6) -> DataFrame:
    """(section, key, n, percent) of listings: flags, companies, technologies, levels, sources.

    One scan: each row gives its (section, key) pairs, which are counted before the shuffle.
    """
    pair = lambda s, c: F.struct(F.lit(s).alias("section"), c.cast("string").alias("key"))
    company = F.when(F.trim(F.coalesce("company", F.lit(""))) != "", F.col("company"))
    pairs = F.concat(
        F.array(pair("total", F.lit("all")), pair("type", F.col("company_type")), pair("area", F.when(F.col("is_local"), "local").otherwise("elsewhere")), pair("company", company), pair("level", F.col("level")), pair("source", F.upper("source"))),
        F.transform("stack", lambda t: pair("technology", t)),
    )
    counts = metrics.select(F.explode(pairs).alias("p")).select("p.*").where("key IS NOT NULL").groupBy("section", "key").agg(F.count("*").alias("n"))
    # At most the larger limit of rows of a section leave each task; the other sections are small.
    limit = F.when(F.col("section") == "company", top_companies).when(F.col("section") == "technology", top_terms)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "key"))
    long_ = counts.where(limit.isNotNull()).withColumn("rank", rank).where(F.col("rank") <= max(top_companies, top_terms)).where(F.col("rank") <= limit)
    total = counts.where("section = 'total'").select(F.col("n").alias("total"))
    shown = counts.where(limit.isNull()).unionByName(long_.drop("rank")).join(F.broadcast(total))
    return shown.select("section", "key", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))
