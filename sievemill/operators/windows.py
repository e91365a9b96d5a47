"""Quotas, anomalies and running states over ordered observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cap_per_group(df: DataFrame, n: int, by: list[str], order: str, delivered: str) -> DataFrame:
    """Add ``limited``: n rows of the group were delivered before this one; 0 is no limit.

    Only the place of the n-th delivered row has to be known of a group, so at most n rows of it
    leave each task.
    """
    if not n:
        return df.withColumn("limited", F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    last = df.where(F.col(delivered)).select(*by, order).withColumn("__rank", rank).where(F.col("__rank") <= n).where(F.col("__rank") == n)
    last = last.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col(order).alias("__last"))
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(F.col(f"__of_{c}"))
    return df.join(last, same, "left").select(*df.columns, F.coalesce(F.col(order) > F.col("__last"), F.lit(False)).alias("limited"))


def volume_anomaly(obs: DataFrame) -> DataFrame:
    """Add ``anomaly`` of (source, ts, count, blocked) against the source's previous row."""
    before = F.lag("count").over(Window.partitionBy("source").orderBy("ts"))
    rows = obs.withColumn("previous", before)
    kind = (
        F.when(F.coalesce("blocked", F.lit("")) != "", "blocked_or_http_error")
        .when((F.col("previous") > 0) & (F.col("count") == 0), "zero_after_success")
        .when((F.col("previous") >= 10) & (F.col("count") > 0) & (3 * F.col("count") <= F.col("previous")), "strong_volume_drop")
    )
    return rows.withColumn("anomaly", kind)


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("__row"))
    return last.select(key, "__row.*").select(*df.columns)


def last_good(df: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """Add ``last_ok``: the time of the key's last good row so far."""
    return df.withColumn("last_ok", F.last(F.when(F.col(ok), F.col(order)), ignorenulls=True).over(Window.partitionBy(key).orderBy(order)))


def order_if_all_dated(df: DataFrame, source: str, published: str, seq: str) -> DataFrame:
    """Add ``position`` and ``ordering``: by publication only if all rows of the source have one."""
    whole = Window.partitionBy(source)
    rows = df.withColumn("ordering", F.when(F.min(F.col(published).isNotNull()).over(whole), "published").otherwise("arrival"))
    dated = F.when(F.col("ordering") == "published", F.col(published))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(source).orderBy(dated.desc(), seq)))


def top_k(df: DataFrame, k: int, score: str, seq: str) -> DataFrame:
    """The ``k`` best rows by score, earlier ones first on ties."""
    return df.orderBy(F.desc(score), seq).limit(k)
