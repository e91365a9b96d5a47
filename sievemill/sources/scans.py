"""Ordered scans of whole tables with a row's place, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.signals import json_list


def numbered(df: DataFrame, order: list[Column], path: str, tasks: int | None = None) -> DataFrame:
    """``df`` with ``place``, from 1, in ``order``; the table is written below ``path`` and read from there.

    Rows are dealt by ranges of ``order`` and sorted within them; the places of a range begin where those
    before it end, told by one number per range. ``order`` must tell all rows apart for a place to be
    the same each time; of equal rows any comes first. Many rows of one equal order fall into one
    range, so end the order with an id.
    """
    ranged = df.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order)
    ranged.select("*", F.monotonically_increasing_id().alias("__at")).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()  # one row per range
    starts, total = [], 0
    for r in sizes:
        starts.append((r["__range"], total))
        total += r["n"]
    begin = df.sparkSession.createDataFrame(starts, "__range long, __start long")
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(begin), "__range").select(*df.columns, place.alias("place"))


def scan_newest_first(df: DataFrame, time: str, seq: str, lists: list[str], path: str) -> DataFrame:
    """A stored table newest first, ties by arrival, with its JSON lists decoded; ``place`` tells the order.

    Null, empty and broken lists are empty; rows without a time come last.
    """
    decoded = df.withColumns({c: json_list(F.col(c)) for c in lists})
    return numbered(decoded, [F.desc_nulls_last(time), F.asc(seq)], path)
