"""Cycles of listings: one outcome for every row, with the cycle's limit of notifications, and all counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The counters of a cycle, in their order.
COUNTERS = (
    "detected", "eligible", "discarded_time_window", "unverified_time_window", "discarded_location", "discarded_include", "discarded_exclude", "discarded_relevance", "relevance_warning", "description_unavailable",
    "discarded_description_unavailable", "duplicate_channels", "seen", "paused", "notification_limit", "alerts_disabled", "delivery_failed", "saved", "sent",
)


def cycle_outcomes(df: DataFrame, cycle: str, order: str, send_alerts: Column, paused: Column, first_cycle: Column, most: int) -> DataFrame:
    """Add ``outcome``, ``eligible``, ``saved`` and ``warned``: exactly one outcome per row, the first that applies.

    Time window, seen, relevance, reason, alerts switched off, paused, limit, then sent or failed. In a
    cycle rows are told in ``order``; once ``most`` are sent (0: no limit) what would be tried next is
    over the limit. In a first cycle fresh rows are told even with alerts off, and those that aren't are
    saved. Reads recency (a state), is_seen, decision, reason, is_fresh and delivered; null flags are
    false, a null recency isn't bound to a window. ``order`` tells the rows of a cycle apart.

    The limit takes the first ``most`` delivered rows of each cycle, a bounded list; no cycle is sorted
    as a whole.
    """
    flag = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    # Told once per row: decisions are large expressions, which the optimizer would copy into every use.
    given = [*[F.col(c) for c in df.columns if c != "decision"], F.col("decision.status").alias("__status"), F.col("decision.family").alias("__family"), F.col("decision")]
    rows = df.select(F.explode(F.array(F.struct(*given))).alias("__row")).select("__row.*")
    state = F.coalesce("recency", F.lit("not_applicable"))
    before = F.when(state == "outside", "discarded_time_window").when(state == "unverified", "unverified_time_window").when(flag("is_seen"), "seen")
    judged = before.when(F.col("__status") == "rejected", F.concat(F.lit("discarded_relevance:"), F.col("__family"))).when(F.col("reason").isNotNull(), F.concat(F.lit("discarded_"), "reason"))
    told = flag(send_alerts) | (flag(first_cycle) & flag("is_fresh"))
    rows = rows.withColumn("__dropped", judged).withColumn("eligible", F.col("__dropped").isNull()).withColumn("warned", before.isNull() & flag(F.col("__status") == "warning"))
    rows = rows.withColumn("__held", F.when(F.col("eligible") & ~told, "alerts_disabled").when(F.col("eligible") & flag(paused), "paused"))
    trying = F.col("eligible") & F.col("__held").isNull()
    limited = F.lit(False)
    if most > 0:
        firsts = rows.where(trying & flag("delivered")).select(F.col(cycle).alias("__cycle"), F.col(order).alias("__order"))
        firsts = firsts.withColumn("place", F.row_number().over(Window.partitionBy("__cycle").orderBy("__order"))).where(F.col("place") <= most)
        ends = firsts.where(F.col("place") == most).select("__cycle", F.col("__order").alias("__end"))
        rows = rows.join(ends, F.col(cycle).eqNullSafe(F.col("__cycle")), "left")
        limited = flag(F.col(order) > F.col("__end"))
    outcome = F.coalesce("__dropped", "__held", F.when(limited, "notification_limit").when(flag("delivered"), "sent").otherwise("delivery_failed"))
    rows = rows.withColumn("outcome", outcome)
    saved = (F.col("outcome") == "sent") | ((F.col("outcome") == "alerts_disabled") & flag(first_cycle))
    return rows.withColumn("saved", saved).select(*[c for c in df.columns if c not in ("outcome", "eligible", "saved", "warned")], "outcome", "eligible", "saved", "warned")


def cycle_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """All ``COUNTERS`` per ``by`` of what ``cycle_outcomes`` gives.

    ``undescribed`` (a description was wanted and not found) and ``duplicates`` (those a channel's union
    took out, as a number of the row) are counted where there are such columns. A missing description
    never drops a row, so its drop counter stays 0.
    """
    count = {n: F.count_if(F.col("outcome") == n) for n in COUNTERS}
    count |= {"detected": F.count("*"), "eligible": F.count_if("eligible"), "saved": F.count_if("saved"), "relevance_warning": F.count_if("warned"), "discarded_relevance": F.count_if(F.col("outcome").startswith("discarded_relevance:")), "discarded_description_unavailable": F.lit(0).cast("long")}
    count["description_unavailable"] = F.count_if(F.coalesce("undescribed", F.lit(False))) if "undescribed" in rows.columns else F.lit(0).cast("long")
    count["duplicate_channels"] = F.coalesce(F.sum(F.greatest(F.coalesce("duplicates", F.lit(0)), F.lit(0))), F.lit(0)).cast("long") if "duplicates" in rows.columns else F.lit(0).cast("long")
    return rows.groupBy(*by).agg(*[count[n].alias(n) for n in COUNTERS])
