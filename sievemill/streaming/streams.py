"""Structured Streaming with built-in operators; ``stateful`` has those with state of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievemill.operators.tables import build_ledger_batches


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern, as the path itself of a stream must be a folder; it means this one name only.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def cycle_windows(events: DataFrame, time: str, by: str, size: str, slide: str | None = None) -> DataFrame:
    """Rows per ``by`` and window; works on streams and tables alike."""
    return events.groupBy(F.window(time, size, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def dedup_runs(runs: DataFrame, time: str, run_id: str, within: str) -> DataFrame:
    """Each run once, as long as its repeats come within the watermark; state is bounded by time."""
    return runs.withWatermark(time, within).dropDuplicatesWithinWatermark([run_id])


def windows_kept(events: DataFrame, time: str, by: str, size: str, late: str, path: str, checkpoint: str) -> None:
    """``cycle_windows`` of a stream as a table of updates below ``path``, by batch.

    Windows leave the state once they are ``late`` behind; of a window's updates the largest count
    is the last. ``latest_windows`` reads them.
    """
    counts = cycle_windows(events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), time, by, size)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_windows(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The windows that ``windows_kept`` has written, each with its last count."""
    return spark.read.parquet(path).groupBy("start", by).agg(F.max("n").alias("n"))


def seen_with_ttl(stream: DataFrame, time: str, key: list[str], ttl: str) -> DataFrame:
    """The first row of each key; a key is forgotten ``ttl`` after it was seen, and then new again."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark(key)


def late_or_pending(batches: DataFrame, cycles: DataFrame, by: str, delay: str) -> DataFrame:
    """Stream of batches with the cycles that close them within ``delay``; ``cycle_ts`` is null while none does.

    Both sides have ``ts``. A batch without a cycle comes out once the watermark has passed its
    delay, so none is lost; several closing cycles give several rows, of which the first counts.
    """
    left = batches.withWatermark("ts", delay).alias("b")
    right = cycles.select(F.col(by).alias("__by"), F.col("ts").alias("cycle_ts")).withWatermark("cycle_ts", delay)
    inside = F.expr(f"b.{by} = __by AND cycle_ts >= b.ts AND cycle_ts <= b.ts + INTERVAL {delay}")
    return left.join(right, inside, "left_outer").drop("__by")


def missing_heartbeats(runs: DataFrame, key: str, interval_seconds: int) -> DataFrame:
    """(key, ts) whenever a run finds no complete one in the last two intervals; ``stateful`` has alarms by timers.

    ``runs`` is a stream of (key, ts, complete) in order of time. The first run starts the clock, a
    complete one sets it back, and an alarm isn't repeated within an interval.
    """
    wait = pd.Timedelta(seconds=interval_seconds)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, issued = (pd.Timestamp(x) if x is not None else None for x in (state.get if state.exists else (None, None)))
        out = []
        for row in pd.concat(frames).sort_values("ts", kind="stable").itertuples():
            if last is None or row.complete:
                last, issued = row.ts, None
            elif row.ts - last >= 2 * wait and (issued is None or row.ts - issued >= wait):
                issued = row.ts
                out.append(row.ts)
        state.update((last.to_pydatetime(), issued.to_pydatetime() if issued is not None else None))
        yield pd.DataFrame({key: [name[0]] * len(out), "ts": pd.Series(out, dtype="datetime64[ns]")})

    kind = runs.schema[key].dataType.simpleString()
    return runs.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp", "last timestamp, issued timestamp", "append", GroupStateTimeout.NoTimeout)


def recovery_backfill(batch: DataFrame, recent: Column, complete: Column, pending: bool) -> tuple[DataFrame, bool]:
    """(rows to take, whether recovery goes on): while it is pending only recent rows pass.

    Recovery ends with the batch that brings a complete run.
    """
    if not pending:
        return batch, False
    return batch.where(recent), batch.where(complete).isEmpty()


def listing_cycles(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], terminal: list[str], path: str, checkpoint: str) -> None:
    """Each batch of listings as a cycle: ``decide`` gives (source, key, outcome), the ledger is written.

    ``decide`` cleans, classifies and filters with the operators for tables. A batch is one folder
    named by its number, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        build_ledger_batches(decide(batch), terminal).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
