"""Streams with keyed state of their own: alarms by timers, outcomes told once, recovery after a start.

The keyed operators run on ``transformWithState``, whose state lies in RocksDB and in the checkpoint, so
a query that starts again goes on where it stopped. ``rocksdb`` sets the store for a session.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sievemill.operators.tables import build_ledger_batches, dedupe_first

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> SparkSession:
    """Keep the state of this session's streams in RocksDB, with changes instead of whole copies in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


class Heartbeats(StatefulProcessor):
    """Alarms of a group of keys: (key, ms) two intervals after a key's last complete run, and every interval from then on.

    State: for each key the mark its alarms count from (its first row, or the last complete run that
    the clock has passed), the next alarm due, and complete runs that the clock hasn't passed yet. An
    alarm is due by a timer; when it fires the complete runs up to its time are known, whatever order
    they arrived in. A group has one value and one timer, at its first alarm due: each call to the
    store takes as long as many rows, so calls must not grow with the keys.
    """

    def __init__(self, interval: timedelta, event_time: bool, kind: str) -> None:
        self.wait, self.event_time, self.kind = round(interval.total_seconds() * 1000), event_time, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clocks = handle.getValueState("clocks", f"keys array<{self.kind}>, marks array<long>, dues array<long>, runs array<array<long>>")

    def _load(self) -> dict:
        state = self.clocks.get()
        return {} if state is None else {key: (mark, due, runs) for key, mark, due, runs in zip(*state, strict=True)}

    def _keep(self, clocks: dict, timer: int | None) -> None:
        self.clocks.update((list(clocks), *map(list, zip(*clocks.values(), strict=True))))
        first = min(due for _, due, _ in clocks.values())
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = None if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        clocks = self._load()
        timer = min((due for _, due, _ in clocks.values()), default=None)
        starts, complete = {}, {}
        for frame in rows:
            for source, ms, whole in zip(frame["key"].tolist(), frame["ms"].tolist(), frame["complete"].tolist(), strict=True):
                at = ms if now is None else now
                if source not in clocks:
                    starts[source] = min(at, starts.get(source, at))
                if whole:
                    complete.setdefault(source, set()).add(at)
        clocks |= {source: (at, at + 2 * self.wait, []) for source, at in starts.items()}
        for source, times in complete.items():
            # Of the runs up to the next alarm only the last matters; later ones wait for their turn.
            mark, due, waiting = clocks[source]
            times.update(waiting)
            early = max((t for t in times if t <= due), default=None)
            clocks[source] = (mark, due, ([] if early is None else [early]) + sorted(t for t in times if t > due))
        if starts or complete:
            self._keep(clocks, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        until = max(now, expiredTimerInfo.getExpiryTimeInMs())
        clocks, keys, alarms = self._load(), [], []
        for source, (mark, due, runs) in clocks.items():
            # The clock may have passed several alarms at once; runs are in order.
            passed = 0
            while due <= until:
                passed = bisect_right(runs, due, passed)
                last = runs[passed - 1] if passed else mark
                if last > mark:
                    mark, due = last, max(last + 2 * self.wait, due + 1)
                else:
                    keys.append(source)
                    alarms.append(due)
                    due += self.wait
            clocks[source] = (mark, due, runs[passed:])
        self._keep(clocks, None)
        if alarms:
            yield pd.DataFrame({"key": keys, "ms": alarms})

    def close(self) -> None:
        pass


#: Keys of these types are kept as they are, others as JSON.
_PLAIN = ("string", "bigint", "int", "smallint", "tinyint", "boolean")
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def missing_heartbeats(runs: DataFrame, key: str, interval: timedelta, lateness: str = "0 seconds", clock: str = "event", groups: int = 1024) -> DataFrame:
    """(key, ts) whenever a key has had no complete run for two intervals, and once per interval until it has.

    ``runs`` is a stream of (key, ts, complete). The first row of a key starts its clock; a complete
    run starts it anew. With ``clock`` "event" the watermark of ``ts`` (``lateness`` behind) is the
    time, so alarms of a silent key come as soon as others move on; with "processing" it is the time
    of day, so they come even if nothing arrives at all. Rows without a key or time are left out;
    a null ``complete`` counts as false.

    Keys are dealt into ``groups`` by a hash. A group's clocks are one value of the state, read and
    written whole when a row or an alarm of it comes, so more groups suit many millions of keys; a
    checkpoint holds for one number of groups.
    """
    rocksdb(runs.sparkSession)
    kind = runs.schema[key].dataType.simpleString()
    plain = kind in _PLAIN
    named = F.col(key) if plain else F.to_json(F.struct(F.col(key).alias("key")), _JSON)
    rows = runs.where(F.col(key).isNotNull()).select(named.alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.coalesce("complete", F.lit(False)).alias("complete")).where("ts IS NOT NULL")
    event = clock == "event"
    if event:
        rows = rows.withWatermark("ts", lateness)
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"), "key", "ts", "ms", "complete")
    kept = kind if plain else "string"
    alarms = rows.groupBy("group").transformWithStateInPandas(Heartbeats(interval, event, kept), f"key {kept}, ms long", "Append", "EventTime" if event else "ProcessingTime")
    back = F.col("key") if plain else F.from_json("key", f"key {kind}", _JSON)["key"]
    return alarms.select(back.alias(key), F.timestamp_millis("ms").alias("ts"))


class Uses(StatefulProcessor):
    """The rows of one key, each with whether an earlier batch has used the key; rows pass one by one."""

    def __init__(self, columns: list[str], time: str | None) -> None:
        self.columns, self.time = [*columns, "used"], time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "ts long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, first = self.used.exists(), None
        row_of = Row(*self.columns)
        for row in rows:
            if row.uses and not before:
                at = 0 if self.time is None else round(row[self.time].timestamp() * 1000)
                first = at if first is None else min(first, at)
            yield row_of(*row, before)
        if first is not None:
            self.used.update((first,))
            if self.time is not None:
                self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def key_uses(stream: DataFrame, key: list[str], uses: Column, time: str | None = None, ttl: str | None = None) -> DataFrame:
    """``stream`` with ``uses`` (whether a row uses its key up) and ``used`` (whether an earlier batch did).

    The state is one value per used key. With ``ttl`` a key is forgotten once a row has come whose
    ``time`` is that much later than the key's use; rows further behind than ``ttl`` are then too late
    and left out, as are rows without a time. Without it no key is forgotten. Nulls in a key are a
    value like others. ``first_uses`` settles what happens within a batch.
    """
    rocksdb(stream.sparkSession)
    rows = stream.withColumn("uses", F.coalesce(uses, F.lit(False)))
    if ttl is not None:
        rows = rows.where(F.col(time).isNotNull()).withWatermark(time, ttl)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", used boolean"
    return rows.groupBy(*key).transformWithState(Uses(rows.columns, None if ttl is None else time), kinds, "Append", "None" if ttl is None else "EventTime")


def first_uses(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """A batch of ``key_uses``, with ``used`` also true for rows that come after a use within the batch.

    ``order`` tells rows of a key apart; of rows with the same one all count as first.
    """
    firsts = batch.where("uses").groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min(order).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    rows = batch.join(firsts, same, "left")
    return rows.select(*[c for c in batch.columns if c not in ("uses", "used")], (F.col("used") | F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).alias("used"))


def append_unseen(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> None:
    """Take what has arrived and append the first row of each new key to the table at ``path``.

    Which keys are known is the state of the checkpoint, so no earlier batch is read again. Each batch
    is one folder named by its number, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        dedupe_first(batch.where("NOT used").drop("uses", "used"), key, order).write.mode("overwrite").parquet(f"{path}/batch-{number}")

    marked = key_uses(stream, key, F.lit(True))
    marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def listings_once(
    stream: DataFrame, key: list[str], order: str, terminal: list[str], path: str, checkpoint: str, keeps: tuple[str, ...] = ("sent",), skips: tuple[str, ...] = ("discarded_time_window", "unverified_time_window"), time: str | None = None, ttl: str | None = None
) -> None:
    """Take what has arrived: one outcome per row below ``path``/outcomes, the ledger below ``path``/ledger.

    ``stream`` has source, ``outcome`` (what becomes of a row if its key is new), and the columns of
    ``key`` and ``order``. The first row with an outcome of ``keeps`` uses its key up, by batches and
    by ``order`` within one; later rows of the key are "seen". Other outcomes leave the key open, as a
    failed delivery does. Outcomes of ``skips`` are told before anyone asks for the key. Used keys
    are forgotten ``ttl`` after by ``time``, as in ``key_uses`` (None: never).

    A batch is one folder named by its number; one that runs again replaces itself, and the state is
    that of the checkpoint, so no key is used twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        told = first_uses(batch, key, order)
        outcome = F.when(F.col("used") & ~F.coalesce(F.col("outcome").isin(*skips), F.lit(False)), "seen").otherwise(F.col("outcome"))
        told.withColumn("outcome", outcome).drop("used").write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
        rows = batch.sparkSession.read.schema(stream.schema).parquet(f"{path}/outcomes/batch={number}")
        ledger = build_ledger_batches(rows.withColumn("key", F.concat_ws("|", *key)), terminal)
        ledger.write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    marked = key_uses(stream, key, F.col("outcome").isin(*keeps), time, ttl)
    marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def recovered(stream: DataFrame, source: str, run: str, recent: Column, complete: Column, path: str, checkpoint: str, anew: bool = False) -> None:
    """Take what has arrived: below ``path``/rows what passes while each source recovers from its start.

    A source is pending until one of its runs (in the order of ``run``) holds a row for which
    ``complete`` is true. Up to and including that run only its ``recent`` rows pass, afterwards all.
    The sources that are done are a table below ``path``/done, one folder per batch with the whole
    list: a batch reads its predecessor's, so a query that stops goes on where it was and a batch
    that runs again does the same again. ``anew`` puts every source back to pending with the first
    batch of this start. Rows without a source are a source like others; one without a run counts
    as before the end.
    """
    spark = stream.sparkSession
    schema, started = stream.select(source).schema, []

    def write(batch: DataFrame, number: int) -> None:
        started.append(number)
        fresh = number == 0 or (anew and number == started[0])
        before = spark.createDataFrame([], schema) if fresh else spark.read.schema(schema).parquet(f"{path}/done/batch={number - 1}")
        ends = batch.where(complete).groupBy(F.col(source).alias("__ending")).agg(F.min(run).alias("__end"))
        known = before.select(F.col(source).alias("__known"), F.lit(True).alias("__done"))
        rows = batch.join(known, F.col(source).eqNullSafe(F.col("__known")), "left").join(ends, F.col(source).eqNullSafe(F.col("__ending")), "left")
        passes = F.coalesce("__done", F.lit(False)) | F.coalesce(F.col(run) > F.col("__end"), F.lit(False)) | F.coalesce(recent, F.lit(False))
        rows.where(passes).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        before.union(ends.select(F.col("__ending").alias(source))).distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/done/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
