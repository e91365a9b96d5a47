"""Streams over several files: alarms by timers, keys used once, recovery, each with a stop in the middle."""

import datetime as dt
import decimal
import random
import time

import pytest
from pyspark.sql import functions as F

from sievemill.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def files(spark, tmp_path, name, batches, schema):
    """A stream that reads one file per batch; ``add`` lets the next files arrive."""
    folder = f"{tmp_path}/{name}"
    spark.createDataFrame([], schema).write.parquet(folder)

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    for rows in batches:
        add(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), add


def take(stream, out, state):
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def alarms_by_hand(rows, wait, watermark):
    out = []
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        start = min(r[1] for r in mine)
        marks = sorted({start} | {r[1] for r in mine if r[2]})
        for mark, until in zip(marks, [*marks[1:], dt.datetime.max], strict=True):
            at = mark + 2 * wait
            while at < until and at <= watermark:
                out.append((key, at))
                at += wait
    return sorted(out)


def test_silent_keys_are_reported_and_a_restart_goes_on(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rng = random.Random(3)
    rows = [("quiet", at(0), True), ("never", at(3), False), *[("steady", at(10 * i), True) for i in range(60)], ("back", at(0), False), ("back", at(95), True), ("back", at(400), None)]
    rows += [(k, at(rng.randint(0, 590)), rng.random() < 0.4) for k in ("x", "y", "z") for _ in range(12)]
    rows.sort(key=lambda r: r[1])
    cuts = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    schema = "source string, ts timestamp, complete boolean"
    stream, add = files(spark, tmp_path, "in", cuts[:2], schema)
    wait = dt.timedelta(minutes=30)
    alarms = lambda: stateful.missing_heartbeats(stream, "source", wait)
    take(alarms(), f"{tmp_path}/out", f"{tmp_path}/state")
    early = spark.read.parquet(f"{tmp_path}/out").count()
    for cut in cuts[2:]:
        add(cut)
    add([(None, at(9000), True), ("steady", None, True)])
    take(alarms(), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("source", "ts").collect()))
    last = max(r[1] for r in rows)
    want = alarms_by_hand(rows, wait, last)
    assert 0 < early < len(want)
    assert [g for g in got if g[1] < last] == [w for w in want if w[1] < last] and set(got) <= set(want)
    assert not [g for g in got if g[0] == "steady"]


def test_rows_out_of_order_within_the_lateness(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("a", at(0), False), ("b", at(70), False)], [("a", at(45), True), ("b", at(75), True)], [("b", at(200), True)], [("b", at(260), True)]]
    stream, _ = files(spark, tmp_path, "in", batches, "source string, ts timestamp, complete boolean")
    take(stateful.missing_heartbeats(stream, "source", dt.timedelta(minutes=30), "60 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("source", "ts").collect()))
    assert [g for g in got if g[0] == "a"] == [("a", at(m)) for m in (105, 135, 165, 195)]
    assert [g for g in got if g[0] == "b"] == [("b", at(m)) for m in (135, 165, 195)]


def test_calls_to_the_store_do_not_grow_with_the_keys(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rng = random.Random(5)
    batches = [[(f"k{n}", at(d * 600 + rng.randint(1, 599)), rng.random() < 0.3) for n in range(1500 + 200 * d) for _ in range(1 + n % 2)] + [("last", at(d * 600 + 600), True)] for d in range(3)]
    schema, wait = "source string, ts timestamp, complete boolean", dt.timedelta(minutes=120)
    stream, add = files(spark, tmp_path, "in", batches[:1], schema)
    told = []
    for batch in [None, *batches[1:]]:
        if batch:
            add(batch)
        query = stateful.missing_heartbeats(stream, "source", wait).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        told += [p["stateOperators"][0] for p in query.recentProgress]
    assert 500 < max(x["numRowsTotal"] for x in told) <= 1024
    assert all(x["customMetrics"]["numRegisteredTimers"] <= 1024 for x in told)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("source", "ts").collect()))
    assert got == alarms_by_hand([r for batch in batches for r in batch], wait, at(1800)) != []


@pytest.mark.parametrize("groups", [1, 5])
def test_keys_of_a_group_have_clocks_of_their_own(spark, tmp_path, groups):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rng = random.Random(groups)
    rows = sorted(((f"k{n}", at(rng.randint(20 * n, 900)), rng.random() < 0.5) for n in range(30) for _ in range(9)), key=lambda r: r[1])
    # Rows come up to 40 minutes late, within the lateness.
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randint(0, 40)))
    stream, add = files(spark, tmp_path, "in", [late[:60], late[60:130]], "source string, ts timestamp, complete boolean")
    wait = dt.timedelta(minutes=30)
    alarms = lambda: stateful.missing_heartbeats(stream, "source", wait, "40 minutes", groups=groups)
    take(alarms(), f"{tmp_path}/out", f"{tmp_path}/state")
    for part in (late[130:], [("end", at(1000), True)]):
        add(part)
        take(alarms(), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("source", "ts").collect()))
    assert got == alarms_by_hand(rows, wait, at(960)) != []


@pytest.mark.parametrize(
    ("kind", "keys"),
    [
        ("int", [3, -4]), ("timestamp", [T0, T0 + dt.timedelta(microseconds=1)]), ("decimal(38,6)", [decimal.Decimal("12345678901234567890123456789012.345678"), decimal.Decimal("0.100000")]),
        ("binary", [b"\x00\xff", b""]), ("struct<a:string,b:timestamp>", [("x", T0 + dt.timedelta(microseconds=7)), (None, None)]),
    ],
)
def test_keys_of_any_type(spark, tmp_path, kind, keys):
    rows = [(key, T0 + dt.timedelta(minutes=n), False) for n, key in enumerate(keys)]
    stream, _ = files(spark, tmp_path, "in", [rows, [(keys[0], T0 + dt.timedelta(minutes=90), True)]], f"source {kind}, ts timestamp, complete boolean")
    alarms = stateful.missing_heartbeats(stream, "source", dt.timedelta(minutes=40), groups=1)
    assert alarms.schema["source"].dataType.simpleString() == kind
    take(alarms, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want = [(keys[0], T0 + dt.timedelta(minutes=80)), (keys[1], T0 + dt.timedelta(minutes=81))]
    plain = {tuple: tuple, bytearray: bytes}
    assert sorted((repr(next((f(r.source) for t, f in plain.items() if isinstance(r.source, t)), r.source)), r.ts) for r in got) == sorted((repr(k), t) for k, t in want)


def test_processing_time_needs_no_further_rows(spark, tmp_path):
    stream, _ = files(spark, tmp_path, "in", [[("a", T0, True)]], "source string, ts timestamp, complete boolean")
    alarms = stateful.missing_heartbeats(stream, "source", dt.timedelta(seconds=1), clock="processing")
    query = alarms.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("silent").count() < 2:
            time.sleep(1)
        found = sorted(r.ts for r in spark.table("silent").collect())
    finally:
        query.stop()
    assert len(found) >= 2 and found[1] - found[0] == dt.timedelta(seconds=1)


LISTINGS = "source string, id string, n long, outcome string"
TERMINAL = ["seen", "sent", "delivery_failed", "discarded_location", "discarded_time_window"]


def outcomes_by_hand(batches):
    used, out = set(), []
    for rows in batches:
        for source, id_, n, outcome in sorted(rows, key=lambda r: r[2]):
            if outcome != "discarded_time_window" and (source, id_) in used:
                outcome = "seen"
            elif outcome == "sent":
                used.add((source, id_))
            out.append((n, outcome))
    return sorted(out)


def test_a_key_is_used_once_over_files_and_restarts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice(["s", "t", None]), rng.choice(["1", "2", "3", "4", None]), n, rng.choice(TERMINAL[1:])) for n in range(90)] + [("s", "hot", n, "sent") for n in range(90, 200)]
    rng.shuffle(rows)
    batches = [rows[:60], rows[60:110], rows[110:]]
    stream, add = files(spark, tmp_path, "in", batches[:2], LISTINGS)
    run = lambda: stateful.listings_once(stream, ["source", "id"], "n", TERMINAL, f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    add(batches[2])
    run()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/outcomes").select("n", "outcome").collect()))
    assert got == outcomes_by_hand(batches)
    ledger = spark.read.parquet(f"{tmp_path}/out/ledger")
    assert ledger.agg(F.sum("detected")).first()[0] == 200 and ledger.where("NOT complete").isEmpty()


def test_used_keys_are_forgotten(spark, tmp_path):
    schema = LISTINGS + ", at timestamp"
    day = lambda d: T0 + dt.timedelta(days=d)
    batches = [[("s", "1", 1, "sent", day(0)), ("s", "2", 2, "sent", day(3))], [("s", "1", 3, "sent", day(6)), ("s", "9", 4, "sent", day(8))], [("s", "1", 5, "sent", day(9)), ("s", "2", 6, "sent", day(9))]]
    stream, add = files(spark, tmp_path, "in", batches[:2], schema)
    run = lambda: stateful.listings_once(stream, ["source", "id"], "n", TERMINAL, f"{tmp_path}/out", f"{tmp_path}/state", time="at", ttl="7 days")
    run()
    add(batches[2])
    run()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/outcomes").select("n", "outcome").collect()))
    assert got == [(1, "sent"), (2, "sent"), (3, "seen"), (4, "sent"), (5, "sent"), (6, "seen")]


def test_append_unseen_reads_no_earlier_batch(spark, tmp_path):
    stream, add = files(spark, tmp_path, "in", [[("s", "1", 5, "x"), ("s", "1", 4, "y")], [("s", "1", 1, "z"), ("t", None, 2, "x")]], LISTINGS)
    run = lambda: stateful.append_unseen(stream, f"{tmp_path}/out", f"{tmp_path}/state", ["source", "id"], "n")
    run()
    add([("t", None, 3, "x"), ("t", "2", 6, "x")])
    run()
    got = spark.read.option("recursiveFileLookup", "true").schema(LISTINGS).parquet(f"{tmp_path}/out").collect()
    assert sorted(r.n for r in got) == [2, 4, 6]


@pytest.mark.parametrize("anew", [False, True])
def test_recovery_outlives_a_stop(spark, tmp_path, anew):
    schema = "source string, run long, id long, young boolean, whole boolean"
    batches = [
        [("a", 1, 1, True, False), ("a", 1, 2, False, False), ("b", 1, 3, False, False), ("c", 1, 4, None, True)],
        [("a", 2, 5, False, True), ("a", 2, 6, True, True), ("a", 3, 7, False, False), ("b", 2, 8, False, False), ("c", 2, 9, False, False)],
        [("a", 4, 10, False, False), ("b", 3, 11, True, False), ("b", 3, 12, False, False), (None, 1, 13, True, False), (None, None, 14, False, False)],
    ]
    stream, add = files(spark, tmp_path, "in", batches[:2], schema)
    run = lambda again: stateful.recovered(stream, "source", "run", F.col("young"), F.col("whole"), f"{tmp_path}/out", f"{tmp_path}/state", anew=again)
    run(False)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == [1, 6, 7, 9]
    add(batches[2])
    run(anew)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == [1, 6, 7, 9] + ([] if anew else [10]) + [11, 13]
