"""Operators without a query of their own, each on a few rows."""

import datetime as dt

from pyspark.sql import functions as F

from sievemill.functions import gates, text
from sievemill.operators import aggregates, coverage, inventory, joins, tables, windows
from sievemill.streaming import streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_cycle_metrics_and_newest_rows(spark):
    stats = spark.createDataFrame([("c1", "b", 3, -2), ("c1", "a", None, 1), ("c2", "a", 5, 0)], "cycle string, provider string, detected int, sent int")
    got = {r.cycle: {k: tuple(v) for k, v in r.providers.items()} for r in tables.build_cycle_metric(stats, "cycle", "provider", ["detected", "sent"]).collect()}
    assert got == {"c1": {"a": (0, 1), "b": (3, 0)}, "c2": {"a": (5, 0)}}
    assert rows(tables.keep_last_n(spark.range(9), 2, ["id"])) == [(7,), (8,)] and tables.keep_last_n(spark.range(0), 2, ["id"]).count() == 0
    best = spark.createDataFrame([(1, "a", 3), (2, "a", 3), (3, "a", 9), (4, "b", None)], "seq int, g string, score int")
    assert rows(tables.first_n_per_group(best, 1, ["g"], [F.desc("score"), F.asc("seq")]), "seq") == [(3,), (4,)] and rows(windows.top_k(best, 2, "score", "seq"), "seq") == [(1,), (3,)]


def test_terms_of_the_user_and_eligible_rows(spark):
    df = spark.createDataFrame([([" Data  Science", "data science", "", None, "Job"],), ([],)], "w array<string>")
    got = [r.p for r in df.select(text.partition_terms(F.col("w"), ["job"]).alias("p")).collect()]
    assert [(p.active, p.broad) for p in got] == [(["data science"], ["job"]), ([], [])]
    df = spark.createDataFrame([("accepted", "accepted", None), ("outside", "accepted", None), ("not_applicable", "rejected", None), ("not_applicable", "warning", "include"), ("not_applicable", "warning", None)], "state string, status string, reason string")
    assert [r.e for r in df.select(gates.eligible(F.col("state"), F.struct("status"), F.col("reason")).alias("e")).collect()] == [True, False, False, False, True]


def test_stored_decisions_outcomes_and_searches(spark):
    now = dt.datetime(2024, 1, 10)
    jobs = spark.createDataFrame([("s", "1", "f1", "new"), ("s", "2", "f2", "new"), ("s", "3", "f3", "new")], "source string, job_id string, fingerprint string, decision string")
    cache = spark.createDataFrame([("s", "1", "f1", "old", now), ("s", "2", "other", "old", now), ("s", "3", "f3", "old", dt.datetime(2024, 1, 1))], "source string, job_id string, fingerprint string, decision string, ts timestamp")
    assert rows(joins.decision_with_cache(jobs, cache, "2024-01-10 00:00:00"), "job_id", "decision") == [("1", "old"), ("2", "new"), ("3", "new")]
    metrics, ledger = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "seen", 1), ("a", "sent", 2)], "key string, outcome string, seq int")
    assert rows(joins.attach_outcome(metrics, ledger)) == [("a", "sent"), ("b", "None")]
    searches = spark.createDataFrame([("https://x/?q=1",), ("https://x/?q=1",)], "url string")
    assert rows(joins.expand_searches(searches, [900, -1, 900, 60])) == [("https://x/?q=1&f_TPR=r60",), ("https://x/?q=1&f_TPR=r900",)] and rows(joins.expand_searches(searches, [0])) == [("https://x/?q=1",)]


def test_snapshots_last_good_and_order(spark):
    assert rows(coverage.validation_snapshot(spark.createDataFrame([("ok",), (" ",), (None,), ("ok ",)], "status string"))) == [("ok", 2), ("unknown", 2)]
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False)], "k string, t int, ok boolean")
    assert rows(windows.last_good(df, "k", "t", "ok"), "k", "t", "last_ok") == [("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("b", 1, None)]
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", None, 1), ("b", "2024-01-09", 2)], "s string, p string, seq int")
    assert rows(windows.order_if_all_dated(df, "s", "p", "seq"), "s", "seq", "position", "ordering") == [("a", 1, 2, "published"), ("a", 2, 1, "published"), ("b", 1, 1, "arrival"), ("b", 2, 2, "arrival")]


def test_a_provider_without_ledger_is_not_empty(spark):
    t = dt.datetime(2024, 1, 1)
    cycles = spark.createDataFrame([("a", t, 7), ("b", t, 2), ("b", t + dt.timedelta(hours=1), 3)], "provider string, ts timestamp, detected int")
    closed = spark.createDataFrame([("b", t), ("c", None)], "provider string, closed_ts timestamp")
    assert rows(coverage.expected_detected(cycles, closed)) == [("a", 7), ("b", 2)]
    batches = spark.createDataFrame([], "provider string, ts timestamp, detected int, terminal int, unaccounted int, complete boolean, outcomes map<string, int>, jobs array<struct<key: string, outcome: string>>")
    report = coverage.coverage_report(cycles, batches, cycles.select("provider").distinct(), ["detected"], ["sent"], "2024-01-01 01:10:00", 2, 3600)
    assert {(r.provider, r.expected, r.reconciliation) for r in report.where("provider = 'a'").collect()} == {("a", 7, "insufficient_data")}
    runs = spark.createDataFrame([("scheduler", t + dt.timedelta(hours=2)), (" linkedin_dual ", t + dt.timedelta(hours=1)), ("manual", t)], "origin string, ts timestamp")
    assert coverage.ledger_started_at(runs, ["scheduler", "linkedin_dual"]).first().started == t + dt.timedelta(hours=1)


def test_a_run_is_accepted_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    for n, batch in enumerate([[("r1", t), ("r2", t)], [("r1", t + dt.timedelta(minutes=5)), ("r3", t)]]):
        spark.createDataFrame(batch, "run_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("run_id string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    streams.dedup_runs(stream, "ts", "run_id", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "run_id") == [("r1",), ("r2",), ("r3",)]


def test_runs_that_a_ledger_stands_for(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    runs = spark.createDataFrame([("r1", t(1)), ("r2", t(2)), (None, t(3)), ("r4", t(9))], "run_id string, ts timestamp")
    batches = spark.createDataFrame([(" r1 ", t(5)), (None, t(3))], "run_id string, ts timestamp")
    assert rows(joins.runs_for_ledger(batches, runs), "run_id") == [("r1",), ("r4",), (None,)]
    assert rows(joins.runs_for_ledger(batches.where("run_id IS NOT NULL"), runs), "run_id") == [("r1",)] and joins.runs_for_ledger(batches.limit(0), runs).count() == 0


def test_cards_merged_over_searches(spark):
    cards = [("r", "k", 1, "-", "A", "", "u1", None, False, ["x", "y"]), ("r", "k", 2, "Title", None, "Town", "", "long text", None, ["y", "z"]), ("r", "k", 3, "", "B", "-", "u3", "text", True, None), (None, "k", 4, "T", "C", "L", "u", "d", False, None), ("r", "other", 5, "T", "C", "L", "u", "d", False, [])]
    df = spark.createDataFrame(cards, "run_id string, key string, seq int, title string, company string, location string, url string, description string, is_fresh boolean, aliases array<string>")
    got = {(r.run_id, r.key): (r.title, r.company, r.location, r.url, r.description, r.is_fresh, r.aliases) for r in inventory.channel_cards(df, ["-"]).collect()}
    assert got == {("r", "k"): ("Title", "B", "Town", "u3", "long text", True, ["x", "y", "z"]), (None, "k"): ("T", "C", "L", "u", "d", False, []), ("r", "other"): ("T", "C", "L", "u", "d", False, [])}
    many = spark.range(3000).selectExpr("1 AS key", "id AS seq", "'t' AS title", "'c' AS company", "'l' AS location", "'u' AS url", "'d' AS description", "false AS is_fresh", "array(CAST(id % 3 AS STRING)) AS aliases")
    assert aggregates.merge_duplicates(many, "key", "seq", []).first().aliases == ["0", "1", "2"]
