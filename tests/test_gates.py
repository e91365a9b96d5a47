"""Gates, catalogs, coverage reasons, page sources and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from sievemill.functions import catalogs, times
from sievemill.operators import coverage, joins, relevance
from sievemill.sources import pages
from sievemill.streaming import streams


def test_ages_in_all_units(spark):
    said = {"12 minutes ago": 720, "hace 3 h": 10800, "5 m": 300, "2 semanas": 1209600, "1 week": 604800, "4 meses": None, "ahora": 0, "soon": None, "hace 10 horas": 36000, None: None}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", times.relative_age_seconds(F.col("t")).alias("a")).collect()
    assert {r.t: r.a for r in rows} == said


def test_negated_and_weak_terms_weigh_less(spark):
    texts = ["usamos spark", "no requerimos spark", "valorable spark", "no requerimos spark, pero spark a diario y mucho mas de lo que parece al principio; usamos spark"]
    df = spark.createDataFrame([("Data Engineer", None, "x", t) for t in texts], "title string, company string, source string, description string")
    # The title's own term gives 4; the text's term 4, 0, 1 or the best of all its hits.
    assert [r.score for r in relevance.classify_relevance(df).select("decision.score").collect()] == [82, 78, 79, 82]


def test_leads_are_dropped_by_level(spark):
    df = spark.createDataFrame([("Dev", "Lead / Principal"), ("Dev", "Mid")], "title string, level string").selectExpr("*", "'' company", "'' location", "'' description", "'x' source")
    assert [r.r for r in df.select(relevance.filter_reason(df, F.lit(True), [], []).alias("r")).collect()] == ["exclude", None]


def test_published_times_are_evidence(spark):
    d = spark.range(1).select(relevance.recency_decision(F.array(F.lit("https://x?f_TPR=R3600")), F.array(F.lit("nothing")), F.lit("2024-01-01 12:00:00"), F.lit(True), F.array(F.lit("2024-01-01T11:30:00Z"), F.lit("2024-01-01"))).alias("d")).first().d
    assert (d.state, d.age_seconds, d.allowed_seconds) == ("accepted", 1800, 3600)


def test_catalogs_and_features(spark):
    df = spark.createDataFrame([("Dev", "Buenas prácticas con C++ y node.js; jornada completa, english", "Remoto"), ("Prácticas", "mail me@node.js.org about c++x", None), (None, None, None)], "title string, description string, location string")
    got = [r.features for r in catalogs.listing_features(df, ["Valencia"]).collect()]
    assert [f.contract_types for f in got] == [[], ["Practicas / Beca"], []]
    assert [f.stack for f in got] == [["C++", "Node.js"], [], []] and got[0].languages == ["Ingles"] and got[0].work_schedules == ["Jornada completa"]
    for patterns in [p for c in catalogs.CATALOGS.values() for ps in c.values() for p in ps]:
        assert catalogs.stem(patterns)


TERMINAL = ["sent", "seen"]


@pytest.mark.parametrize(
    ("batch", "expected", "state", "reasons"),
    [
        (None, 3, "insufficient_data", ["missing_per_job_ledger"]), (None, 0, "insufficient_data", ["no_provider_items_in_ledger_window"]), ((True, 3, 3, 0, True, {"sent": 3}, None), 3, "in_progress", ["cycle_in_progress_not_yet_persisted"]),
        ((False, 3, 3, 0, True, {"sent": 3}, None), 3, "ok", []), ((False, 3, 3, 0, True, {"sent": 3}, None), 4, "critical", ["detected_count_mismatch"]), ((False, 3, 2, 1, False, {"sent": 2, "lost": 1}, None), 3, "critical", ["job_rows_count_mismatch", "unaccounted_or_nonterminal_job"]),
        ((False, 2, 2, 0, True, None, [("a", "sent"), ("b", "odd")]), 2, "critical", ["unaccounted_or_nonterminal_job"]), ((False, 2, 2, 0, True, None, [("a", "sent"), ("b", "discarded_relevance:x")]), 2, "ok", []),
    ],
)
def test_reconciliation_reasons(spark, batch, expected, state, reasons):
    schema = "provider string, pending boolean, detected int, terminal int, unaccounted int, complete boolean, outcomes map<string, int>, jobs array<struct<key: string, outcome: string>>"
    batches = spark.createDataFrame([("p", *batch)] if batch else [], schema)
    r = coverage.reconcile(batches, spark.createDataFrame([("p", expected, True), ("off", 5, False)], "provider string, expected int, monitored boolean"), TERMINAL)
    got = {x.provider: (x.state, x.reasons) for x in r.collect()}
    assert got == {"p": (state, reasons), "off": ("not_applicable", ["provider_not_monitored"])}


def test_daily_report(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    row = lambda p, at, n: spark.range(1).select(F.lit(p).alias("provider"), t(at).alias("ts"), F.lit(n).alias("detected"), F.lit(0).alias("http_429"))
    cycles = row("a", "2024-01-01 10:00:00", 3).union(row("a", "2024-01-01 11:00:00", 2)).union(row("b", "2024-01-01 11:00:00", 9))
    ledger = lambda p, at, n: row(p, at, n).selectExpr("provider", "ts", "detected", "detected terminal", "0 unaccounted", "true complete", "map('sent', detected) outcomes", "CAST(NULL AS array<struct<key: string, outcome: string>>) jobs")
    batches = ledger("a", "2024-01-01 09:59:00", 3).union(ledger("a", "2024-01-01 10:59:00", 2)).union(ledger("b", "2024-01-01 10:50:00", 8)).union(ledger("b", "2024-01-01 11:05:00", 4))
    providers = spark.createDataFrame([("a",), ("b",), ("c",)], "provider string")
    got = {r.provider: r for r in coverage.coverage_report(cycles, batches, providers, ["detected", "http_429"], TERMINAL, "2024-01-01 11:10:00", 2, 3600).collect()}
    assert (got["a"].status, got["a"].reconciliation, got["a"].expected) == ("ok", "ok", 5)
    assert got["b"].status == "critical" and "per_job_reconciliation_failed" in got["b"].reasons and (got["b"].audited, got["b"].pending_detected) == (8, 4)
    assert got["c"].reasons[0] == "provider_missing_from_all_recorded_cycles" and got["all"].status == "critical" and got["all"].score == 33


def test_alias_and_run_joins(spark):
    batches = spark.createDataFrame([("north", "r1"), ("nord", ""), ("east", "r9")], "name string, run_id string")
    got = {(r.name, r.provider) for r in joins.alias_dim_join(batches, {"north": ["nord"]}).collect()}
    assert got == {("north", "north"), ("nord", "north")}
    runs = spark.sql("SELECT 'r1' run_id, TIMESTAMP '2024-01-01' ts")
    rows = batches.withColumn("ts", F.lit("2023-12-31").cast("timestamp"))
    assert {r.name: r.complete for r in joins.match_by_run(rows, runs).collect()} == {"north": True, "nord": True, "east": False}
    assert {r.key: r.state for r in joins.expected_left_join(spark.sql("SELECT explode(array('a', 'b')) key"), spark.sql("SELECT 'a' key, 'ok' state"), "key").collect()} == {"a": "ok", "b": "missing"}


def test_daily_files_and_reports(spark, tmp_path):
    for name, at in (("2024-01-01", "2024-01-01T05:00:00Z"), ("2024-01-05", "2024-01-02T05:00:00Z"), ("other", "2024-01-02T06:00:00Z")):
        (tmp_path / f"{name}.jsonl").write_text(f'{{"timestamp": "{at}"}}\n')
    assert pages.read_daily_ledger(spark, str(tmp_path), "2024-01-01 00:00:00", "2024-01-03 00:00:00").count() == 2
    out = tmp_path / "reports"
    for day in ("2024-01-01", "2024-01-09"):
        pages.write_report(spark.range(2), str(out), day)
    assert pages.drop_old_partitions(spark, str(out), 5, "2024-01-10") == ["2024-01-01"]
    assert sorted(p.name for p in out.iterdir()) == ["2024-01-09", "latest"] and spark.read.json(f"{out}/latest").count() == 2


def test_descriptions_take_the_best_text(spark):
    long_ = "A long description that says what the work is about in many words."
    rows = [(1, f'<div class="description">{long_}</div><article>{long_ * 3}</article>'), (2, f"<nav>menu</nav><main>{long_}</main>"), (3, "<p>short</p>"), (4, None), (5, f'<main>{long_}</main><script type="application/ld+json">{{"@type": "JobPosting", "description": "{long_ * 2}"}}</script>')]
    df = spark.createDataFrame([(*r, "known") for r in rows], "page_id long, html string, old string")
    got = {r.page_id: r.text for r in pages.extract_description(df, ['<div class="description">'], "old").collect()}
    assert got == {1: long_, 2: long_, 3: "known", 4: "known", 5: long_ * 2}


def test_heartbeats_equal_a_plain_walk(spark):
    from sievemill.plans.feeds import q_heartbeats

    want, wait = [], 43_200
    for _, g in spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas().groupby("user_id"):
        last = issued = None
        for r in g.sort_values("ts", kind="stable").itertuples():
            at = r.ts.timestamp()
            if last is None or r.event_type == "purchase":
                last, issued = at, None
            elif at - last >= 2 * wait and (issued is None or at - issued >= wait):
                issued = at
                want.append((r.user_id, int(at)))
    got = [(r.source, r.t) for r in q_heartbeats(spark, "/root/testdata/sf0.001").select("source", F.unix_timestamp("ts").alias("t")).collect()]
    assert sorted(got) == sorted(want) and want


def test_late_batches_are_closed_and_recovery_ends(spark, tmp_path):
    t = lambda rows, name: spark.createDataFrame(rows, "k string, at string").selectExpr("k", "CAST(at AS timestamp) ts").write.parquet(str(tmp_path / name))
    t([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:50:00"), ("b", "2024-01-01 10:00:00")], "b")
    t([("a", "2024-01-01 10:10:00"), ("b", "2024-01-01 12:00:00")], "c")
    read = lambda name: spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / name))
    q = streams.late_or_pending(read("b"), read("c"), "k", "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, str(r.ts)[11:16]): r.cycle_ts and str(r.cycle_ts)[11:16] for r in spark.read.schema("k string, ts timestamp, cycle_ts timestamp").parquet(str(tmp_path / "out")).collect()}
    assert got[("a", "10:00")] == "10:10" and all(v is None for k, v in got.items() if k != ("a", "10:00"))
    rows = spark.sql("SELECT * FROM VALUES (1, true, false), (2, false, false) AS v(id, recent, complete)")
    kept, on = streams.recovery_backfill(rows, F.col("recent"), F.col("complete"), True)
    assert on and [r.id for r in kept.collect()] == [1]
    assert streams.recovery_backfill(rows, F.col("recent"), F.col("complete"), False)[0].count() == 2
