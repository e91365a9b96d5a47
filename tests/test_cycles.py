"""Outcomes and counters of cycles, rule files, ordered scans, counted purges."""

import json

import pytest
from pyspark.sql import functions as F

from sievemill.operators import cycles, names, rulefile, tables
from sievemill.sources import scans

ROWS = "seq long, cycle long, recency string, is_seen boolean, status string, reason string, is_fresh boolean, delivered boolean"


def outcomes(spark, rows, alerts, paused, first, most):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROWS).withColumn("decision", F.struct("status", F.lit("ai").alias("family")))
    return cycles.cycle_outcomes(df, "cycle", "seq", F.lit(alerts), F.lit(paused), F.lit(first), most)


def test_first_rule_that_applies(spark):
    fine = (1, None, None, "accepted", None, None, True)
    rows = [(1, "outside", True, "rejected", "x", None, True), (1, "unverified", True, "rejected", "x", None, True), (1, "accepted", True, "rejected", "x", None, True), (1, "accepted", False, "rejected", "x", None, True), (1, None, None, "warning", "location", None, True), fine, (*fine[:-1], False), (*fine[:-1], None), fine, fine, (None, *fine[1:])]
    got = [r.outcome for r in outcomes(spark, rows, True, False, False, 2).orderBy("seq").collect()]
    assert got == ["discarded_time_window", "unverified_time_window", "seen", "discarded_relevance:ai", "discarded_location", "sent", "delivery_failed", "delivery_failed", "sent", "notification_limit", "sent"]
    assert [r.outcome for r in outcomes(spark, [fine] * 3, True, False, False, 0).collect()] == ["sent"] * 3
    assert [r.outcome for r in outcomes(spark, [fine] * 3, True, True, False, 1).collect()] == ["paused"] * 3
    fresh = (1, None, None, "accepted", None, True, True)
    first = outcomes(spark, [fine, fresh, fine], False, False, True, 1).orderBy("seq").collect()
    assert [(r.outcome, r.saved) for r in first] == [("alerts_disabled", True), ("sent", True), ("alerts_disabled", True)]
    assert not any(r.saved for r in outcomes(spark, [fine], False, False, False, 1).collect())
    stats = cycles.cycle_stats(outcomes(spark, rows, True, False, False, 2), ["cycle"]).where("cycle = 1").first()
    assert (stats.detected, stats.eligible, stats.sent, stats.saved, stats.notification_limit, stats.relevance_warning, stats.discarded_relevance) == (10, 5, 2, 2, 1, 1, 1) and set(cycles.COUNTERS) < set(stats.asDict())
    assert outcomes(spark, rows, True, False, False, 2).limit(0).count() == 0


def test_rule_files(spark, tmp_path):
    body = {"__note": "x", "TECH_TOOLS_CATALOG": [["Python", [r"\bpython\b", "django"]], ["Cloud", ["aws", "ci/cd"]]], "KNOWN_CONSULTANCIES": ["acme"], "PRIMARY_AREA": ["Valencia", "[FILL IN]"], "OTHER_CITIES": ["vigo"], "RELEVANCE": {"ai": ["llm"]}}
    (tmp_path / "rules.json").write_text(json.dumps(body))
    got = rulefile.read_rules(spark, str(tmp_path / "rules.json"))
    assert got.places.home == ("valencia",) and got.places.remote_words[0] == "remoto" and got.relevance.ai == ["llm"] and got.relevance.data and got.consultancies == ["acme"]
    docs = spark.createDataFrame([(1, "PYTHON on AWS, ci/cd"), (2, "pythons")], "doc_id long, text string")
    told = names.names_told(docs, names.alias_rows(spark, *rulefile.split_tools(got.tools)))
    assert {r.doc_id: r.names for r in told.collect()} == {1: ["Python", "Cloud"], 2: []}
    for bad in ("{", "[]", '{"X": 1}', '{"PRIMARY_AREA": "x"}', '{"PRIMARY_AREA": [1]}', '{"TECH_TOOLS_CATALOG": [["a"]]}', '{"RELEVANCE": {"zz": []}}'):
        with pytest.raises(ValueError):
            rulefile.parse_rules(bad)


def test_places_without_one_task(spark, tmp_path):
    df = spark.createDataFrame([(i, (i * 7) % 5 if i % 9 else None) for i in range(200)], "id long, t long")
    for tasks in (None, 1, 7):
        rows = scans.numbered(df, [F.desc_nulls_last("t"), F.asc("id")], f"{tmp_path}/n{tasks}", tasks).collect()
        want = sorted(df.collect(), key=lambda r: (r.t is None, -(r.t or 0), r.id))
        assert [(r.id, r.place) for r in sorted(rows, key=lambda r: r.place)] == [(r.id, n + 1) for n, r in enumerate(want)]
    assert scans.numbered(df.limit(0), [F.asc("id")], f"{tmp_path}/none").count() == 0


def test_purge_tells_what_it_removed(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-09', NULL)) ts")
    for undated, kept, removed in ((False, 1, 2), (True, 2, 1)):
        rows, seen = tables.purge_counted(df, 7, "2024-01-10 00:00:00", undated)
        assert rows.count() == kept and seen.get["removed"] == removed
