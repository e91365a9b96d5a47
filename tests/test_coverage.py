"""Run summaries on small tables."""

from sievemill.operators import coverage

SCHEMA = "ts timestamp, complete boolean, partial boolean, valid boolean, correct boolean, absences int, unique_jobs int, duplicates int, urls array<struct<extension: string, api: string>>"


def summary(spark, rows):
    from pyspark.sql import functions as F

    runs = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = coverage.run_summary(runs, [], 1, "2024-01-01 00:10:00").first()
    return got.status, list(got.reasons), got.runs


def test_run_summary(spark):
    t = "2024-01-01 00:00:00"
    assert summary(spark, []) == ("critical", ["no_run_evidence"], 0)
    assert summary(spark, [(t, True, False, True, True, 0, 5, 0, [("ok", "ok")])]) == ("ok", [], 1)
    assert summary(spark, [(t, None, None, None, None, None, None, None, None)]) == ("critical", ["no_complete_batch"], 1)
    assert summary(spark, [(t, True, True, False, False, -4, 5, 0, [(" Blocked", None), ("http 429", "")])]) == ("warning", ["partial_batches", "no_valid_audit", "rate_limited", "blocked"], 1)
    assert summary(spark, [(t, True, False, True, False, 2, 5, 0, None)]) == ("critical", ["eligible_absence", "audit_not_correct"], 1)
    assert summary(spark, [("2023-12-31 00:00:00", True, False, True, True, 0, 5, 0, [])]) == ("critical", ["evidence_stale"], 1)
