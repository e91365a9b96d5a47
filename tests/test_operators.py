from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators import joins, relevance, tables


def test_term_weights(spark):
    rows = [("no need of python here, python", 0), ("nice to have python", 1), ("nice to have " + "x" * 70 + " python", 4), ("we use python", 4), ("pythonic", 0)]
    df = spark.createDataFrame(rows, "t string, w int")
    got = df.select("w", text.term_weight(F.col("t"), "python", ["no need of"], ["nice to have"]).alias("g")).collect()
    assert [r.w for r in got] == [r.g for r in got]


def test_status_and_family_by_title(spark):
    cases = [("Data Engineer", "accepted", "data"), ("AI Engineer", "accepted", "ai_ml"), ("Soldador", "rejected", "mecanica_fabricacion"), ("Operario PLC", "rejected", "plc_scada_puro"), ("Camarero", "rejected", "sin_evidencia_digital"), (None, "rejected", "sin_evidencia_digital")]
    df = spark.createDataFrame([(t, None, "x", None) for t, _, _ in cases], "title string, company string, source string, description string")
    got = relevance.classify_relevance(df).select("decision.*").collect()
    assert [(r.status, r.family) for r in got] == [(s, f) for _, s, f in cases]
    assert all(r.score >= 70 for r in got if r.status == "accepted") and all(r.score < 50 for r in got if r.status == "rejected")


def test_seen_by_alias(spark):
    df = spark.createDataFrame([("s", "1", ["9"]), ("s", "2", None), ("t", "9", [])], "source string, job_id string, aliases array<string>")
    seen = spark.createDataFrame([("s", "9")], "source string, job_id string")
    assert sorted((r.source, r.job_id) for r in joins.anti_seen(df, seen).collect()) == [("s", "2"), ("t", "9")]


def test_batches_are_closed_or_pending(spark):
    sec = lambda s: F.timestamp_seconds(F.lit(s))
    one = lambda s, k: spark.range(1).select(F.lit(k).alias("k"), sec(s).alias("ts"), F.lit(s).alias("n"))
    batches = one(10, "a").union(one(50, "a")).union(one(95, "a"))
    got = {r.n: r.pending for r in joins.asof_close(batches, one(10, "a").union(one(90, "a")), 30, ["k"]).collect()}
    assert got == {10: False, 50: True, 95: True}


def test_undated_rows(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01'), (2, NULL), (3, TIMESTAMP '2020-01-01') AS v(id, ts)")
    assert {r.id for r in tables.purge_older_than(df, 30, "2024-01-10").collect()} == {1}
    assert {r.id for r in tables.purge_older_than(df, 30, "2024-01-10", keep_undated=True).collect()} == {1, 2}
