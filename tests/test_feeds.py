"""Sources that read files, and text facts on single sentences."""

from pyspark.sql import functions as F

from sievemill.functions import features
from sievemill.sources import feeds


def test_jsonl_window_keeps_broken_lines_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z"}\n\n{"timestamp": "2024-01-02T00:00:00Z"}\nnope\n[1]\n{"timestamp": "soon"}\n{"timestamp": "2025-01-01T00:00:00Z"}\n')
    got = feeds.read_jsonl_window(spark, str(tmp_path), "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert {r["state"]: r["count"] for r in got.groupBy("state").count().collect()} == {"ok": 2, "malformed": 2, "invalid_timestamp": 1}


def test_seen_text_takes_the_first_line_of_a_key(spark, tmp_path):
    (tmp_path / "seen.txt").write_text("north:a7|500\nplain key\nnorth:a7|900\neast:q|soon\n")
    got = feeds.import_seen_text(spark, str(tmp_path), "2024-01-01 00:00:00").select("key", F.unix_timestamp("ts")).collect()
    assert dict(map(tuple, got)) == {"north:a7": 500, "plain key": 1704067200, "east:q": 1704067200}


def test_experience(spark):
    text = ["Pedimos al menos 4 years con hornos", "La empresa cuenta con 30 años", "de 2 a 5 años en viveros", "", None]
    rows = spark.createDataFrame(list(enumerate(text)), "i int, t string").orderBy("i").select(features.experience(F.col("t")).alias("e")).collect()
    assert [tuple(r.e) for r in rows] == [(4, None, "Mid"), (None, None, "unspecified"), (2, 5, "Senior"), (None, None, "unspecified"), (None, None, "unspecified")]


def test_decision_map_rejects_unknown_states(spark):
    body = '{"a": {"fingerprint": "f", "decision": {"status": "accepted", "score": 130, "family": "data"}, "timestamp": "100"}, "b": {"decision": {"status": "maybe", "score": 1}}, "c": {"decision": {"status": "warning", "score": "x"}}, "d": {"decision": {"status": "rejected"}}}'
    got = feeds.import_decision_map(spark.createDataFrame([(body,), ("nope",), (None,)], "body string")).collect()
    assert {r.key: r.decision and tuple(r.decision) for r in got} == {"a": ("accepted", 100, "data"), "b": None, "c": None, "d": ("rejected", 0, "sin_evidencia_digital")}
