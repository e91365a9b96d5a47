"""Work that must grow with the input only, and tables in the form in which Spark writes them."""

import re

from pyspark.sql import functions as F

from sievemill.functions import experience, modality, text
from sievemill.operators import names
from sievemill.plans import boards, facts, feeds, records

SF = "/root/testdata/sf0.001"


def test_boards_grow_with_pages_and_suppliers(spark, tmp_path):
    spark.range(200).selectExpr("id AS page_id", "'' AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(500).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    cards = boards._boards(spark, str(tmp_path)).select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'"/jobs/(\d+)#x"'))).alias("k")).collect()
    assert {int(r.k) for r in cards} == set(range(500)) and len(cards) == 500 + boards.TOP * 200
    assert all(int(r.k) % 5 == r.page_id % 5 for r in cards)
    assert boards.q_board(spark, str(tmp_path)).count() == 3 * 200


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_ledger", "stream_first_seen", "stream_windows", "stream_heartbeats"):
        query = feeds.QUERIES[name][0]
        assert sorted(map(str, query(spark, str(tmp_path)).collect())) == sorted(map(str, query(spark, SF).collect())) != []


def test_made_up_records_are_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(facts._pages(spark, SF))
    assert "BroadcastHashJoin" not in plan(facts.q_page_records(spark, SF))


def test_plain_names_try_no_pattern(spark):
    docs = spark.createDataFrame([(1, "Über kafka_2 x"), (2, "kafkas"), (3, None), (3, "KAFKA_2"), (4, "a-b kafka_2")], "doc_id long, text string")
    aliases = spark.createDataFrame([(1, "K", "Kafka_2", None), (2, "U", "über", None), (3, "AB", "a-b", None)], "place int, name string, alias string, pattern string")
    told = names.names_told(docs, aliases.where("place < 3"))
    assert "RLIKE" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: list(r.names) for r in names.names_told(docs, aliases).collect()} == {1: ["K", "U"], 2: [], 3: ["K"], 4: ["K", "AB"]}


def test_first_characters_lose_no_match():
    said = " ".join([*records.SAID, "híbrido; 3 días en oficina, modelo 2/3, two days, 50% remoto sin remoto 100% remoto máximo 2 días de casa y 1 day office"]).lower()
    ladder = [modality.NO_REMOTE, (modality.SPLIT,), (modality.DAYS,), (*modality.SHARES, *modality.HYBRIDS), modality.REMOTES, tuple(experience.YEARS), (experience.SENIORITY,), (experience.NO_EXPERIENCE,)]
    for patterns in ladder:
        for p in patterns:
            for n in range(len(said)):
                assert bool(re.match(text.any_pattern(p), said[n:])) == bool(re.match(p, said[n:]))
        assert bool(re.search(text.any_pattern(*patterns), said)) == bool(re.search("|".join(f"(?:{p})" for p in patterns), said))


def test_phrases_are_searched_at_once(spark):
    row = spark.createDataFrame([("Big  \n Data, iot",)], "t string")
    got = row.select(text.any_phrase(F.col("t"), ["x", " big  DATA "]), text.any_phrase(F.col("t"), ["at", "io"]), text.any_phrase(F.col("t"), []), text.phrase_match(F.col("t"), "IoT")).first()
    assert tuple(got) == (True, False, False, True)
