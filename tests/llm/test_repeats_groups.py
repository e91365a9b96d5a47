import random

from pyspark.sql import functions as F

from sievemill.llm import repeats
from tests.llm.test_repeats import brute


def test_a_passage_in_many_texts_is_not_gathered_in_one_group(spark, monkeypatch):
    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = some(60)
    rows = [(i, some(30) + passage + some(30)) for i in range(300)]
    seen, divide = [], repeats.divide
    monkeypatch.setattr(repeats, "divide", lambda *a: seen.append(divide(*a)) or seen[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x) for x in repeats.repeated_spans(df, window=40, gram=8, hot=20, chunk=8).drop("spans").collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute([t.encode() for _, t in rows], 40), strict=True))
    assert sum(x[2] for x in got) >= 300 * 60
    largest = seen[0][0].groupBy("dealt").count().agg(F.max("count")).first()[0]
    assert largest is None or largest <= 20
