import random

from pyspark.sql import functions as F

from sievemill.llm import quality


def corpus(n, seed):
    """Documents whose text and source both tell their class, each with mistakes of its own."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.6
        told = good if r.random() < 0.93 else not good
        words = [f"{'g' if told else 'b'}{r.randrange(1500)}" if r.random() < 0.3 else f"n{r.randrange(60)}" for _ in range(30)]
        told = good if r.random() < 0.93 else not good
        rows.append((i, " ".join(words), f"{'fine' if told else 'poor'}{r.randrange(6)}", "en", 100, int(good)))
    return rows


def test_exchange_beats_none_on_held_out_labels(spark):
    rows = corpus(2400, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int, truth int").coalesce(4)
    labels = df.where("pmod(xxhash64(doc_id, 7), 40) < 3").select("doc_id", F.col("truth").alias("quality"))
    docs, held = df.drop("truth"), df.join(labels, "doc_id", "left_anti").select("doc_id", "truth")
    right = {}
    for rounds in (0, 2):
        out = quality.score(docs, labels, rounds=rounds, sure=0.8, pool_share=1.0).join(held, "doc_id")
        right[rounds] = out.agg(F.avg(((F.col("text_score") >= 0.5).cast("int") == F.col("truth")).cast("int")), F.avg((F.col("keep").cast("int") == F.col("truth")).cast("int"))).first()
    assert right[2][0] > right[0][0] + 0.02, right  # the text view has learnt words that no label told
    assert right[2][1] >= right[0][1] - 0.01, right


def test_a_view_that_tells_one_class_hands_over_nothing(spark):
    margins = spark.createDataFrame([(float(m), None) for m in [5, 4, 3, 1, 0.5]], "m double, taken double")
    told = lambda df, good: [r.x for r in df.select(quality._handed_over(df, "m", "taken", good, 0.9).alias("x")).collect()]
    assert told(margins, 0.5) == [None] * 5
    both = spark.createDataFrame([(float(m), None) for m in [9, 8, 7, 6, 5, 4, 3, 2.5, 1, -1, -3, -4]], "m double, taken double")
    got = told(both, 0.5)
    assert got.count(0.0) == 2 and got[:2] == [1.0, 1.0] and 2 <= got.count(1.0) <= 3
    got = told(both, 0.8)
    assert got.count(0.0) == 2 and got.count(1.0) == 8
