import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sievemill.llm import negatives


def by_hand(rows, anchor, positives=5, count=10, span=(30, 90), scale=256):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), straight from the definition."""
    live = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, v, lab in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, lab, q) in enumerate(live):
        if not anchor(i):
            continue
        others = [(-sum(map(int.__mul__, q, w)), j, n, other) for n, (j, other, w) in enumerate(live) if n != at and len(w) == len(q)]
        for p, pid, _, _ in sorted(x for x in others if x[3] == lab)[:positives]:
            fit = sorted(x for x in others if x[3] != lab and span[0] * -p <= 100 * -x[0] <= span[1] * -p)[:count]
            out += [(i, pid, rank, j, -p, -s) for rank, (s, j, _, _) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 7) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, rid string, means int")


def found(df):
    return sorted(map(tuple, df.collect()))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for d in (0, 1, 5, 16, 64, 100):
        x = np.floor(rng.normal(0, 40, (20, d)) + rng.integers(-30, 30, (20, 1)))
        means, devs = negatives.summarise(x)
        for n in negatives.LEVELS:
            m, s = negatives.coarser(means, devs, n)
            size = max(1, -(-d // negatives.SEGMENTS)) * negatives.SEGMENTS / n
            assert (np.abs(x @ x.T - size * m @ m.T) <= size * s @ s.T + 1e-6).all()


def test_odd_rows(spark):
    rng = random.Random(5)
    base = [rng.gauss(0, 0.3) for _ in range(12)]
    rows = [(i, [np.float32(b + rng.gauss(0, 0.1 if i % 3 else 0.4)).item() for b in base], i % 2) for i in range(60)]
    rows += [(0, rows[0][1], 0), (3, rows[3][1], 1), (70, rows[10][1], 0), (71, rows[10][1], 1)]  # repeats and ties
    rows += [(None, base, 0), (72, None, 0), (73, base, None), (74, [None, *base[1:]], 0), (75, [math.nan, *base[1:]], 0), (76, [-math.inf, *base[1:]], 1), (77, [], 0), (78, [], 1), (80, [], 0), (79, [0.0] * 12, 0)]
    rows += [(80, base[:5], 0), (81, base[:5], 1), (82, base[:5], 0), (90, [3e4] * 12, 0), (91, [3e4] * 12, 1), (95, [2.7e4] * 12, 0)]
    df = table(spark, rows)
    for anchor, condition in ((lambda i: i % 10 == 0, F.col("vec_id") % 10 == 0), (lambda i: True, None)):
        want = by_hand(rows, anchor)
        assert want and found(negatives.hard_negatives(df, is_anchor=condition)) == want
        assert found(negatives.hard_negatives(df.repartition(5), is_anchor=condition, block_anchors=9)) == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0 and negatives.hard_negatives(df, is_anchor=F.lit(False)).count() == 0


def test_large_values_stay_exact(spark):
    rows = [(i, [np.float32(x).item() for x in (3e5 + i, -2e5, 1e5 * i)], i % 2) for i in range(20)]
    assert found(negatives.hard_negatives(table(spark, rows))) == by_hand(rows, lambda i: True)


def test_bounds_cut_clustered_vectors():
    """On vectors with structure the bounds leave few pairs to score; results are the same as without them."""
    rng = np.random.default_rng(3)
    centres = np.repeat(rng.normal(0, 60, (40, 8)), 8, axis=1)
    x = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 8, (3000, 64))).astype(np.int64)
    import pyarrow as pa

    means, devs = negatives.summarise(x.astype(float))
    lists = [pa.array(list(v)) for v in (x, means, devs)]
    data = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array([i % 7 for i in range(3000)]), *lists], names=["rid", "vec_id", "label", "vector", "means", "devs"])
    rows, anchors = negatives.Side.by_length(data)[64], negatives.Side.by_length(data.slice(0, 50))[64]
    search = negatives.Search(anchors, True, np.full((50, 1), -(1 << 60)), np.full((50, 1), 1 << 60), 5)
    for a in range(0, 3000, 100):
        search.look(rows, a, a + 100)
    assert search.looked[-1] < search.looked[0] / 4
    for i in range(50):
        order = sorted((-int(x[i] @ x[j]), j) for j in range(3000) if j != i and j % 7 == i % 7)[:5]
        mine = search.kept[0] == i
        assert [(-s, j) for s, j in order] == list(zip(search.kept[2][mine].tolist(), search.kept[3][mine].tolist(), strict=True))


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = negatives.query(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(negatives.ORACLE)
    at = [want.columns.index(c) for c in df.columns]
    assert found(df) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
