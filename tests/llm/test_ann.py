import numpy as np

from sievemill.llm import ann


def test_recall_does_not_fall_with_the_size_of_the_table(spark):
    x = np.random.default_rng(3).normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = total = 0
    # 2,000 vectors in blocks of 16 are to the blocks what 512,000 are by default.
    for r in ann.nearest(df, block=16).groupBy("query_id").agg({"vec_id": "collect_list"}).collect():
        scores = x @ x[r[0]]
        scores[r[0]] = -np.inf
        hits, total = hits + len(set(r[1]) & set(np.argsort(-scores)[:20].tolist())), total + 20
    assert total == 2000 and hits >= 0.99 * total


def _recall(rows, x, k=20):
    hits = total = 0
    got: dict[int, set] = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits, total = hits + len(got.get(q, set()) & set(np.argsort(-scores)[:k].tolist())), total + k
    return hits / total


def test_recall_holds_for_every_number_of_rotations_and_for_unequal_lengths(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 24))
    for values, functions in ((x, 2), (x, 3), (x * np.exp(0.7 * r.normal(size=(1500, 1))), None)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
        assert _recall(ann.nearest(df, functions=functions).collect(), values) >= 0.9


def test_probes_are_the_best_combinations():
    r = np.random.default_rng(2)
    x = ann.unit(r.normal(size=(5, 7)))
    got = ann.probe_codes(x, 2, 2, 9)
    for t, values in ann.axes(x, 2, 2):
        for i in range(5):
            a, b = ((v[i].max() - v[i]) ** 2 for v in values)
            sums = np.add.outer(a, b)
            assert np.allclose(sorted(sums.ravel())[:9], [sums[p[0], p[1]] for p in got[i, t]])
            assert (got[i, t, 0] == ann.own_codes(x, 2, 2)[i, t]).all()


def test_repeated_ids_and_mixed_lengths(spark):
    rows = [(i % 30, [float(i % 30), 1.0 + i % 7]) for i in range(60)] + [(i, [1.0, 2.0, float(i)]) for i in range(40, 70)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    sizes = {i: len(v) for i, v in rows}
    assert all(sizes[r.query_id] == sizes[r.vec_id] and r.query_id != r.vec_id for r in got)
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got) == 5 * len({r.query_id for r in got})
