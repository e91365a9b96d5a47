import random

from sievemill.llm import minhash


def brute(rows: list[tuple], percent: int = 85) -> list[tuple]:
    sets = [set(minhash.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]:
                root[find(i)] = find(j)
            elif sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), None if d is None else least[find(i)], d is None or d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)) if d is not None) + [(None, len(s), None, True) for (d, _), s in zip(rows, sets, strict=True) if d is None]


def test_hot_group_chains_and_odd_rows(spark):
    r = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if r.random() > 0.012 else f"z{r.random()}" for w in base)) for i in range(300, 0, -1)]
    rows += [(1000 + i, " ".join(base[:60] + [f"{r.random()}" for _ in range(r.randrange(200))])) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "É two"), (2006, "é two"), (None, rows[0][1])]
    rows += [(3000 + i, rows[5][1]) for i in range(20)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component long, band string")
    for held, block in ((64, 500_000), (2, 500_000), (2, 5_000)):
        got = [tuple(x) for x in minhash.near_components(df, pair_members=held, block_shingles=block).collect()]
        key = lambda x: (x[0] is None, x[0] or 0)
        assert sorted(got, key=key) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_components(df).count() == 0


def test_signature_estimates_jaccard():
    import numpy as np

    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.15


def test_copies_linked_only_through_their_source(spark):
    r = random.Random(7)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(f"z{r.random()}" if k in cut else w for k, w in enumerate(base))) for i in range(80) for cut in [set(r.sample(range(400), 6))]]
    rows += [(500, " ".join(base)), (501, " ".join(base[:200] + [f"v{i}" for i in range(200)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (64, 2):
        assert sorted(tuple(x) for x in minhash.near_components(df, pair_members=held).collect()) == brute(rows)


def test_texts_that_share_an_id(spark):
    """(1, A), (1, B), (2, A'), (3, B'): one document with two texts links both sides; a long chain of such ids too."""
    text = lambda name, cut=0: " ".join(f"{name}{i}" for i in range(60 - cut))
    rows = [(10, text("a")), (10, text("b")), (20, text("a", 1)), (30, text("b", 1)), (40, text("c")), (40, text("c")), (40, ""), (50, text("c", 1)), (5, text("d")), (60, text("d", 1))]
    rows += [(100 + k // 2, text(f"k{(k + 1) // 2}", k % 2)) for k in range(24)] + [(7, text("a", 60)), (7, None)]
    random.Random(3).shuffle(rows)
    got = sorted(tuple(x) for x in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and {c for d, _, c, _ in got if d in (10, 20, 30)} == {10} and {c for d, _, c, _ in got if d >= 100} == {100}
