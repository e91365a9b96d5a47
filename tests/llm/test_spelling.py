import random
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import spelling


def near(a, b):
    """Whether one inserted, deleted or replaced character makes ``b`` of ``a``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def by_hand(rows, slip, least=5, ratio=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    out = {}
    for w in n:
        mine = [v for v in n if near(w, v)]
        best = min(mine, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= ratio * n[w] else None, len(mine))
    rows = []
    for w, (form, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(rows, key=repr)


def test_words_of_few_letters(spark):
    """Many words of two letters: hardly any bigram is rare, most are repeated inside a word."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(400)} | {"aaaaaa", "aaaaaaa", "ababab", "bababa"})
    got = {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)} and got


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", min_size=6, max_size=12), st.integers(0, 11), st.sampled_from("abcé"), st.integers(0, 2), st.dictionaries(st.text("abcé", min_size=2, max_size=2), st.integers(1, 9)))
def test_a_pivot_meets_the_other_prefix(word, at, letter, kind, costs):
    at = min(at, len(word) - 1)
    other = word[:at] + (letter + word[at + 1 :], word[at + 1 :], letter + word[at:])[kind]
    if len(other) < 6 or not near(word, other):
        return
    cost = {w[i : i + 2]: costs.get(w[i : i + 2], 5) for w in (word, other) for i in range(len(w) - 1)}
    (pivots, prefix), (other_pivots, other_prefix) = spelling.pivotal(word, cost), spelling.pivotal(other, cost)
    assert pivots[1] - pivots[0] >= 2 and set(pivots) <= set(prefix)
    cheapest = min(cost[word[i : i + 2]] + cost[word[j : j + 2]] for i in prefix for j in prefix if j >= i + 2)
    assert sum(cost[word[i : i + 2]] for i in pivots) == cheapest
    meets = [(i, j) for w, v, p, q in ((word, other, pivots, other_prefix), (other, word, other_pivots, prefix)) for i in p for j in q if abs(i - j) <= 1 and w[i : i + 2] == v[j : j + 2]]
    assert meets


def test_odd_rows(spark):
    rng = random.Random(4)
    parts = ["über", "ein", "heit", "Ñan", "tion", "stra", "lle"]
    words = ["".join(rng.choice(parts) for _ in range(3)) for _ in range(25)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(80)]
    chain = "abcdefg " * 700 + "abcdefgh " * 130 + "abcdefghi " * 25 + "abcdefghij " * 5 + "abcdefgx " * 700 + "xabcdef " * 4
    rows = [*enumerate(texts), (None, "Freedoms " * 6), (None, None), (7, ""), (7, texts[7]), (7, texts[7]), (100, "×÷×÷×÷ " * 9), (101, chain), (102, "a1" * 100_000), (103, "langeswort " * 50_000), (104, "langeswor " * 10), (105, "日本語日本語日本語 " * 9)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    for slip in (None, 199, 3):
        got = sorted(map(tuple, spelling.spelling_variants(df, slip=slip).collect()), key=repr)
        assert got == by_hand(rows, slip)
    roots = {r.word: r.root for r in spelling.spelling_variants(df).collect()}
    assert roots["abcdefghij"] == "abcdefg" and roots["langeswor"] == "langeswort"
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_equals_sql(spark, sf):
    df = spelling.query(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(spelling.ORACLE)
    at = [want.columns.index(c) for c in df.columns]
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr) and any(r[1] for r in got)
