import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import repeats


def brute(docs: list[bytes], window: int) -> list[tuple]:
    seen = Counter(d[i : i + window] for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def locally(docs: list[bytes], window: int, gram: int, hot: int) -> list[tuple]:
    """The steps of the operator on plain lists."""
    cut = [(d, s, w, o, k) for d, raw in enumerate(docs) for s, w, o, k in repeats.segments(raw, window, gram)]
    rows = [(k, 0, (d, s), 0, o, True, docs[d][s : s + w - 1 + window]) for d, s, w, o, k in cut]
    spans: dict[int, list] = {}
    if len(rows) > 1 and (found := repeats.repeated_windows([r[6] for r in rows], [r[4] for r in rows], window)) is not None:
        for (d, s, *_), flags in zip(cut, found, strict=True):
            for i in flags.nonzero()[0].tolist():
                spans.setdefault(d, []).append((s + i, s + i + window))
    out = []
    for d, raw in enumerate(docs):
        gone = set()
        for a, b in spans.get(d, ()):
            gone.update(range(a, b))
        out.append((len(raw), len(gone), sum(i in gone and i - 1 not in gone for i in range(len(raw))), hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60).map(str.encode), max_size=6), st.integers(4, 12), st.integers(1, 4))
def test_transform_equals_brute_force(docs, window, gram):
    assert locally(docs, window, gram, 0) == brute(docs, window)


def test_operator_equals_brute_force(spark):
    import random

    r = random.Random(3)
    phrase = "".join(r.choice("abcde ") for _ in range(50))
    texts = [None, "", "short", phrase * 3, "x" * 90, "é" * 40 + phrase]
    texts += ["".join(r.choice("ab") for _ in range(r.randrange(80))) + phrase[r.randrange(20) :] + r.choice("ab") * r.randrange(30) for _ in range(40)]
    texts += texts[-3:]
    rows = [(i, t, i, "did") for i, t in enumerate(texts)] + [(None, phrase, 1, "x"), (5, texts[5], 5, "did")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long, did string")
    want = brute([(t or "").encode() for _, t, _, _ in rows], 20)
    want = sorted(((i,) + w for (i, *_), w in zip(rows, want, strict=True)), key=repr)
    for hot in (4096, 1):
        got = repeats.repeated_spans(df, window=20, gram=5, hot=hot, chunk=4).drop("spans").collect()
        assert sorted((tuple(x) for x in got), key=repr) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeated_spans(df).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i,) + w for (i, _), w in zip(docs, brute([d for _, d in docs], 400), strict=True)}
    assert {tuple(r) for r in repeats.query(spark, sf).collect()} == want
