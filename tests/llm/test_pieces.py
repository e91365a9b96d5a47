import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import pieces

TOY = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), ("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -4.0), ("▁a", -3.5), ("▁ab", -6.0), ("ba", -5.0), ("aba", -5.5), ("▁▁", -1e9)]


def brute(codec, text):
    """Largest sum of scores over all segmentations, by plain dynamic programming."""
    t = pieces.MARK + text.replace(" ", pieces.MARK)
    scores = {p: s for p, s in TOY if not p.startswith("<") and p != "▁▁"}
    best = [0.0] + [float("-inf")] * len(t)
    for i in range(1, len(t) + 1):
        best[i] = max([best[i - 1] + codec.fallback] + [best[i - len(p)] + s for p, s in scores.items() if t[:i].endswith(p) and i >= len(p)])
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab é▁", max_size=14))
def test_best_score_and_round_trip(text):
    codec = pieces.PieceCodec(TOY)
    ids = codec.encode(text)
    assert codec.decode(ids) == text
    if text and pieces.MARK not in text:
        runs, total = 0, 0.0
        for i in ids.tolist():
            if 3 <= i < 259:
                runs += 1
            else:
                total += TOY[i][1]
        total += codec.fallback * (runs / len("é".encode()))
        assert abs(total - brute(codec, text)) < 1e-9


def test_operator(spark):
    import hashlib

    texts = [None, "", "  two  spaces \n", "日本▁語", "x" * 5000, "the quick brown fox"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = pieces.encode_texts(df, pieces.public_model())
    assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in pieces.decode_ids(out, pieces.public_model()).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_texts(df.limit(0), pieces.public_model()).count() == 0
    assert np.array_equal(pieces.codec(pieces.public_model()).encode(""), np.empty(0, "<u4"))
