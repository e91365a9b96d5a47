import random
import zlib

import numpy as np

from sievemill.llm import packing


def test_first_fit_decreasing_equals_plain_search():
    r = random.Random(2)
    for _ in range(200):
        items = [r.randrange(1, 101) for _ in range(r.randrange(40))]
        free, want = [], [None] * len(items)
        for i in sorted(range(len(items)), key=lambda i: (-items[i], i)):
            b = next((b for b, f in enumerate(free) if f >= items[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= items[i]
        assert packing.first_fit_decreasing(items, 100) == want


def test_pieces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "word " * 5000, "a<|endoftext|>b", "naïve 日本   \x00", "x" * 3000, "same", "same"]
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack_documents(df, *packing.public_vocabulary(), with_ids=True, group_docs=3).collect()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in got if r.doc_id == (i or None)), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), *packing.public_vocabulary()).count() == 0


def test_little_padding_and_same_ids_as_tokenizers(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = packing.query(spark, sf).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in docs.items()}
    assert sum(r.length for r in got) / (2048 * len({r.sequence_id for r in got})) > 0.95


def test_repeated_rows_do_not_fill_one_group(spark):
    df = spark.createDataFrame([(None, "same words here")] * 600, "doc_id long, text string")
    got = packing.pack_documents(df, *packing.public_vocabulary(), group_docs=50).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(got) == 600 and max(sizes.values()) < 200
