"""Packing token sequences: first-fit decreasing with a tournament tree, in random groups.

Tokenising and cutting happen where a document is read; only piece lengths are shuffled, to
groups of documents drawn by hash. Groups are packed independently.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import table

END_ID, END_OF_TEXT = 1, "<|endoftext|>"


@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: 50256})


def encode(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """uint32 ids of ``text``, as the ``tokenizers`` file of the same vocabulary gives them, then id 1."""
    ids = _encoding(ranks_path, pattern).encode_to_numpy(text, allowed_special={END_OF_TEXT})
    return np.append(ids, np.uint32(END_ID)).astype("<u4")


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item: longest first, each into the first bin that still has room.

    A tournament tree over the bins holds in every node the largest free capacity below it, so
    the first bin with room is found by one walk from the root.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free, out = [capacity] * (2 * leaves), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        out[i] = (node - leaves, capacity - free[node])
        free[node] -= need
        while node > 1:
            node //= 2
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left > right else right
    return out


def _pieces(capacity: int, ranks_path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            kept = []
            for doc, text, row in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["row"].to_pylist(), strict=True):
                ids = encode(text or "", ranks_path, pattern)
                whole = zlib.crc32(ids)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for column, value in zip(rows, (doc, start, len(piece), zlib.crc32(piece), len(ids), whole, row), strict=True):
                        column.append(value)
                    if with_ids:
                        kept.append(piece.astype("<i4"))
            columns = {n: pa.array(x, pa.int64()) for n, x in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "whole", "row"), rows, strict=True)}
            if with_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _packed(capacity: int, names: list[str]):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "whole", "row", "start"], kind="stable", ignore_index=True)
        placed = first_fit_decreasing(pieces["length"].tolist(), capacity)
        pieces["sequence_id"] = pieces["pack"].to_numpy("int64") * 2**32 + np.array([b for b, _ in placed], "int64")
        pieces["offset"] = np.array([o for _, o in placed], "int64")
        return pieces[names]

    return run


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, group_docs: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids end with id 1 and are cut every ``capacity``; pieces are packed within
    groups of about ``group_docs`` documents drawn by a hash of id, content and the row's number,
    so groups do not grow with the table or with repeated rows. Null text is empty and gives the end id alone; a null ``doc_id`` stays
    null; repeated rows are packed as separate documents; an empty table gives no rows; other
    columns are ignored. ``with_ids`` adds each piece's ids.
    """
    groups = max(1, -(-docs.count() // group_docs))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, whole long, row long" + ", ids array<int>" * with_ids
    cut = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(_pieces(capacity, ranks_path, pattern, with_ids), schema)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    # The row's number deals out rows that repeat each other; it decides the place of a row, not its ids.
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("doc_id", "whole", "doc_tokens", "row"), F.lit(groups)))
    return dealt.groupBy("pack").applyInPandas(_packed(capacity, names), out)


def public_vocabulary() -> tuple[str, str]:
    """Path of the byte-level BPE ranks and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *public_vocabulary())
