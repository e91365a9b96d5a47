"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

All pieces are put into one automaton. It reads a text once; at each position the matches that
end there, found along the automaton's output links, relax the best score. Pieces hold the word
mark only in front, so texts fall into words that are encoded independently and remembered.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import table

MARK = "▁"
_MEMO_WORDS = 300_000


class PieceCodec:
    """Encoder and decoder for a list of (piece, score); byte pieces are ``<0xNN>``.

    The segmentation has the largest sum of scores; of equal sums the one whose last piece, then
    the one before and so on, is longest. A character that no piece covers is written as its
    bytes, at the lowest score less ten a character, and so is the word mark itself where a text
    holds it, so that decoding gives the text back exactly.
    """

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.byte_ids = [-1] * 256
        self.plain: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        floor = min((s for p, s in pieces if s > -1e8), default=0.0)
        self.fallback = floor - 10
        for i, (piece, score) in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.plain.append(bytes([int(piece[3:5], 16)]))
            elif piece in ("<unk>", "<s>", "</s>"):
                self.plain.append(b"")
            else:
                if MARK in piece[1:] and (piece.strip(MARK) or score > len(piece) * self.fallback):
                    raise ValueError(f"piece {i} would join two words")
                self.plain.append(piece.replace(MARK, " ").encode())
                if not (MARK in piece[1:]):
                    self.automaton.add_word(piece, (i, len(piece), score))
        if -1 in self.byte_ids:
            raise ValueError("every byte needs a piece")
        self.automaton.make_automaton()
        self.memo: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Little-endian ids of one word; spaces in front of it are marks."""
        n = len(word)
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0], done = 0.0, 0
        fallback = self.fallback
        for end, (piece, size, score) in self.automaton.iter(word):
            while done < end:  # no more pieces end before this position
                if best[done] + fallback > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + fallback, (1, -1)
                done += 1
            to = end + 1
            if best[to - size] + score > best[to]:
                best[to], back[to] = best[to - size] + score, (size, piece)
        while done < n:
            if best[done] + fallback > best[done + 1]:
                best[done + 1], back[done + 1] = best[done] + fallback, (1, -1)
            done += 1
        out: list[int] = []
        while n:
            size, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                char = " " if word[n - 1] == MARK else word[n - 1]
                out += [self.byte_ids[b] for b in reversed(char.encode("utf-8", "surrogatepass"))]
            n -= size
        return np.array(out[::-1], "<u4").tobytes()

    def _remembered(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= _MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = found = self.word(word)
        return found

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of ``text`` behind one word mark; none for the empty text."""
        if not text:
            return np.empty(0, "<u4")
        parts = text.split(" ")
        if MARK not in text:
            return np.frombuffer(b"".join([self._remembered(MARK + p) for p in parts]), "<u4")
        mark = np.array([self.byte_ids[b] for b in MARK.encode()], "<u4").tobytes()
        out = []
        for p in parts:
            first, *rest = p.split(MARK)
            out.append(self._remembered(MARK + first))
            for r in rest:
                out += [mark, self.word(r)]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``ids`` stand for, without the leading word mark."""
        return b"".join(map(self.plain.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """The codec of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return PieceCodec([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())])


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_crc32, decoded_sha256, (ids).

    ``ids`` are the best-scoring pieces of the whole text; ``ids_crc32`` is taken over them as
    little-endian unsigned 32-bit numbers and ``decoded_sha256`` over the text decoded from them,
    which equals the input's. Null and empty texts have no ids; a null ``doc_id`` stays null;
    repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch["text"].to_pylist()]
            out = {"doc_id": batch["doc_id"], "n_pieces": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}
            out["decoded_sha256"] = pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids], pa.string())
            if with_ids:
                out["ids"] = pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and the decoded text; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())})

    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")


def public_model() -> str:
    """Path of the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_model(), with_ids=False)
