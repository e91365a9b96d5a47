"""Removal of long repeated byte strings by a column-wise collection transform.

1. Each text is cut into segments: maximal runs of windows that share the same anchor, the
   leftmost gram with the smallest hash in the window. Equal windows hold equal anchors at equal
   places, so only segments with equal anchors can repeat each other.
2. Equal segments are counted before anything is gathered. Anchors that occur once are dropped;
   for the others one copy of each distinct segment is cut out of its document.
   Anchors with many segments are divided into chunks of windows, equal chunks are counted too,
   and where many distinct ones still meet their windows are counted one by one.
3. A partition's segments are aligned on their anchors and form one collection. Column by column
   from the right, one symbol per segment is put in front of its suffix: a stable sort of the
   previous order by the new symbol is the collection's transform in that column, and the common
   prefixes of neighbours follow from range minima over the previous ones. Windows whose suffix
   shares at least a window's length with a neighbour repeat. Columns are kept in sequential
   files when a collection is large.
4. Repeated windows go back to all places where their segment occurs.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import settle, table
from sievemill.llm.minhash import mix

WINDOW, GRAM = 400, 64
#: An anchor with more distinct segments is divided by the bytes that a few neighbouring windows share.
HOT_SEGMENTS, CHUNK = 512, 16
#: Bytes of a collection that are held in memory; larger ones lie in files.
COLLECTION_BYTES = 48 << 20
_PIECE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = np.random.default_rng(7).integers(0, 1 << 63, 256, np.int64).astype(np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(1 << int(n - 1).bit_length(), base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
    return _powers


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(start, windows, anchor's offset from start, anchor hash) of each segment of ``raw``."""
    for base in range(0, max(0, len(raw) - window + 1), _PIECE):
        data = np.frombuffer(raw, np.uint8, min(_PIECE + window - 1, len(raw) - base), base)
        up, down = _power_tables(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
            h = mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
        low = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
        place = (low & _PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        ends = np.append(starts[1:], len(place))
        for s, e, p in zip(starts.tolist(), ends.tolist(), place[starts].tolist(), strict=True):
            yield base + s, e - s, p - s, int(h[p].astype(np.int64))


def repeated_windows(texts: list[bytes], offsets: list[int], window: int = WINDOW) -> np.ndarray | None:
    """For segments aligned on their anchors: a row per segment, true where a window repeats.

    Column 0 of row i is the first byte of segment i. None if nothing repeats.
    """
    start = -np.array(offsets, np.int64)
    end = start + np.array([len(x) for x in texts], np.int64)
    low, n = int(start.min()), len(texts)
    start, end = start - low, end - low
    width = int(end.max())
    symbols = _columns((width, n))
    for i, x in enumerate(texts):
        symbols[start[i] : end[i], i] = np.frombuffer(x, np.uint8)
    found = _columns((width, n))
    entering = np.argsort(-end, kind="stable")
    enters_at, entered = end[entering] - 1, 0
    order, common = np.empty(0, np.int64), np.empty(0, np.int16)
    any_found = False
    for c in range(width - 1, -1, -1):
        stays = start[order] <= c
        if not stays.all():
            left = np.flatnonzero(stays)
            common = np.minimum.reduceat(common[: left[-1] + 1], np.append(0, left[:-1] + 1)) if len(left) else common[:0]
            order = order[left]
        upto = entered + int(np.searchsorted(-enters_at[entered:], -c, side="right"))
        if upto > entered:
            order = np.concatenate([entering[entered:upto], order])
            common = np.concatenate([np.zeros(upto - entered, np.int16), common])
            if upto - entered < len(common):
                common[upto - entered] = 0
            entered = upto
        if not len(order):
            continue
        column = symbols[c][order]
        by = np.argsort(column, kind="stable")
        order, column = order[by], column[by]
        common = _after(common, by, column)
        hit = common >= window
        if hit.any():
            any_found = True
            hit[:-1] |= hit[1:]
            found[c][order[hit]] = 1
    if not any_found:
        return None
    out = np.zeros((n, width), bool)
    for i in range(n):
        out[i, : end[i] - start[i]] = found[start[i] : end[i], i]
    return out


def _columns(shape: tuple[int, int]) -> np.ndarray:
    """Zeroed bytes by column: in memory, or in a file that is read and written in sequence."""
    if shape[0] * shape[1] <= COLLECTION_BYTES:
        return np.zeros(shape, np.uint8)
    return np.memmap(tempfile.TemporaryFile(), np.uint8, "w+", shape=shape)  # noqa: SIM115


def _after(common: np.ndarray, by: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours after ``by`` has sorted the previous order by the new symbol."""
    out = np.zeros(len(by), np.int16)
    at = np.flatnonzero(column[1:] == column[:-1]) + 1
    if not len(at):
        return out
    first, last = by[at - 1] + 1, by[at]
    span = last - first + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    least = np.empty(len(at), np.int16)
    tree = common
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            tree = np.minimum(tree[:-half], tree[half:])
        mine = np.flatnonzero(level == k)
        if len(mine):
            least[mine] = np.minimum(tree[first[mine]], tree[last[mine] - (1 << k) + 1])
    out[at] = least + 1
    return out


def _cut(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            for did, dk, raw in zip(batch["did"].to_pylist(), batch["dk"].to_pylist(), batch["raw"].to_pylist(), strict=True):
                for start, windows, offset, key in segments(raw, window, gram):
                    seg = xxhash.xxh3_64_intdigest(raw[start : start + windows - 1 + window], seed=offset)
                    for column, value in zip(rows, (did, dk, start, windows, offset, key, seg - (1 << 63)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["did", "dk", "start", "windows", "offset", "key", "seg"])

    return run


def _same(data: bytes, offset: int) -> bytes:
    return xxhash.xxh3_128_digest(data, seed=offset % (1 << 64))


_PIECE_TYPES = "did long, dk long, start long, key long, seg long, dealt long, lo long, hi long, offset long, alone boolean, same binary"


def _split(window: int, chunk: int):
    """Chunks of windows of each document's wanted segments, each with the hash of its bytes."""
    names = [x.split()[0] for x in _PIECE_TYPES.split(", ")]
    types = [*[pa.int64()] * 9, pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for did, dk, raw, wanted in zip(*(batch[c].to_pylist() for c in ("did", "dk", "raw", "wanted")), strict=True):
                for x in wanted:
                    key, start = x["key"], x["start"]
                    # ``lo`` and ``hi`` count windows of the segment, ``offset`` the anchor's bytes from its start.
                    offset = x["offset"]
                    for c in range((offset - x["hi"] + 1) // chunk, (offset - x["lo"]) // chunk + 1):
                        lo, hi = max(x["lo"], offset - (c + 1) * chunk + 1), min(x["hi"], offset - c * chunk + 1)
                        core = raw[start + offset - c * chunk : start + offset - (c + 1) * chunk + 1 + window]
                        dealt = xxhash.xxh3_64_intdigest(core, seed=(key + c) % (1 << 64)) - (1 << 63)
                        same = _same(raw[start + lo : start + hi - 1 + window], offset - lo)
                        for column, value in zip(rows, (did, dk, start, key, x["seg"], dealt, lo, hi, offset, x["alone"], same), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)

    return run


def _fetch(window: int):
    """Bytes of the wanted windows of each document."""
    names = ["dealt", "key", "seg", "first", "offset", "alone", "data"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for raw, wanted in zip(batch["raw"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                for x in wanted:
                    data = raw[x["start"] + x["lo"] : x["start"] + x["hi"] - 1 + window]
                    for column, value in zip(rows, (x["dealt"], x["key"], x["seg"], x["lo"], x["offset"] - x["lo"], x["alone"], data), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)

    return run


def _counted(pieces: DataFrame) -> DataFrame:
    """Distinct strings of pieces: how many segments hold each, and one place of it."""
    place = F.struct("did", "dk", "start", "key", "seg", "lo", "hi", "offset", "alone")
    return pieces.withColumn("at", F.col("offset") - F.col("lo")).groupBy("dealt", "at", "same").agg(F.count("*").alias("held"), F.min(place).alias("one"))


def _repeating(pieces: DataFrame, counted: DataFrame) -> DataFrame:
    """Windows of the pieces whose whole string is held by several segments."""
    several = counted.where("held > 1").select("dealt", "at", "same")
    return pieces.where("alone").withColumn("at", F.col("offset") - F.col("lo")).join(several, ["dealt", "at", "same"]).select("key", "seg", "lo", "hi")


def _places(wanted: DataFrame, *fields: str) -> DataFrame:
    return wanted.groupBy("did", "dk").agg(F.collect_list(F.struct(*fields)).alias("wanted"))


def divide(base: DataFrame, shared: DataFrame, window: int, hot: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(strings to gather by ``dealt``, windows found by counting alone).

    Anchors with more than ``hot`` distinct segments are divided into chunks of windows. Equal
    strings are counted first and only distinct ones are gathered; where more than ``hot`` of those
    meet, their windows are counted one by one instead, so no gathered group has more than ``hot``.
    """
    texts = base.dropDuplicates(["did", "dk"])
    split = lambda wanted, size: texts.join(wanted, ["did", "dk"]).mapInArrow(_split(window, size), _PIECE_TYPES)
    segment = shared.where("distinct > 1").withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("windows"), "alone": F.col("n") == 1})
    pieces = settle(split(_places(segment.where(F.col("distinct") > hot), "key", "seg", "start", "lo", "hi", "offset", "alone"), chunk), "repeats-pieces")
    counted = settle(_counted(pieces), "repeats-counted")
    groups = counted.groupBy("dealt").agg(F.count("*").alias("strings")).where("strings > 1")
    distinct = counted.join(groups, "dealt").select("dealt", "strings", "one.did", "one.dk", "one.start", "one.key", "one.seg", "one.lo", "one.hi", "one.offset", (F.col("one.alone") & (F.col("held") == 1)).alias("alone"))
    windows = settle(split(_places(distinct.where(F.col("strings") > hot), "key", "seg", "start", "lo", "hi", "offset", "alone"), 1), "repeats-windows")
    fields = ("dealt", "key", "seg", "start", "lo", "hi", "offset", "alone")
    gather = segment.where(F.col("distinct") <= hot).withColumn("dealt", F.col("key")).select("did", "dk", *fields).unionByName(distinct.where(F.col("strings") <= hot).select("did", "dk", *fields))
    data = texts.join(_places(gather, *fields), ["did", "dk"]).select("raw", "wanted").mapInArrow(_fetch(window), "dealt long, key long, seg long, first long, offset long, alone boolean, data binary")
    return data, _repeating(pieces, counted).union(_repeating(windows, _counted(windows)))


def _transform(window: int):
    """Repeated windows of a partition's segments, in collections that end between two anchors."""

    def collection(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        found = repeated_windows([r[6] for r in rows], [r[4] for r in rows], window) if len(rows) > 1 else None
        if found is not None:
            for row, flags in zip(rows, found, strict=True):
                if row[5] and flags.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                    for lo, hi in edges.reshape(-1, 2).tolist():
                        for column, value in zip(out, (row[1], row[2], row[3] + lo, row[3] + hi), strict=True):
                            column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "seg", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(batch[i].to_pylist() for i in range(7)), strict=True):
                if held > COLLECTION_BYTES // 2 and row[0] != last:
                    yield collection(rows)
                    rows, held = [], 0
                rows.append(row)
                held, last = held + len(row[6]), row[0]
        yield collection(rows)

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, raw, spans in zip(batch["doc_id"].to_pylist(), batch["raw"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                removed, at, kept, runs = 0, 0, hashlib.sha256(), []
                for x in sorted((x["lo"], x["hi"] - 1 + window) for x in spans or ()):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                for lo, hi in runs:
                    kept.update(raw[at:lo])
                    removed, at = removed + hi - lo, hi
                kept.update(raw[at:])
                for column, value in zip(rows, (doc, len(raw), removed, runs, kept.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch["doc_id"], "n_bytes": pa.array(rows[1], pa.int64()), "n_removed": pa.array(rows[2], pa.int64()), "n_spans": pa.array([len(x) for x in rows[3]], pa.int64()), "kept_sha256": pa.array(rows[4], pa.string()), "spans": pa.array(rows[3], pa.list_(pa.list_(pa.int64())))}
            )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT_SEGMENTS, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte is removed when a ``window``-byte string that covers it starts at any other place,
    in the same or another document; ``spans`` lists the removed runs as [from, to) in UTF-8
    bytes and ``kept_sha256`` is the digest of what is left. Null is the empty text; shorter
    texts repeat nothing. A null ``doc_id`` stays null; repeated rows repeat each other's text
    and so lose it; an empty table gives no rows; other columns are ignored.
    """
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), raw.alias("raw"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63) + 1)).alias("did"), F.xxhash64("raw").alias("dk"), "raw")
    cut = settle(base.select("did", "dk", "raw").mapInArrow(_cut(window, gram), "did long, dk long, start long, windows long, offset long, key long, seg long"), "repeats-cut")
    distinct = cut.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("did", "dk", "start", "windows", "offset")).alias("at"))
    anchors = distinct.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).where("total > 1")
    shared = settle(distinct.join(anchors, "key").select("key", "seg", "n", "distinct", "at.*"), "repeats-shared")
    data, counted = divide(base, shared, window, hot, chunk)
    partly = data.repartition("dealt").sortWithinPartitions("dealt").mapInArrow(_transform(window), "key long, seg long, lo long, hi long")
    whole = shared.where("n > 1").select("key", "seg", F.lit(0).cast("long").alias("lo"), F.col("windows").alias("hi"))
    places = cut.select("did", "dk", "start", "key", "seg").join(whole.union(partly).union(counted), ["key", "seg"])
    spans = places.groupBy("did", "dk").agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    return base.join(spans, ["did", "dk"], "left").select("doc_id", "raw", "spans").mapInArrow(
        _remove(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
