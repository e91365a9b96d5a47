"""Exact deduplication with Patricia-trie owners.

Each Arrow batch of the scan first merges its own copies in a radix trie, so a text that a third
of all rows hold leaves one row per batch. What is left is partitioned by length and content
hash; each partition inserts the full byte strings into a radix trie whose terminal nodes hold
the smallest identifier. Texts are compared byte by byte; hashes only deal out the work.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.llm.common import settle, table

_TO_SPACE = bytes(0x20 if 9 <= b <= 13 else b for b in range(256))


def squeeze(raw: bytes) -> bytes:
    """Replace each run of ASCII white space by one space."""
    out = raw.translate(_TO_SPACE)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


class PatriciaTrie:
    """A compressed radix trie over byte strings; each terminal node holds one value.

    A node is a list [label, children by first byte or None, value or None].
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def put(self, key: bytes, fresh) -> object:
        """The value stored under ``key``; ``fresh`` is stored and returned for a new key."""
        node, at = self.root, 0
        while at < len(key):
            if node[1] is None:
                node[1] = {}
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], None, fresh]
                return fresh
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _shared(label, key, at)
            middle = [label[:shared], {label[shared]: child}, None]
            child[0] = label[shared:]
            node[1][key[at]] = middle
            node, at = middle, at + shared
        if node[2] is None:
            node[2] = fresh
        return node[2]

    def items(self, first: int | None = None) -> Iterator[tuple[bytes, object]]:
        """(key, value) of every terminal node; ``first``: only below that first byte."""
        todo = [(b"", self.root)] if first is None else [(b"", self.root[1][first])]
        while todo:
            prefix, node = todo.pop()
            prefix += node[0]
            if node[2] is not None:
                yield prefix, node[2]
            todo += [(prefix, child) for child in (node[1] or {}).values()]

    def values(self) -> Iterator[object]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node[2] is not None:
                yield node[2]
            todo += (node[1] or {}).values()

    def drop(self, first: int) -> None:
        del self.root[1][first]


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, which differ somewhere."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class SpillingOwners:
    """Owners and their totals per key, with the heaviest subtree written out when memory is full.

    ``add`` takes a key below a common prefix of ``depth`` bytes. An owner is (doc_id is null,
    doc_id, rid). With ``smallest`` a terminal node holds the smallest owner and the total of all,
    however many there are; else it holds every owner. Spilled subtrees lie in temporary files of
    the task and are worked off one by one; a task that is lost begins anew from its input.
    """

    HEAD = struct.Struct("<I?qqq")

    def __init__(self, memory: int, depth: int = 0, smallest: bool = False) -> None:
        self.memory, self.depth, self.smallest = memory, depth, smallest
        self.trie, self.held, self.weight, self.out = PatriciaTrie(), 0, {}, {}

    def add(self, key: bytes, owner: tuple, n: int) -> None:
        first = key[self.depth] if len(key) > self.depth else None
        if first in self.out:
            self._write(first, key, owner, n)
            return
        entry = self.trie.put(key[self.depth :], fresh := [])
        if self.smallest and entry:
            entry[0] = (min(entry[0][0], owner), entry[0][1] + n)
        else:
            entry.append((owner, n))
        if entry is fresh:
            cost = len(key) + 400
            self.held += cost
            self.weight[first] = self.weight.get(first, 0) + cost
            if self.held > self.memory:
                self._spill(key[: self.depth])

    def _spill(self, prefix: bytes) -> None:
        first = max((k for k in self.weight if k is not None), key=self.weight.get, default=None)
        if first is None:
            return
        self.out[first] = [tempfile.TemporaryFile(), None]  # noqa: SIM115
        for rest, entry in self.trie.items(first):
            for owner, n in entry:
                self._write(first, prefix + rest, owner, n)
        self.trie.drop(first)
        self.held -= self.weight.pop(first)

    def _write(self, first: int, key: bytes, owner: tuple, n: int) -> None:
        file = self.out[first]
        file[0].write(self.HEAD.pack(len(key), owner[0], owner[1], owner[2], n))
        file[0].write(key)
        file[1] = key if file[1] is None else os.path.commonprefix([file[1], key])

    def keyed(self, prefix: bytes = b"") -> Iterator[tuple[bytes, list[tuple[tuple, int]]]]:
        """Each distinct key with its list of (owner, n)."""
        for rest, entry in self.trie.items():
            yield prefix + rest, entry
        self.trie = PatriciaTrie()
        for file, shared in self.out.values():
            below = SpillingOwners(self.memory, len(shared), self.smallest)
            file.seek(0)
            while head := file.read(self.HEAD.size):
                size, *owner, n = self.HEAD.unpack(head)
                below.add(file.read(size), tuple(owner), n)
            file.close()
            yield from below.keyed(shared)

    def groups(self) -> Iterator[list[tuple[tuple, int]]]:
        """For each distinct key its list of (owner, n)."""
        return (entry for _, entry in self.keyed())


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the copies within each batch: every row gets its batch's owner."""
    for batch in batches:
        if not batch.num_rows:
            continue
        trie, rids, ids = PatriciaTrie(), batch["rid"].to_pylist(), batch["doc_id"].to_pylist()
        owner, total, size, key, sha = [0] * len(rids), [0] * len(rids), [], [], []
        for i, raw in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
            text = squeeze(raw or b"")
            digest = hashlib.sha256(text)
            size.append(len(text))
            key.append(int.from_bytes(digest.digest()[:8], "little", signed=True))
            sha.append(digest.hexdigest())
            trie.put(text, []).append(i)
        for members in trie.values():
            best = min(members, key=lambda i: (ids[i] is None, ids[i] or 0, rids[i]))
            total[best] = len(members)
            for i in members:
                owner[i] = rids[best]
        owns = pa.array([n > 0 for n in total])
        kept = {c: pc.if_else(owns, batch[c], pa.scalar(None, batch[c].type)) for c in batch.schema.names if c.startswith("carry_")}
        yield pa.RecordBatch.from_pydict(
            {"rid": batch["rid"], "owner_rid": pa.array(owner, pa.int64()), "doc_id": batch["doc_id"], "copies": pa.array(total, pa.int64()), "size": pa.array(size, pa.int64()), "key": pa.array(key, pa.int64()), "text_sha256": pa.array(sha, pa.string())} | kept
        )


def _owners(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = SpillingOwners(memory, smallest=True)
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            for raw, doc, rid, n in zip(texts, batch["doc_id"].to_pylist(), batch["rid"].to_pylist(), batch["copies"].to_pylist(), strict=True):
                owners.add(squeeze(raw or b""), (doc is None, doc or 0, rid), n)
        rows: list[list] = [[], [], [], []]
        for text, [((no_id, keep, rid), total)] in owners.keyed():
            for column, value in zip(rows, (hashlib.sha256(text).hexdigest(), rid, None if no_id else keep, total), strict=True):
                column.append(value)
            if len(rows[0]) >= 50_000:
                yield _mapping(rows)
                rows = [[], [], [], []]
        yield _mapping(rows)

    return run


def _mapping(rows: list[list]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["text_sha256", "keep_rid", "keep_id", "group_size"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), trie_bytes: int = 192 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows with their batch's owner, and the groups of equal texts: text_sha256, keep_rid, keep_id, group_size.

    ``trie_bytes`` bounds what a task's trie holds before it writes out its heaviest subtree.
    """
    schema = T.StructType(
        [T.StructField("rid", T.LongType()), T.StructField("owner_rid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("size", T.LongType()), T.StructField("key", T.LongType()), T.StructField("text_sha256", T.StringType())]
        + [T.StructField("carry_text", T.StringType())] + [T.StructField(f"carry_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    )
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), text.alias("carry_text"), *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    )
    rows = settle(rows.mapInArrow(_copies, schema), "exact-rows")
    owners = rows.where("copies > 0").select("rid", "doc_id", "copies", "size", "key", F.col("carry_text").alias("text")).repartition("size", "key")
    return rows, owners.mapInArrow(_owners(trie_bytes), "text_sha256 string, keep_rid long, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 192 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null is
    the empty text. Of equal texts the row with the smallest ``doc_id`` stays; rows without one
    come last, and of rows with the same ``doc_id`` the first stays. An empty table gives no rows.
    Other columns, whatever their names, are ignored.
    """
    rows, groups = exact_groups(docs, id_col, text_col, trie_bytes=trie_bytes)
    # Owners, one per batch and text, find their group by its digest; rows then find their owner.
    places = rows.where("copies > 0").select(F.col("rid").alias("owner_rid"), "text_sha256").join(groups, "text_sha256").drop("text_sha256")
    return rows.select("rid", "owner_rid", "doc_id", "text_sha256").join(places, "owner_rid").select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that ``exact_dedup`` keeps.

    Nulls, ties and repeated rows count as there; an empty table gives none; all columns are kept.
    """
    others = [c for c in docs.columns if c != text_col]
    rows, groups = exact_groups(docs, id_col, text_col, carry=others)
    kept = groups.select(F.col("keep_rid").alias("rid"))
    names = {c: f"carry_{i}" for i, c in enumerate(others)} | {text_col: "carry_text"}
    return rows.where("copies > 0").join(kept, "rid", "left_semi").select(*[F.col(names[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
