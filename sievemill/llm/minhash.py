"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first places a shingle in a universe
of 2**20 positions, the second, read circularly from that position, gives one value per
coordinate; the signature is the minimum over the shingles. Documents that share a band meet in
a bucket. A first round verifies every member of a few bands' buckets against the one that meets
the most others, on full shingle sets, and joins what is linked. A bucket whose members are all
connected is done. For the rest, sets that reach the threshold share one of their rarest shingles
(as many as may be missing, and one), so only members that share such a shingle are compared:
pairs become rows where few hold it, and shingles that many hold are compared in pairs of blocks of
bounded size, which give only links that connect something new. So no link between different
texts is lost and no group is ever written out as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import components, settle, table

WORDS, COORDINATES, BANDS, BITS, SEED = 5, 160, 32, 20, 20241
#: Bands that the first round takes; holders of a rare shingle that are paired; shingles of a block.
FIRST_BANDS, PAIR_MEMBERS, BLOCK_SHINGLES = 4, 64, 500_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MEMO_WORDS = 400_000


class _WordHashes(dict):
    """64-bit hash of each word seen; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORD_HASHES = _WordHashes()
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_WORD_HASHES.__getitem__, found)), np.uint64)
    size = min(words, len(found))
    out = np.full(len(h) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
        return np.unique(mix(out))


@lru_cache(maxsize=2)
def _circle(bits: int, coordinates: int, seed: int) -> np.ndarray:
    """The second permutation, with its start repeated behind its end, as windows of one row per position."""
    order = np.random.default_rng(seed).permutation(1 << bits).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit shingles."""
    circle = _circle(bits, coordinates, seed)
    with np.errstate(over="ignore"):
        at = (mix(shingles ^ np.uint64(seed)) >> np.uint64(64 - bits)).astype(np.int64)
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(out, circle[at[i : i + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of the signature."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(rows.shape[1]):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + rows[:, i])
    return out.view(np.int64)


def _signed(words: int, coordinates: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, same, keys = [], [], []
            for text in batch["text"].to_pylist():
                shingles = shingle_set(text, words)
                size.append(len(shingles))
                same.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None)
                keys.append(band_keys(signature(shingles, coordinates), bands) if len(shingles) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_shingles": pa.array(size, pa.int64()), "same": pa.array(same, pa.string()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words).view(np.int64) for text in batch["text"].to_pylist()]
            same = [xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_pydict({"same": pa.array(same, pa.string()), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return run


def _block_links(percent: int):
    """Links between components that full sets confirm, as a spanning forest of a pair of blocks."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        block, component = np.array(group["block"].to_pylist()), np.array(group["component"].to_pylist(), np.int64)
        flat = group["shingles"].combine_chunks()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        values, cuts = flat.values.to_numpy(), flat.offsets.to_numpy()
        codes = np.unique(values[cuts[0] : cuts[-1]], return_inverse=True)[1]
        cuts = cuts - cuts[0]
        size, marked = np.diff(cuts), np.zeros(len(codes), bool)
        last, found = block == y, []
        # The largest component needs no turn of its own where both sides are the same block.
        largest = np.bincount(np.unique(component, return_inverse=True)[1]).max() if len(component) else 0
        names, counts = np.unique(component, return_counts=True)
        skip = names[counts == largest][0] if len(names) and x == y else None
        own = component.copy()
        for i in np.flatnonzero(block == x):
            if own[i] == skip or not (last & (component != component[i])).any():
                continue
            mine = codes[cuts[i] : cuts[i + 1]]
            marked[mine] = True
            common = np.add.reduceat(marked[codes], cuts[:-1], dtype=np.int64)
            marked[mine] = False
            linked = np.flatnonzero(last & (component != component[i]) & (100 * common >= percent * (size + size[i] - common)))
            for j in linked:
                if component[j] != component[i]:
                    found.append((own[i], own[j]))
                    component[component == component[j]] = component[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose full sets confirm the link."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).drop("sa", "sb")


def _rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, component): shingles of which linked members hold at least one in common.

    In one order of all shingles, rarest first, a set of n that needs ``need`` common ones can miss
    n - need of them, so the first n - need + 1 hold one. Those held once pair nothing and go.
    """
    tokens = sets.join(members.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    ranked = tokens.join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("found"))
    need = F.expr(f"int((n * {int(percent)} + 99) div 100)")
    taken = ranked.join(members, "id").withColumn("take", F.size("found") + 1 - need).where("take > 0")
    return taken.select(F.explode(F.slice("found", F.lit(1), F.col("take"))).alias("one"), "id", "n", "component").select("one.token", "id", "n", "component")


def _open_links(members: DataFrame, sets: DataFrame, percent: int, pair_members: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between components of ``members`` (id, n, component) that their sets confirm."""
    rare = settle(_rare_shingles(members, sets, percent), "minhash-rare")
    holders = rare.groupBy("token").agg(
        F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y")
    )
    # Shingles with the same holders give the same pairs: one of them is enough.
    holders = holders.where("low < high").groupBy("members", "x", "y").agg(F.min(F.struct("token", "low")).alias("one"))
    rare = settle(rare.join(holders.select("one.token", "one.low", "members"), "token"), "minhash-held")
    few = rare.where(F.col("members") <= pair_members)
    left, right = few.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")), few.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    paired = _linked(pairs.select("a", "b", "ca", "cb").distinct(), sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    many = rare.where(F.col("members") > pair_members)
    group = components(many.select(F.col("component").alias("a"), F.col("low").alias("b")).distinct(), "minhash-groups").toDF("component", "group")
    many = many.select("id", "n", "component").distinct().join(group, "component")
    blocks = many.groupBy("group").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"))
    many = many.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = many.select("id", "component", "group", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return paired.union(many.join(sets, "id").groupBy("group", "x", "y").applyInArrow(_block_links(percent), "a long, b long"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 85, coordinates: int = COORDINATES, bands: int = BANDS, pair_members: int = PAIR_MEMBERS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    ``component_id`` is the smallest ``doc_id`` reachable over links and ``kept`` marks it.
    Texts with equal sets count as one class before candidates are sought. Rows that share a
    ``doc_id`` are one document with several texts, so they are linked whatever they say; all of its
    rows have its component and ``kept``. Null and empty texts have no shingles and link with nothing
    but texts of the same document; a row without ``doc_id`` is linked with nothing, has a null
    component and is kept. Repeated rows give repeated results; an empty table gives none; other
    columns are ignored.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = settle(texts.mapInArrow(_signed(words, coordinates, bands), "doc_id long, n_shingles long, same string, bands array<long>"), "minhash-signed")
    told = signed.where("doc_id IS NOT NULL AND same IS NOT NULL").withColumn("id", F.xxhash64("same"))
    classes = settle(told.groupBy("id").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
    rows = classes.select("id", "n", F.posexplode("bands").alias("at", "band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    active = settle(rows.join(shared, "band"), "minhash-active")
    ids = settle(active.groupBy("id").agg(F.sum("members").alias("met")), "minhash-ids")
    docs_read = classes.join(ids, "id", "left_semi").select(F.col("doc").alias("doc_id")).distinct()
    found = texts.join(docs_read, "doc_id", "left_semi").mapInArrow(_sets(words), "same string, shingles array<long>")
    sets = settle(found.where("same IS NOT NULL").select(F.xxhash64("same").alias("id"), "shingles").dropDuplicates(["id"]), "minhash-sets")
    # First the bulk: in a few bands, the member of each bucket that meets the most others against the rest.
    first = active.where(F.col("at") < FIRST_BANDS).join(ids, "id")
    lead = first.groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("met"), "id", "n")).alias("lead")).select("band", F.col("lead.id").alias("a"), F.col("lead.n").alias("na"))
    pairs = first.join(lead, "band").where((F.col("id") != F.col("a")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na"))).select("a", F.col("id").alias("b")).distinct()
    links = _linked(pairs, sets, percent)
    place = settle(ids.select("id").join(components(links, "minhash-first"), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "minhash-place")
    # Then what that left open: buckets that hold several components.
    now = active.join(place, "id")
    open_ = now.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    members = settle(now.join(open_, "band").select("id", "n", "component").distinct(), "minhash-open")
    more = _open_links(members, sets, percent, pair_members, block_shingles)
    merged = components(more, "minhash-last").toDF("component", "root")
    place = place.join(merged, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    # A component is called by its smallest document; texts of one document then join their components.
    owned = place.join(classes.select("id", "doc"), "id")
    least = owned.groupBy("component").agg(F.min("doc").alias("least"))
    named = classes.select("id", "doc").join(place.join(least, "component").select("id", "least"), "id", "left").select("id", F.coalesce("least", "doc").alias("least"))
    doc_links = settle(told.select("id", "doc_id").join(named, "id").select("doc_id", "least").distinct(), "minhash-least")
    several = doc_links.groupBy("doc_id").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b").select("doc_id", "a")
    joined = components(doc_links.join(several, "doc_id").select(F.col("least").alias("a"), F.col("a").alias("b")), "minhash-docs").toDF("least", "root")
    known = doc_links.groupBy("doc_id").agg(F.min("least").alias("least")).join(joined, "least", "left").select("doc_id", F.coalesce("root", "least").alias("component"))
    return signed.select("doc_id", "n_shingles").join(known, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 100 * n >= 85 * (len(x.sh) + len(y.sh) - n)),
r AS (WITH RECURSIVE reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b) SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN r ON r.a = s.doc_id
"""
