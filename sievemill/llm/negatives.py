"""Hard negatives by segment summaries.

Every vector is cut into segments of equal length, and each segment keeps its mean and deviation. For
two segments of m components the inner product lies between m * (mean * mean - dev * dev) and
m * (mean * mean + dev * dev), so the sums over all segments bound a score from both sides without
its components. Coarse segments are made from the stored fine ones; pairs that the coarse bounds leave
open are looked at with finer segments, and only what is open after that is scored exactly.

Anchors are a stated query set. They are dealt into blocks of a bounded size, a block is broadcast, and
the table of all rows is scanned where it lies: no vector is shuffled and no list of pairs is made. A
task keeps the best rows of each anchor so far, whose worst score is the threshold of what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.llm.common import settle, table

#: Segments of the stored summaries, and the numbers that bounds are taken at, coarse to fine.
SEGMENTS = 16
LEVELS = (4, 16)
#: Anchors of a block, on average: with 64 components about 4 MB are broadcast.
BLOCK_ANCHORS = 4096
#: Pairs that a task looks at in one step; first steps are smaller so that thresholds come early.
STEP_PAIRS = 1 << 21
#: Products below this are exact in double precision; beyond it integers are multiplied.
_EXACT, _MOST = 2.0**52, 1 << 62
_SUMMED = "rid long, vec_id long, label int, asks boolean, vector array<long>, means array<double>, devs array<double>"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column, asks: Column, scale: int) -> DataFrame:
    """rid, vec_id, label, asks, vector: the rows that take part, with components ``floor(scale * x)``."""
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("int").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(f"`{vector_col}`").cast("array<double>").alias("raw"))
    finite = F.forall("raw", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is above all numbers
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & finite)
    return rows.select("rid", "vec_id", "label", "asks", F.transform("raw", lambda v: F.floor(v * scale)).alias("vector"))


def summarise(vectors: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of ``segments`` equal segments of each row, the last ones filled up with zeros."""
    n, d = vectors.shape
    size = max(1, -(-d // segments))
    full = np.zeros((n, segments * size))
    full[:, :d] = vectors
    full = full.reshape(n, segments, size)
    means = full.mean(axis=2)
    return means, np.sqrt(np.maximum((full**2).mean(axis=2) - means**2, 0))


def coarser(means: np.ndarray, devs: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of ``segments`` segments from those of a multiple of as many."""
    n = len(means)
    m = means.reshape(n, segments, -1)
    mean = m.mean(axis=2)
    return mean, np.sqrt(np.maximum((devs.reshape(m.shape) ** 2 + m**2).mean(axis=2) - mean**2, 0))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, n = batch["vector"], batch.num_rows
        sizes = np.diff(vectors.offsets.to_numpy())
        means, devs = np.zeros((n, SEGMENTS)), np.zeros((n, SEGMENTS))
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            means[at], devs[at] = summarise(_matrix(vectors.take(pa.array(at)), d).astype(float))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SEGMENTS).cast(pa.list_(pa.float64())) for x in (means, devs)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "means", "devs"])


def _matrix(lists: pa.ListArray, d: int) -> np.ndarray:
    """The rows of ``lists``, all of length ``d``, as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


class Side:
    """Rows of one length: ids, labels, vectors, and their summaries at each level, scaled for products."""

    def __init__(self, data: pa.RecordBatch, at: np.ndarray, d: int) -> None:
        take = data.take(pa.array(at))
        self.at = at
        self.rid, self.vec_id, self.label = (take[c].to_numpy(zero_copy_only=False) for c in ("rid", "vec_id", "label"))
        self.ints = _matrix(take["vector"], d)
        self.floats = self.ints.astype(float)
        self.norm = np.sqrt((self.floats**2).sum(axis=1))
        means, devs = (_matrix(take[c], SEGMENTS) for c in ("means", "devs"))
        self.levels = []
        for n in LEVELS:
            root = np.sqrt(max(1, -(-d // SEGMENTS)) * SEGMENTS / n)
            self.levels.append(tuple(root * x for x in coarser(means, devs, n)))

    @staticmethod
    def by_length(data: pa.RecordBatch, only: set[int] | None = None) -> dict[int, Side]:
        sizes = np.diff(data["vector"].offsets.to_numpy())
        return {int(d): Side(data, np.flatnonzero(sizes == d), int(d)) for d in np.unique(sizes) if only is None or int(d) in only}


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows (i, j), by the full product where many pairs are wanted."""
    if len(i) * 8 > len(x) * len(y):
        return (x @ y.T)[i, j]
    out, part = np.empty(len(i), x.dtype), 1 << 16
    for k in range(0, len(i), part):
        out[k : k + part] = np.einsum("ij,ij->i", x[i[k : k + part]], y[j[k : k + part]])
    return out


def _first(k: int, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each group, by the keys of ``order`` (the most important first)."""
    by = np.lexsort((*reversed(order), group))
    start = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
    return by[place < k]


class Search:
    """The best rows of each anchor and slot seen so far.

    A slot wants the ``k`` best scores from ``low`` to ``high``; an empty slot has ``low`` above
    ``high``. ``same``: only rows of the anchor's label, else only others. Higher scores come first,
    then smaller ids. ``looked`` counts the pairs open at first, after each level, and those scored.
    """

    def __init__(self, anchors: Side, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.anchors, self.same, self.k = anchors, same, k
        self.low, self.high = np.where(low <= high, low, _MOST), np.where(low <= high, high, -_MOST)
        self.worst = np.full(low.shape, -_MOST)
        self.kept = [np.empty(0, np.int64) for _ in range(5)]  # anchor, slot, score, vec_id, rid
        self.looked = [0] * (len(LEVELS) + 1)

    def look(self, rows: Side, a: int, b: int) -> None:
        """Take the rows from ``a`` to ``b`` into account."""
        need = np.maximum(self.low, self.worst)
        floor, top = need.min(axis=1), self.high.max(axis=1)
        live = ((self.anchors.label[:, None] == rows.label[None, a:b]) == self.same) & (floor <= top)[:, None]
        i, j = np.nonzero(live & (self.anchors.rid[:, None] != rows.rid[None, a:b]))
        self.looked[0] += len(i)
        for at, ((mean, dev), (row_mean, row_dev)) in enumerate(zip(self.anchors.levels, rows.levels, strict=True)):
            middle = _products(mean, row_mean[a:b], i, j)
            reach = _products(dev, row_dev[a:b], i, j)
            reach += 1e-9 * (self.anchors.norm[i] * rows.norm[a:b][j] + 1)  # sums of doubles are rounded
            open_ = (middle + reach >= floor[i]) & (middle - reach <= top[i])
            i, j = i[open_], j[open_]
            self.looked[at + 1] += len(i)
        score = self._scores(i, rows, a, b, j)
        pair, slot = np.nonzero((score[:, None] >= need[i]) & (score[:, None] <= self.high[i]))
        if len(pair):
            self._keep(i[pair], slot, score[pair], rows.vec_id[a:b][j[pair]], rows.rid[a:b][j[pair]])

    def _scores(self, i: np.ndarray, rows: Side, a: int, b: int, j: np.ndarray) -> np.ndarray:
        most = self.anchors.norm.max(initial=0) * rows.norm[a:b].max(initial=0)
        if most < _EXACT:
            return _products(self.anchors.floats, rows.floats[a:b], i, j).astype(np.int64)
        if most < _MOST:
            return _products(self.anchors.ints, rows.ints[a:b], i, j)
        raise OverflowError("components are too large: a score does not fit a long")

    def _keep(self, *new: np.ndarray) -> None:
        both = [np.concatenate(x) for x in zip(self.kept, new, strict=True)]
        group = both[0] * self.low.shape[1] + both[1]
        keep = _first(self.k, group, -both[2], both[3], both[4])
        self.kept, group = [x[keep] for x in both], group[keep]
        worst = np.full(self.low.size, _MOST)
        np.minimum.at(worst, group, self.kept[2])
        full = np.bincount(group, minlength=self.low.size) == self.k
        self.worst = np.where(full, worst, -_MOST).reshape(self.low.shape)


def _scan(block, same: bool, k: int):
    """A task's best rows of every anchor of the block, for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, low, high = block.value
        searches = {d: Search(side, same, low[side.at], high[side.at], k) for d, side in Side.by_length(data).items()}
        pairs = 1 << 15
        for batch in batches:
            for d, rows in Side.by_length(batch, set(searches)).items():
                a = 0
                while a < len(rows.rid):
                    b = min(len(rows.rid), a + max(1, pairs // len(searches[d].anchors.rid)))
                    searches[d].look(rows, a, b)
                    a, pairs = b, min(STEP_PAIRS, 2 * pairs)
        for search in searches.values():
            i, slot, score, vec_id, rid = search.kept
            yield pa.RecordBatch.from_pydict({"anchor": search.anchors.rid[i], "slot": slot.astype(np.int32), "score": score, "vec_id": vec_id, "rid": rid})

    return run


def _search(rows: DataFrame, data: pa.RecordBatch, same: bool, low: np.ndarray, high: np.ndarray, k: int, label: str) -> DataFrame:
    """anchor, slot, rank, vec_id, score: the first ``k`` rows of each slot of a block of anchors."""
    block = rows.sparkSession.sparkContext.broadcast((data, low, high))
    parts = rows.mapInArrow(_scan(block, same, k), "anchor long, slot int, score long, vec_id long, rid long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "rid")
    best = settle(parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("anchor", "slot", "rank", "vec_id", "score"), label)
    block.unpersist()
    return best


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", is_anchor: Column | None = None, positives: int = 5, negatives: int = 10, span: tuple[int, int] = (30, 90), scale: int = 256, block_anchors: int = BLOCK_ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    An anchor's positives are its first ``positives`` other rows of its label; the negatives of a
    positive are the first ``negatives`` rows of other labels whose score lies between the two parts
    of a hundred (``span``) of the positive's score, both included. Scores are inner products of the
    components ``floor(scale * x)``; higher ones come first, ties by smaller id. ``is_anchor`` is a
    condition over the columns of ``vectors`` (none: every row is an anchor). An anchor without
    positives, or a positive without negatives, gives no row.

    Rows with a null id, label or vector or with a null or non-finite component take no part. Rows
    that repeat an id are rows of their own. Vectors of different lengths are never compared. Of an
    empty table there are no rows. Scores that don't fit a long are an error. Other columns, whatever
    their names, are ignored.

    Each block of anchors scans the table twice; the work is anchors times rows, less what the
    bounds rule out.
    """
    spark = vectors.sparkSession
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = quantised(vectors, id_col, vector_col, label, F.lit(True) if is_anchor is None else is_anchor, scale)
    rows = settle(rows.mapInArrow(_summaries, _SUMMED), "negatives-rows")
    asking = rows.where("asks")
    blocks = max(1, -(-asking.count() // block_anchors))
    if blocks > 1:
        asking = settle(asking.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks))), "negatives-anchors")
    out = []
    for n in range(blocks):
        mine = asking.where(F.col("block") == n) if blocks > 1 else asking
        found = mine.select("rid", "vec_id", "label", "vector", "means", "devs").toArrow().combine_chunks()
        if not found.num_rows:
            continue
        data = found.to_batches()[0]
        shape = (data.num_rows, 1)
        best = _search(rows, data, True, np.full(shape, -_MOST + 1), np.full(shape, _MOST - 1), positives, "negatives-positives")
        low, high = np.ones((data.num_rows, positives), np.int64), np.zeros((data.num_rows, positives), np.int64)
        place = {rid: at for at, rid in enumerate(data["rid"].to_pylist())}
        for r in best.select("anchor", "rank", "score").collect():
            low[place[r.anchor], r["rank"] - 1] = -(-span[0] * r.score // 100)
            high[place[r.anchor], r["rank"] - 1] = span[1] * r.score // 100
        pairs = best.join(mine.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        pairs = pairs.select("anchor", (F.col("rank") - 1).alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out.append(_search(rows, data, False, low, high, negatives, "negatives-found").join(pairs, ["anchor", "slot"]))
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, out).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    flipped = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=flipped, is_anchor=vec_id % 100 == 0)


ORACLE = r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
      FROM v a JOIN v c ON a.rid <> c.rid AND len(a.q) = len(c.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, vec_id, rid)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""
