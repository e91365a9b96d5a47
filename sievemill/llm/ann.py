"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit
vector; its code is the signed axis it is nearest to. Several tables each put every vector into
one bucket and every query into its best few. Vectors of unequal lengths get one more coordinate,
so that the largest inner product is the smallest angle. How many rotations make a bucket and how
many buckets are probed follows from the recall of a bounded sample of queries, measured against
all vectors. Queries meet a bucket's vectors in blocks of bounded size, where exact scores are
taken; only each block's best go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.llm.common import settle, table

TABLES, BLOCK, SEED = 16, 4096, 11
#: Recall that the sample must reach; queries and other vectors of the sample; most probes of a table.
TARGET, SAMPLE_QUERIES, SAMPLE_VECTORS, MOST_PROBES = 0.95, 64, 500, 2048
#: What a copy of a query and a missed neighbour cost in the choice of settings, in scores of one pair.
COPY_COST, MISS_COST = 200, 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


@lru_cache(maxsize=8)
def _signs(tables: int, functions: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, functions, 3, width))


def width_of(size: int) -> int:
    return 1 << max(1, (size - 1).bit_length())


def axes(x: np.ndarray, tables: int, functions: int, seed: int = SEED) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each table the values of every row on all signed axes of its rotations."""
    width = width_of(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = _signs(tables, functions, width, seed)
    for t in range(tables):
        out = []
        for f in range(functions):
            y = x
            for r in range(3):
                y = hadamard(y * signs[t, f, r])
            out.append(np.concatenate([y, -y], axis=1))
        yield t, out


def own_codes(x: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """(rows, tables, functions) nearest signed axes of unit vectors."""
    return np.stack([np.stack([v.argmax(axis=1) for v in values], axis=1) for _, values in axes(x, tables, functions)], axis=1)


def probe_codes(x: np.ndarray, tables: int, functions: int, probes: int) -> np.ndarray:
    """(rows, tables, probes, functions) axes to look at, best first.

    Probes take the combinations of axes whose squared shortfalls against the nearest ones add up
    to least. Combinations whose ranks multiply to more than ``probes`` can't be among them.
    """
    out = []
    for _, values in axes(x, tables, functions):
        choices = min(probes, values[0].shape[1])
        order = [np.argsort(-v, axis=1, kind="stable")[:, :choices] for v in values]
        loss = [(v.max(axis=1, keepdims=True) - np.take_along_axis(v, o, 1)) ** 2 for v, o in zip(values, order, strict=True)]
        combos = np.arange(choices)[:, None]
        for _ in range(functions - 1):
            combos = np.concatenate([np.column_stack([c, np.full(len(c), i)]) for i in range(choices) if len(c := combos[(combos + 1).prod(axis=1) * (i + 1) <= probes])])
        total = sum(loss[f][:, combos[:, f]] for f in range(functions))
        picked = combos[np.argsort(total, axis=1, kind="stable")[:, :probes]]
        out.append(np.stack([np.take_along_axis(order[f], picked[:, :, f], 1) for f in range(functions)], axis=2))
    return np.stack(out, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit vectors whose angles order inner products: one more coordinate makes up for the length.

    ``longest``: the largest length, or None where all are equal and nothing is to be added.
    """
    if longest is None:
        return unit(x)
    share = np.minimum(np.nan_to_num(np.linalg.norm(x, axis=1) / longest, nan=1.0), 1.0)[:, None]
    return np.concatenate([unit(x) * share, np.sqrt(1 - share * share)], axis=1)


def asking(x: np.ndarray, longest: float | None) -> np.ndarray:
    return unit(x) if longest is None else np.pad(unit(x), ((0, 0), (0, 1)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    return np.concatenate(flat).reshape(sum(map(len, parts)), -1)


def ranks(queries: np.ndarray, nearest: np.ndarray, others: np.ndarray, tables: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, queries, vectors) place of a vector's bucket among the query's probes.

    Once for the true neighbours of each query and once for vectors drawn from all.
    """
    shape = nearest.shape[:2]
    hit, met = np.empty((tables, *shape)), np.empty((tables, len(queries), len(others)))
    given = (axes(x, tables, functions) for x in (queries, nearest.reshape(-1, nearest.shape[2]), others))
    for (t, mine), (_, near), (_, drawn) in zip(*given, strict=True):
        losses = [(v.max(axis=1, keepdims=True) - v) ** 2 for v in mine]
        at = sum(np.take_along_axis(lo, v.argmax(axis=1).reshape(shape), 1) for lo, v in zip(losses, near, strict=True))
        away = sum(lo[:, v.argmax(axis=1)] for lo, v in zip(losses, drawn, strict=True))
        for q in range(len(queries)):
            sums = np.zeros(1)
            for lo in losses:
                sums = np.add.outer(sums, lo[q]).ravel()
                sums = np.sort(np.partition(sums, MOST_PROBES)[:MOST_PROBES] if len(sums) > MOST_PROBES else sums)
            hit[t, q] = np.searchsorted(sums, at[q] - 1e-12)
            met[t, q] = np.searchsorted(sums, away[q] - 1e-12)
    return hit, met


def groups_of(functions: int, n: int, slots: int) -> int:
    """How many keys deal out a table's buckets: all of one rotation, else enough for blocks of usual size."""
    return slots if functions == 1 else min(slots**functions, max(1, -(-n // BLOCK)))


def choose(queries: np.ndarray, nearest: np.ndarray, others: np.ndarray, n: int, tables: int, target: float, functions: int | None = None) -> tuple[int, int, float, float]:
    """(functions, probes, recall, share of vectors met) of the least cost that reaches ``target``.

    ``nearest`` are the true neighbours of each query, ``others`` vectors drawn from all. One
    rotation with all its buckets is the exact search, so some setting always reaches it.
    """
    slots = 2 * width_of(queries.shape[1])
    deepest = 1 + max(1, int(math.log(max(2.0, n / 1024)) / math.log(slots)))
    best = None
    for f in [functions] if functions else range(1, deepest + 1):
        hit, met = ranks(queries, nearest, others, tables, f)
        first = hit.min(axis=0)
        for p in dict.fromkeys(min(MOST_PROBES, slots**f, round(2 ** (i / 4))) for i in range(45)):
            recall = float((first < p).mean())
            if recall >= target:
                copies = tables * min(p, groups_of(f, n, slots))
                cost = float((met < p).sum(axis=0).mean()) * n + COPY_COST * copies + MISS_COST * (1 - recall) * nearest.shape[1]
                if best is None or cost < best[0]:
                    best = cost, f, p, recall, float((met < p).any(axis=0).mean())
    return best[1:] if best else (1, slots, 1.0, 1.0)


def _hashed(tables: int, settings: dict, longest: float | None):
    """Adds each vector's buckets and, for queries, the buckets to look into: [table and axes]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks, buckets, seek = np.array(batch["is_query"].to_pylist(), bool), [None] * batch.num_rows, [None] * batch.num_rows
            sizes = np.array(batch["vec"].value_lengths().to_pylist())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = _matrix(batch["vec"].take(pa.array(rows)))
                slots = 2 * width_of(int(size) + (longest is not None))
                functions, probes, groups = settings.get(int(size)) or (1, slots, slots)
                codes = own_codes(lifted(x, longest), tables, functions)
                bucket, fine = _joined(codes, slots, groups)
                for i, b, r in zip(rows, bucket, fine, strict=True):
                    buckets[i] = [{"code": c, "fine": v} for c, v in zip(b.tolist(), r.tolist(), strict=True)]
                mine = np.flatnonzero(asks[rows])
                if len(mine):
                    bucket, fine = _joined(probe_codes(asking(x[mine], longest), tables, functions, probes), slots, groups)
                    for i, b, r in zip(rows[mine], bucket.reshape(len(mine), -1), fine.reshape(len(mine), -1), strict=True):
                        order = np.lexsort((r, b))
                        cuts = np.flatnonzero(np.diff(b[order])) + 1
                        seek[i] = [{"code": int(b[part[0]]), "fines": r[part].tolist()} for part in np.split(order, cuts)]
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch["vec_id"], "is_query": batch["is_query"], "vec": batch["vec"], "buckets": pa.array(buckets, pa.list_(pa.struct([("code", pa.int64()), ("fine", pa.int64())]))), "seek": pa.array(seek, pa.list_(pa.struct([("code", pa.int64()), ("fines", pa.list_(pa.int64()))])))}
            )

    return run


def _joined(codes: np.ndarray, slots: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, bucket): table and bucket modulo ``groups`` as one number, and the bucket itself."""
    shape = (1, -1) + (1,) * (codes.ndim - 3)
    bucket = np.zeros(codes.shape[:-1], np.int64)
    for f in range(codes.shape[-1]):
        bucket = bucket * slots + codes[..., f]
    return np.arange(codes.shape[1]).reshape(shape) * groups + bucket % groups, bucket


def _top(k: int, query_id: int, q: np.ndarray, members: np.ndarray, member_ids: np.ndarray, near: np.ndarray, out: list[list]) -> None:
    """Append the best ``k`` ids of some members to ``out``, by exact scores; ties go to the smaller id."""
    near = np.where(member_ids == query_id, -np.inf, near)
    low = np.partition(near, -min(k, len(near)))[-min(k, len(near))] if len(near) else -np.inf
    slack = 1e-9 * max(1.0, abs(low)) if np.isfinite(low) else 0.0
    some = np.flatnonzero((near >= low - slack) & (near > -np.inf))
    for some in (some, np.flatnonzero(near > -np.inf)):
        exact = (members[some] * q).sum(axis=1)
        best = np.lexsort((member_ids[some], -exact))
        best = best[np.sort(np.unique(member_ids[some][best], return_index=True)[1])[:k]]
        if len(best) == k:  # else repeated ids took places, and all members are ranked
            break
    out[0] += [query_id] * len(best)
    out[1] += member_ids[some][best].tolist()
    out[2] += exact[best].tolist()


def _nearest(k: int):
    """The best ``k`` of a block's vectors for each of its queries, by exact scores."""

    def run(group: pa.Table) -> pa.Table:
        asks, ids, x = group["is_query"].to_numpy(), group["vec_id"].to_numpy(), _matrix(group["vec"])
        members, member_ids, queries, query_ids = x[~asks], ids[~asks], x[asks], ids[asks]
        out: list[list] = [[], [], []]
        fines = [f.as_py() for f, a in zip(group["fines"], asks, strict=True) if a] if len(members) else []
        fine = group["fine"].to_numpy()[~asks]
        if len(members) and (fine == fine[0]).all() and all(f == [fine[0]] for f in fines):
            for at in range(0, len(queries), 256):
                for i, near in enumerate(queries[at : at + 256] @ members.T, at):
                    _top(k, int(query_ids[i]), queries[i], members, member_ids, near, out)
        elif len(members):
            order = np.argsort(fine, kind="stable")
            members, member_ids, fine = members[order], member_ids[order], fine[order]
            for i, wanted in enumerate(fines):
                lo, hi = np.searchsorted(fine, wanted, "left"), np.searchsorted(fine, wanted, "right")
                some = [np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]
                if some:
                    at = np.concatenate(some)
                    _top(k, int(query_ids[i]), queries[i], members[at], member_ids[at], members[at] @ queries[i], out)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


_FOUND = "query_id long, vec_id long, score double"


def _meet(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per query over the blocks (bucket, block) in which both sides are dealt."""
    none = F.lit(None)
    both = members.select("bucket", "block", F.lit(False).alias("is_query"), "vec_id", "vec", "fine", none.cast("array<long>").alias("fines"))
    both = both.unionByName(queries.select("bucket", "block", F.lit(True).alias("is_query"), "vec_id", "vec", F.lit(0).cast("long").alias("fine"), "fines"))
    found = both.groupBy("bucket", "block").applyInArrow(_nearest(k), _FOUND)
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _exact(queries: list, k: int):
    """The best ``k`` of a batch for each of a few given queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = np.array(batch["vec"].value_lengths().to_pylist()), np.array(batch["vec_id"].to_pylist())
            out: list[list] = [[], [], []]
            for q, v in queries:
                rows = np.flatnonzero(sizes == len(v))
                if len(rows):
                    x = _matrix(batch["vec"].take(pa.array(rows)))
                    _top(k, q, np.array(v), x, ids[rows], x @ np.array(v), out)
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def settings_of(good: DataFrame, k: int, n: int, tables: int, longest: float | None, target: float, functions: int | None) -> dict[int, tuple]:
    """By number of components: (functions, probes, keys of a table, recall, share met).

    Measured on at most ``SAMPLE_QUERIES`` queries, drawn by a hash of their ids, whose true
    neighbours come from one pass over all vectors. Lengths that the sample doesn't hold are
    absent, and searched exactly.
    """
    draw = F.xxhash64("vec_id", F.lit(SEED))
    asked = [(r.vec_id, r.vec) for r in good.where("is_query").dropDuplicates(["vec_id"]).orderBy(draw, "vec_id").limit(SAMPLE_QUERIES).collect()]
    others = [r.vec for r in good.orderBy(F.xxhash64("vec_id", F.lit(SEED + 1)), "vec_id").select("vec").limit(SAMPLE_VECTORS).collect()]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = good.select("vec_id", "vec").mapInArrow(_exact(asked, k), _FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near: dict[int, list] = {}
    for r in found.join(good.select("vec_id", "vec").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "vec").collect():
        near.setdefault(r.query_id, []).append(r.vec)
    out = {}
    for size in {len(v) for _, v in asked}:
        mine = [(np.array(v), np.array(near[q])) for q, v in asked if len(v) == size and q in near]
        drawn = np.array([v for v in others if len(v) == size])
        if mine and len(drawn):
            least = min(len(x) for _, x in mine)
            shape = lambda x: lifted(x.reshape(-1, size), longest).reshape(*x.shape[:-1], -1)  # noqa: B023, E731
            f, p, recall, met = choose(asking(np.array([q for q, _ in mine]), longest), shape(np.array([x[:least] for _, x in mine])), shape(drawn), n, tables, target, functions)
            slots = 2 * width_of(size + (longest is not None))
            out[size] = f, p, groups_of(f, n, slots), recall, met
    return out


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, tables: int = TABLES, block: int = BLOCK, functions: int | None = None, target: float = TARGET) -> DataFrame:
    """The ``k`` found nearest of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those
    with the query's own id. Nearness is the inner product of the original vectors in double
    precision, ties go to the smaller id. Rows without id and vectors that are null, empty, zero
    or hold null or non-finite components take no part; rows with the same id count once, with
    their best score; vectors of
    other lengths than the query's are not compared. ``functions`` rotations make a bucket; by
    default they and the probes are chosen for the least work at which a bounded sample of queries
    finds ``target`` of its true neighbours or more, at every size of the table alike. A query for which
    the tables find fewer than ``k`` is answered by scanning all vectors in blocks. An empty table
    gives no rows; other columns are ignored.
    """
    v = F.col("vec")
    good = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    good = good.where(F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    good = good.withColumn("is_query", F.col("vec_id") % every == 0)
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    n, ids, longest, shortest = good.agg(F.count("*"), F.approx_count_distinct("vec_id"), F.max(length), F.min(length)).first()
    longest = None if not n or shortest >= longest * (1 - 1e-6) else longest
    chosen = settings_of(good, k, n, tables, longest, target, functions) if n else {}
    run = _hashed(tables, {size: s[:3] for size, s in chosen.items()}, longest)
    hashed = settle(good.select("vec_id", "is_query", "vec").mapInArrow(run, "vec_id long, is_query boolean, vec array<double>, buckets array<struct<code:bigint,fine:bigint>>, seek array<struct<code:bigint,fines:array<bigint>>>"), "ann-hashed")
    size = F.size("vec").alias("dim")
    members = hashed.select("vec_id", "vec", size, F.explode("buckets").alias("b")).select("vec_id", "vec", F.concat_ws("/", "dim", "b.code").alias("bucket"), "b.fine")
    queries = hashed.where("is_query").select("vec_id", "vec", size, F.explode("seek").alias("b")).select("vec_id", "vec", F.concat_ws("/", "dim", "b.code").alias("bucket"), "b.fines")
    large = members.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")
    one = F.coalesce("blocks", F.lit(1))
    spread = members.join(large, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), one))
    asked = queries.join(large, "bucket", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), one.cast("long") - 1)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = settle(_meet(spread, asked, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-best")
    found = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found"))
    # The estimated number of ids may be a little high; then small tables are only scanned once more.
    short = hashed.where("is_query").join(found, "vec_id", "left").where(F.coalesce("found", F.lit(0)) < min(k, max(0, ids - 1))).select("vec_id", "vec", F.size("vec").cast("string").alias("bucket"))
    short = settle(short, "ann-short")
    if not short.isEmpty():
        blocks = max(1, -(-n // block))
        all_ = hashed.select("vec_id", "vec", F.size("vec").cast("string").alias("bucket"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(0).cast("long").alias("fine"))
        rest = short.withColumn("fines", F.array(F.lit(0).cast("long"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        rest = _meet(all_, rest, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
