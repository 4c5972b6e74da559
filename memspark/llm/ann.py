"""Nearest neighbours by a block matrix join over int8 tiles (operator 1).

Candidates are hashed into blocks of ``block_rows`` vectors and queries into
blocks of ``query_rows``, each a row of packed matrices.  A task takes one
candidate block and lets every query block pass it: copies of the query blocks
are what moves, so candidate blocks grow with the table, as far as the tasks
still outnumber the cores.  In a tile the product of the int8 codes gives each
inner product up to a quantisation error that is known exactly: with x = x' + e
(x' the decoded code),

    |x.y - x'.y'| <= |e_x| |y| + |x'| |e_y|.

Pairs whose upper bound falls below the k-th lower bound of their query cannot
be among its k nearest.  The others are recomputed from the original vectors
in double precision, adding the products in index order, and pushed on one
heap per query; the heaps of all tasks are merged at the end.  The result is
exact.

Defined cases: null, zero, empty or non-finite vectors and null ids take no
part; vectors of another length than the query's are no candidates; every row
is a candidate, so repeated rows and rows that share an id are found each for
itself, but for rows of the query's own id; query rows that share an id make one
query, whose nearest are those of any of its different vectors; ties go to the
smaller id; with fewer than k candidates all are returned; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm import textvec as tv
from memspark.llm.common import saved, small_batches

MAX_HEAPED = 200_000
#: Candidates of a tile; rows of a candidate block at most.
TILE, MAX_BLOCK = 2048, 16_384
BLOCK = "dim int, block int, ids binary, codes binary, stats binary, vectors binary"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array, dim int) of the rows that take part."""
    inf = F.lit(float("inf"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == inf))
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    out = out.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)
    return out.where(F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes, and per row: scale, error norm, norm, norm of the decoded row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # a subnormal row may underflow; its error norm then covers it
    codes = np.rint(x / scale[:, None]).clip(-127, 127)
    back = codes * scale[:, None]
    norms = [np.linalg.norm(m, axis=1) for m in (x - back, x, back)]
    return codes.astype(np.int8), np.stack([scale, *norms], axis=1)


def pack(batches: Iterator[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    """One packed row per block of distinct rows with their number ``n``.

    For candidates, k is given: a row counts at most k times, and of equal vectors
    the 2 k rows with the smallest ids are kept.  At most k of them are of a
    query's own id, so no query misses one of its nearest."""
    for batch in batches:
        for row in range(batch.num_rows):
            items = batch.column("items")[row].values
            ids = items.field("id").to_numpy()
            dim = batch.column("dim")[row].as_py()
            x = items.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            order = np.lexsort((*x.T[::-1], ids))
            if k is not None:
                order = np.repeat(order, np.minimum(items.field("n").to_numpy(), k)[order])
            ids, x = ids[order], np.ascontiguousarray(x[order])
            if k is not None:
                _, group = np.unique(x, axis=0, return_inverse=True)
                by = np.argsort(group.ravel(), kind="stable")
                g = group.ravel()[by]
                head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                place = np.arange(len(g)) - np.repeat(head, np.diff(np.concatenate([head, [len(g)]])))
                keep = np.sort(by[place < 2 * k])
                ids, x = ids[keep], x[keep]
            codes, stats = quantise(x.astype(np.float64))
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "block": batch.column("block").slice(row, 1)}
                | {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("ids", ids), ("codes", codes), ("stats", stats), ("vectors", x))}
            )
    tv.release()


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 codes.  1,024 products of codes stay below 2**24,
    so single-precision BLAS gives them exactly."""
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in index order."""
    out = np.zeros(len(x), dtype=np.float64)
    for d in range(x.shape[1]):
        out += x[:, d].astype(np.float64) * y[:, d].astype(np.float64)
    return out


class Block:
    """The matrices of a packed row."""

    def __init__(self, batch: pa.RecordBatch, i: int, dtype: str) -> None:
        dim = batch.column("dim")[i].as_py()
        at = lambda name, kind, width: np.frombuffer(batch.column(name)[i].as_py(), dtype=kind).reshape(-1, width)
        self.ids, self.codes, self.stats, self.vectors = at("ids", "<i8", 1)[:, 0], at("codes", "i1", dim), at("stats", "<f8", 4), at("vectors", dtype, dim)


def search_blocks(batches: Iterator[pa.RecordBatch], k: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows of a task come by block, each candidate block before the query blocks that meet it."""
    heaps: dict[int, list[tuple[float, int]]] = {}

    def drained() -> pa.RecordBatch:
        rows = [(q, -v, s) for q, heap in heaps.items() for s, v in heap]
        heaps.clear()
        q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    def search(q: Block, c: Block, lo: int) -> None:
        """A tile: all queries of a block against TILE candidates from ``lo``."""
        cid, cs, cv = c.ids[lo : lo + TILE], c.stats[lo : lo + TILE], c.vectors[lo : lo + TILE]
        near = tile_products(q.codes, c.codes[lo : lo + TILE]) * (q.stats[:, :1] * cs[:, 0])
        slack = (q.stats[:, 1:2] * cs[:, 2] + q.stats[:, 3:4] * cs[:, 1]) * (1 + 1e-9) + 1e-12 * q.stats[:, 2:3] * cs[:, 2]
        own = q.ids[:, None] == cid
        low = np.where(own, -np.inf, near - slack)
        floor = np.array([heaps[i][0][0] if len(heaps.get(i, ())) == k else -np.inf for i in q.ids.tolist()])
        if len(cid) > k:
            floor = np.maximum(floor, np.partition(low, len(cid) - k, axis=1)[:, len(cid) - k])
        left, right = np.nonzero((near + slack >= floor[:, None]) & ~own)
        for at in range(0, len(left), 200_000):
            a, b = left[at : at + 200_000], right[at : at + 200_000]
            score = exact_products(q.vectors[a], cv[b])
            for i, j, s in zip(q.ids[a].tolist(), cid[b].tolist(), score.tolist(), strict=True):
                heap = heaps.setdefault(i, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -j))
                elif (s, -j) > heap[0]:
                    heapq.heapreplace(heap, (s, -j))

    candidates, block = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            here = (batch.column("dim")[i].as_py(), batch.column("block")[i].as_py())
            if not batch.column("asks")[i].as_py():
                candidates, block = Block(batch, i, dtype), here
            elif here == block:
                queries = Block(batch, i, dtype)
                for lo in range(0, len(candidates.ids), TILE):
                    search(queries, candidates, lo)
                if len(heaps) * k > MAX_HEAPED:
                    yield drained()
    yield drained()
    tv.release()


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int | None = None, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows.

    ``is_query`` is a condition on the column ``id``.
    """
    kind = dict(df.dtypes)[vec_col]
    if kind not in ("array<float>", "array<double>"):
        raise ValueError(f"{vec_col} is {kind}, not an array of float or double")
    dtype = "<f4" if kind == "array<float>" else "<f8"
    # repeated rows become one with a number before they meet, however many there are
    small_batches(df.sparkSession)
    rows = usable(df, id_col, vec_col).groupBy("id", "vec", "dim").agg(F.count("*").alias("n"))
    rows = saved(rows, "vectors")
    total, asked = rows.agg(F.count("*"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if block_rows is None:
        block_rows = min(MAX_BLOCK, max(TILE, total // (4 * cores)))
    n_blocks, n_query_blocks = max(1, math.ceil(total / block_rows)), max(1, math.ceil(asked / query_rows))

    def blocks(part: DataFrame, n: int, copies: int | None) -> DataFrame:
        grouped = part.groupBy("dim", F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int").alias("block"))
        return grouped.agg(F.collect_list(F.struct("id", "vec", "n")).alias("items")).mapInArrow(lambda it: pack(it, copies), BLOCK)

    packed = ["dim", "block", "asks", "ids", "codes", "stats", "vectors"]
    candidates = blocks(rows, n_blocks, k).withColumn("asks", F.lit(False)).select(packed)
    queries = blocks(rows.where(is_query), n_query_blocks, None).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    both = candidates.unionByName(queries.withColumn("asks", F.lit(True)).select(packed))
    met = both.repartition(n_blocks, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    found = met.mapInArrow(lambda it: search_blocks(it, k, dtype), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
