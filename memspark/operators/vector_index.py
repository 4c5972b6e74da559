"""Vectors packed into matrix blocks, stored once, and searched block against block.

A block holds up to some BLOCK vectors of one length, the ids ascending.  Queries
are packed the same way.  Every task multiplies pairs of blocks and keeps the k
best units of each query it has seen, so k rows per query and task move, and the
plan is the same for ten queries and for ten million: query blocks are broadcast
while their bytes allow it, else they are copied to each of PARTS parts of the
index and joined there.  The units are read from storage in either case.

Vectors of another length than a query's are no candidates of it; null vectors
take no part; a unit with the query's own id is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators import retrieve
from memspark.sources import stage

BLOCK = 1024
#: Bytes of query vectors that may be broadcast; parts that the index falls into otherwise.
BROADCAST_BYTES, PARTS = 64 << 20, 64
#: Best units that a task keeps before it passes them on.
KEEP = 2_000_000


def packed(vectors: DataFrame, id_col: str, block_size: int = BLOCK) -> DataFrame:
    """(dims, block, ids, numbers) of vectors(id, vec)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    blocks = max(1, -(-rows.count() // block_size))
    each = rows.groupBy(F.size("vec").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("v"))  # block_size or so
    return each.select("dims", "block", F.transform("v", lambda x: x["id"]).alias("ids"), F.flatten(F.transform("v", lambda x: x["vec"])).alias("numbers"))


def build(vectors: DataFrame, path: str, id_col: str = "unit_id", block_size: int = BLOCK) -> None:
    """Store the blocks of vectors(id, vec); the folder appears whole, by one rename."""
    made = f"{path}-{uuid.uuid4().hex}"
    packed(vectors, id_col, block_size).write.parquet(made)
    stage.commit(vectors.sparkSession, made, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored(vectors: DataFrame, table: DataFrame, id_col: str = "unit_id") -> DataFrame:
    """The blocks of vectors that are made of a file-based ``table``, built if they are not there for its files as they are."""
    path = f"{stage.shared_dir(table.sparkSession)}/vectors-{stage.content_of(table)}"
    if not stage.exists(table.sparkSession, path):
        build(vectors, path, id_col)
    return load(table.sparkSession, path)


def search(index: DataFrame, queries: DataFrame, k: int = 10, block_size: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """hits(query_id, unit_id, rank, score) of queries(query_id, vec): the largest inner products."""
    asked = stage.saved(packed(queries, "query_id", block_size).withColumnsRenamed({"block": "asked", "ids": "query_ids", "numbers": "query_numbers"}), "asked")
    size = asked.agg(F.sum(F.col("dims") * F.size("query_ids") * 8)).first()[0] or 0
    if size <= broadcast_bytes:
        pairs = index.join(F.broadcast(asked), "dims")
    else:
        copies = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        pairs = index.withColumn("part", F.col("block") % PARTS).join(copies, ["dims", "part"])
    kind = lambda df, c: df.schema[c].dataType.elementType.simpleString()
    schema = f"query_id {kind(asked, 'query_ids')}, unit_id {kind(index, 'ids')}, score double"
    rows = pairs.select("dims", "asked", "query_ids", "query_numbers", "ids", "numbers").mapInArrow(lambda it: nearest(it, k), schema)
    return retrieve.top(rows, k, F.col("score").desc(), "unit_id")


def best_of(query: np.ndarray, unit: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query number, unit, score) of each query, ties to the smaller unit."""
    order = np.lexsort((unit, -score, query))
    query, unit, score = query[order], unit[order], score[order]
    head = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(head, np.diff([*head, len(query)]))
    return query[rank < k], unit[rank < k], score[rank < k]


def block_best(queries: np.ndarray, units: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    score = np.round(queries @ units.T, retrieve.SCORE_DIGITS)
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    least = np.full(len(score), -np.inf) if score.shape[1] <= k else -np.partition(-score, k - 1, axis=1)[:, k - 1]
    q, u = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    return best_of(q, ids[u], score[q, u], k)


def nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best: dict[tuple[int, int], tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    kinds: tuple[pa.DataType, pa.DataType] | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        for ids, (q, u, s) in best.values():
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q].tolist(), kinds[0]), pa.array(u.tolist(), kinds[1]), pa.array(s)], ["query_id", "unit_id", "score"])
        best.clear()

    for batch in batches:
        query_lists, unit_lists = batch.column("query_ids"), batch.column("ids")
        kinds = (query_lists.type.value_type, unit_lists.type.value_type)
        for i in range(batch.num_rows):
            dims = batch.column("dims")[i].as_py()
            numbers = lambda c: np.asarray(batch.column(c)[i].values).reshape(-1, dims)  # noqa: B023, E731
            query_ids, ids = np.array(query_lists[i].as_py()), np.array(unit_lists[i].as_py())
            found = block_best(numbers("query_numbers"), numbers("numbers"), query_ids, ids, k)
            key = (dims, batch.column("asked")[i].as_py())
            if key in best:
                found = best_of(*(np.concatenate(x) for x in zip(best[key][1], found, strict=True)), k)
            best[key] = (query_ids, found)
            if sum(len(f[0]) for _, f in best.values()) > KEEP:
                yield from flush()
    if best:
        yield from flush()
