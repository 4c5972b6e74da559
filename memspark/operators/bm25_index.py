"""A BM25 index that is built once, stored, and searched by any number of query sets.

``postings`` holds for each term and block of documents the documents' ids, counts
and lengths, and the highest impact among them; it lies in folders by the term's
hash, in term order, so that a search reads the parts that its terms need.
``terms`` has document frequencies and idf values, ``units`` ids and lengths,
``stats`` the totals.  A document's block is a hash of its id, so no term has one
long list, and the texts are read in one pass.

A search bounds each query's score in a block by the highest impacts of its terms,
takes the blocks with the highest bounds first, and with the k-th score found
there leaves out all blocks whose bound is below it.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import retrieve
from memspark.sources import stage

#: Documents of a block; folders of the postings table.
BLOCK_UNITS, FOLDERS = 1024, 16
#: Blocks by which a query's threshold is set.
FIRST_BLOCKS = 2
#: Scores are rounded before they rank, so a bound must be this far below.
SLACK = 2 * 10.0**-retrieve.SCORE_DIGITS
#: Query terms that may be broadcast.
BROADCAST_TERMS = 1_000_000


class Index(NamedTuple):
    postings: DataFrame
    terms: DataFrame
    units: DataFrame
    mean_length: float


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def impact(tf: Column, length: Column, mean: Column) -> Column:
    k1, b = retrieve.K1, retrieve.B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def build(docs: DataFrame, path: str, block_units: int = BLOCK_UNITS) -> None:
    """Index docs(unit_id, text) at ``path``.  The folder appears whole, by one rename; if it has appeared meanwhile, that one stays."""
    spark = docs.sparkSession
    made = f"{path}-{uuid.uuid4().hex}"
    tf = stage.saved(retrieve.postings(retrieve.spread(docs)), "tf")
    tf.groupBy("unit_id").agg(F.first("dl").alias("dl")).write.parquet(f"{made}/units")
    units = spark.read.parquet(f"{made}/units")
    n, mean = units.agg(F.count("*"), F.avg("dl")).first()
    retrieve.idf_table(tf, n).write.parquet(f"{made}/terms")
    blocks = max(1, -(-n // block_units))
    place = F.pmod(F.xxhash64("unit_id"), F.lit(blocks)).cast("int")
    high = F.max(impact(F.col("tf"), F.col("dl"), F.lit(float(mean or 1.0))))
    # one shuffle: the lists of a folder and block are made, sorted and written where it puts them
    dealt = tf.withColumns({"folder": folder(F.col("term")), "block": place}).repartition("folder", "block")
    each = dealt.groupBy("folder", "block", "term").agg(high.alias("high"), F.collect_list(F.struct("unit_id", F.col("tf").cast("int").alias("tf"), "dl")).alias("entries"))  # block_units or so
    rows = each.select("term", "block", "high", "entries", "folder")
    rows.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{made}/postings")
    spark.createDataFrame([(n, float(mean or 1.0), blocks)], "n long, mean_length double, blocks int").coalesce(1).write.parquet(f"{made}/stats")
    stage.discard(tf)
    stage.commit(spark, made, path)


def load(spark: SparkSession, path: str) -> Index:
    stats, units = spark.read.parquet(f"{path}/stats").first(), spark.read.parquet(f"{path}/units")
    kind = units.schema["unit_id"].dataType.simpleString()
    # no folder tells the schema of an empty corpus
    postings = spark.read.schema(f"term string, block int, high double, entries array<struct<unit_id: {kind}, tf: int, dl: int>>, folder int").parquet(f"{path}/postings")
    return Index(postings, spark.read.parquet(f"{path}/terms"), units, stats.mean_length)


def term_table(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The terms of ``stored`` where it has been built, else counted without building it."""
    spark = docs.sparkSession
    path = f"{stage.shared_dir(spark)}/bm25-{stage.content_of(table)}"
    if stage.exists(spark, path):
        return load(spark, path).terms
    df = retrieve.tokenised(docs).groupBy("unit_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens")) if not retrieve.unique(docs) else retrieve.tokenised(retrieve.spread(docs))
    seen = df.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).groupBy(F.coalesce("term", F.lit("<empty>")).alias("term")).agg(F.count("*").alias("df"))
    return retrieve.with_idf(stage.saved(seen, "df"), docs.select("unit_id").distinct().count())


def stored(docs: DataFrame, table: DataFrame) -> Index:
    """The index of docs(unit_id, text), which are made of a file-based ``table``: found in
    the shared folder if it has been built for the files as they are, else built there."""
    spark = docs.sparkSession
    path = f"{stage.shared_dir(spark)}/bm25-{stage.content_of(table)}"
    if not stage.exists(spark, path):
        build(docs, path)
    return load(spark, path)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """hits(query_id, unit_id, rank, score) of queries(query_id, text), as ``retrieve.bm25`` finds them."""
    terms = queries.select("query_id", F.explode(T.bm25_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = stage.saved(terms.join(index.terms, "term").select("query_id", "term", folder(F.col("term")).alias("folder"), (F.col("qtf") * F.col("idf")).alias("weight")), "asked")
    size, lightest = weighted.agg(F.count("*"), F.min("weight")).first()
    asked = F.broadcast(weighted) if size <= BROADCAST_TERMS else weighted
    bound = F.sum(F.greatest(F.lit(0.0), F.col("weight") * F.col("high"))).alias("bound")
    bounds = stage.saved(index.postings.select("folder", "term", "block", "high").join(asked, ["folder", "term"]).groupBy("query_id", "block").agg(bound), "bounds")
    first = retrieve.top(bounds.select("query_id", F.col("block").alias("unit_id"), F.col("bound").alias("score")), FIRST_BLOCKS, F.col("score").desc(), "unit_id")
    first = first.select("query_id", F.col("unit_id").alias("block"))
    early = retrieve.top(scores(index, asked, first), k, F.col("score").desc(), "unit_id")
    least = early.where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("least"))
    live = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "block")
    found = scores(index, asked, live)
    # documents without a common term fill up to k
    return retrieve.filled(found, queries, index.units, k, lightest)


def scores(index: Index, asked: DataFrame, live: DataFrame) -> DataFrame:
    """(query_id, unit_id, score) of the documents in the given blocks of each query."""
    terms, blocks = asked.select("folder", "term").distinct(), live.select("block").distinct()
    few = F.broadcast if terms.count() <= BROADCAST_TERMS else lambda x: x
    # lists are shuffled once, by block, before they meet the queries: a document's sums are made there
    lists = index.postings.join(few(terms), ["folder", "term"], "left_semi").join(blocks, "block", "left_semi").repartition("block")
    rows = lists.join(asked, ["folder", "term"]).join(live, ["query_id", "block"])
    each = rows.select("query_id", "block", "weight", F.explode("entries").alias("e"))
    part = F.col("weight") * impact(F.col("e.tf"), F.col("e.dl"), F.lit(index.mean_length))
    summed = each.groupBy("query_id", "block", F.col("e.unit_id").alias("unit_id")).agg(F.round(F.sum(part), retrieve.SCORE_DIGITS).alias("score"))
    return summed.drop("block")
