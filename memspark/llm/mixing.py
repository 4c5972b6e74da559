"""Mixing sources to target weights by a hypergeometric splitting tree (operator 8).

Sources, in code-point order with null last, have weights that repeat a short
list.  Together they receive ``share`` times all words; a source's target stops
at ``cap`` times its words and the excess is reshared by weight among the
others until none is above.

A source is cut into blocks: runs of documents in the order of a seeded hash of
their ids, so a block is a random set of about ``block_docs`` documents and the
block order is a random permutation.  The mix takes whole passes over the
blocks while the target lasts, then blocks in order until the rest is reached;
in the last block documents are taken in hash order, and the last document
gives just the words that are missing.  So each source's words equal its
rounded target.

The draws (source, pass, block) of all sources are divided among output shards of
about ``shard_words`` words (or ``shards`` of them, if given) by a binary tree: each node splits its vector of remaining draws
per source between its halves by one multivariate-hypergeometric sample, so
every shard has its own exact quota of each source.  Quotas are turned into
disjoint runs of the permuted draws, and each shard is ordered by a hash.

All sums over documents are grouped by (source, bin) first; windows run over
the bins of a source or within one bin, never over a whole source's documents.
One task holds a row per source (for the targets and the tree), or one per bin
of a source: a few numbers for each 512 documents.

Defined cases: a null text has no words and is never taken; a source without
words has the target 0; the null source is a source; documents with equal ids
are ordered by a hash of their text; exact repeats of a row are spread by their
place in the bin; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import WORD, n_words, saved

WEIGHTS = (5, 2, 1)


def targets(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from rows with source and size.

    With the sources in order of cap * size / weight, the first k are at their
    cap for the least k at which the others' common level does not exceed the
    next one's; sums run over one row per source.
    """
    per = df.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    live = F.col("source_size") > 0
    limit = F.col("source_size") * F.lit(float(cap))
    everything = Window.partitionBy(live)
    order = everything.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"wanted": F.sum("source_size").over(everything) * F.lit(float(share)), "all_weight": F.sum("weight").over(everything)})
    per = per.withColumns({"capped": F.coalesce(F.sum(limit).over(below), F.lit(0.0)), "spent": F.coalesce(F.sum("weight").over(below), F.lit(0))})
    level = (F.col("wanted") - F.col("capped")) / (F.col("all_weight") - F.col("spent"))
    per = per.withColumn("level", F.when(level * F.col("weight") <= limit, level))
    # the first source whose level fits fixes the level of all after it
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(~live, 0.0).otherwise(F.coalesce(F.least(F.col("level") * F.col("weight"), limit), limit))
    return per.select("source", "source_size", "n_docs", "weight", target.cast("double").alias("target"))


def split_tree(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many draws of each source each shard gets."""
    if shards == 1:
        return draws[None, :]
    left = shards // 2
    total = int(draws.sum())
    n = total * left // shards
    taken = rng.multivariate_hypergeometric(draws, n, method="marginals") if total else draws * 0
    return np.concatenate([split_tree(taken, left, rng), split_tree(draws - taken, shards - left, rng)])


def shard_quotas(per_source: pd.DataFrame, shards: int, seed: int) -> pd.DataFrame:
    """Bounds of each source's run of draws in each shard; one row per source."""
    per_source = per_source.sort_values(["source_key"])
    quota = split_tree(per_source["draws"].to_numpy(dtype=np.int64), shards, np.random.default_rng(seed))
    upto = np.cumsum(quota, axis=0).T
    return pd.DataFrame({"source_key": per_source["source_key"], "upto": list(upto)})


def source_key(source: Column) -> Column:
    """The source as a non-null string: nulls can be joined on it."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, cap: float = 3.0, shards: int | None = None, shard_words: int = 50_000_000, block_docs: int = 512, seed: int = 7) -> DataFrame:
    """One row per document with doc_id, row_hash, size, source, source_size, target, taken
    and ``draws``: an array of (pass, shard, words), one entry for each time the mix takes
    the document (``words`` is its size but for a source's last document)."""
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    docs = df.select("doc_id", "source", n_words(F.col("text")).alias("size"), hashed.alias("row_hash"))
    docs = saved(docs, "sizes")
    per = saved(targets(docs, weights, share, cap).withColumn("key", source_key(F.col("source"))), "targets")
    if shards is None:
        words = per.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
        shards = max(16, math.ceil(words / shard_words))
    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs)).cast("long")
    plan = per.select("key", "source_size", "target", blocks_of.alias("n_blocks"), F.round("target").cast("long").alias("wanted"))
    keyed = docs.withColumn("key", source_key(F.col("source"))).join(F.broadcast(plan) if per.count() <= 100_000 else plan, "key")
    # the hash, as a fraction of its range, picks the block; within it, it orders the documents
    fraction = (F.shiftrightunsigned("row_hash", 11).cast("double")) / float(1 << 53)
    keyed = keyed.withColumn("block", F.floor(fraction * F.col("n_blocks")).cast("long"))
    bins = saved(keyed.groupBy("key", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("wanted").alias("wanted")), "bins")
    by_source = Window.partitionBy("key").orderBy("block")
    placed = bins.withColumns(
        {
            "before": F.sum("words").over(by_source) - F.col("words"),
            "at": (F.row_number().over(by_source) - 1).cast("long"),
            "blocks": F.count("*").over(Window.partitionBy("key")),
            "passes": F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)),
        }
    ).withColumn("rest", F.col("wanted") - F.col("passes") * F.col("source_size"))
    placed = placed.withColumn("partly", (F.col("before") < F.col("rest")) & (F.col("words") > 0))
    draws = placed.groupBy("key").agg((F.max("passes") * F.count("*") + F.sum(F.col("partly").cast("long"))).cast("long").alias("draws"))
    quotas = draws.select(F.lit(0).alias("tree"), F.col("key").alias("source_key"), "draws").groupBy("tree").applyInPandas(lambda pdf: shard_quotas(pdf, shards, seed), "source_key string, upto array<long>")
    placed = placed.join(quotas, F.col("key") == F.col("source_key")).select("key", "block", "before", "at", "blocks", "passes", "rest", "upto")
    small = placed.count() <= 100_000
    taken = keyed.join(F.broadcast(placed) if small else placed, ["key", "block"])
    inside = Window.partitionBy("key", "block").orderBy("row_hash", "doc_id")
    start = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    taken = taken.withColumn("last_words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start)).cast("long"))
    shard = lambda p: F.size(F.filter("upto", lambda x: x <= p * F.col("blocks") + F.col("at"))).cast("int")
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("passes")), lambda p: F.struct(p.alias("pass"), shard(p - 1).alias("shard"), F.col("size").alias("words"))))
    kind = "array<struct<pass:bigint,shard:int,words:bigint>>"
    last = F.when(F.col("last_words") > 0, F.array(F.struct((F.col("passes") + 1).alias("pass"), shard(F.col("passes")).alias("shard"), F.col("last_words").alias("words"))))
    empty = F.array().cast(kind)
    return taken.select(
        "doc_id", "row_hash", "size", "source", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("last_words")).alias("taken"),
        F.when(F.col("size") > 0, F.concat(F.coalesce(whole.cast(kind), empty), F.coalesce(last.cast(kind), empty))).otherwise(empty).alias("draws"),
    )


def mixed_rows(df: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus: the rows of ``df``, each as often as it is drawn, with the
    column ``shard`` and in each shard the order of ``place``; the last document of
    a source is cut after the words it gives."""
    # exact repeats of a row are numbered, so that each meets the draws of one of them
    nth = F.row_number().over(Window.partitionBy("row_hash").orderBy(F.lit(0)))
    drawn = mix(df, **options).withColumn("nth", nth).select("row_hash", "nth", F.explode("draws").alias("draw"))
    seed = options.get("seed", 7)
    rows = df.withColumn("row_hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))).withColumn("nth", nth).join(drawn, ["row_hash", "nth"])
    size = n_words(F.col("text"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, words: pd.Series) -> pd.Series:
        import re

        def one(text: str, n: int) -> str:
            for i, m in enumerate(re.finditer(WORD, text), 1):
                if i == n:
                    return text[: m.end()]
            return text

        return pd.Series([one(t, n) for t, n in zip(texts, words, strict=True)])

    whole = rows.where(F.col("draw.words") >= size)
    partial = rows.where(F.col("draw.words") < size).withColumn("text", cut("text", "draw.words"))
    place = F.xxhash64("row_hash", "draw.pass")
    return whole.unionByName(partial).select(*[c for c in df.columns if c not in ("shard", "place")], F.col("draw.shard").alias("shard"), place.alias("place"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write each shard to its own folder, locally shuffled.  A shard is dealt out by
    ranges of its order, so several tasks write a large one and its files, by
    name, are in order."""
    mixed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)
