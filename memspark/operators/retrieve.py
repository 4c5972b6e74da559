"""Retrievers as DataFrame transforms: hits(query_id, unit_id, rank from 0, score).

Scores are rounded to SCORE_DIGITS before they rank, so that equal documents tie
whatever the order of summation; ties go to the smaller unit id unless a
retriever says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import hooks
from memspark.operators.vector_cache import VectorCache
from memspark.sources.stage import discard, saved

K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_DIGITS = 6
RRF_K = 60
#: Distinct query terms that may be broadcast.
BROADCAST_TERMS = 1_000_000
#: Items whose anchors may be broadcast.
BROADCAST_ITEMS = 1_000_000


def top(scored: DataFrame, k: int, *order: Column | str) -> DataFrame:
    # the bare number is compared, so that tasks cut their rows to k before the shuffle
    ranked = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("nth") <= k)
    return ranked.select("query_id", "unit_id", (F.col("nth") - 1).cast("int").alias("rank"), "score")


def filled(found: DataFrame, queries: DataFrame, units: DataFrame, k: int, least_weight: float | None) -> DataFrame:
    """The best k of found(query_id, unit_id, score), filled up with units of score 0 in id order.

    2k ids are enough: fewer than k of them can have been found for a query that needs any.
    Where no weight is negative, what is not among the best k found cannot come back by a
    score of 0, so no more than these are shuffled."""
    if least_weight is None or least_weight >= 0:
        found = top(found, k, F.col("score").desc(), "unit_id").drop("rank")
    spare = queries.select("query_id").distinct().crossJoin(F.broadcast(units.select("unit_id").orderBy("unit_id").limit(2 * k))).withColumn("score", F.lit(0.0))
    every = found.unionByName(spare).groupBy("query_id", "unit_id").agg(F.max_by("score", F.abs("score")).alias("score"))
    return top(every, k, F.col("score").desc(), "unit_id")


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` on all cores: a small table comes as one or two input splits."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tokenised(docs: DataFrame) -> DataFrame:
    return docs.select("unit_id", T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, unit_id) of the docs(unit_id, text) that hold an item's text(query_id, text) word for word.

    An item of three words or more is looked for by its longest inner word: it stands
    whole in any text that holds the item.  Only the pairs that share it are compared.
    Shorter items have no inner word and are compared with every document; they are
    broadcast while they number at most BROADCAST_ITEMS, and an error beyond.
    """
    words = F.filter(F.split("item", r"\s+"), lambda w: w != "")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))))
    named = items.select("query_id", F.col("text").alias("item")).where(F.col("item").isNotNull())
    anchored = named.withColumn("anchor", F.element_at(F.array_sort(inner, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1))
    long, short = anchored.where(F.col("anchor").isNotNull()), anchored.where(F.col("anchor").isNull()).drop("anchor")
    n_long, n_short = anchored.agg(F.count("anchor"), F.count_if(F.col("anchor").isNull())).first()
    if n_short > BROADCAST_ITEMS:
        raise ValueError(f"{n_short} items of fewer than three words")
    few = F.broadcast if n_long <= BROADCAST_ITEMS else lambda x: x
    seen = docs.select("unit_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("anchor"))
    pairs = seen.join(few(long), "anchor").select("query_id", "unit_id", "item")
    pairs = saved(pairs, "pairs")
    near = F.broadcast(pairs) if pairs.count() <= BROADCAST_ITEMS else pairs
    found = docs.select("unit_id", "text").join(near, "unit_id").where(F.col("text").contains(F.col("item"))).select("query_id", "unit_id")
    if not n_short:
        return found
    rest = docs.select("unit_id", "text").join(F.broadcast(short), F.col("text").contains(F.col("item"))).select("query_id", "unit_id")
    return found.unionByName(rest)


def counted(rows: DataFrame) -> DataFrame:
    """(unit_id, term, tf, dl) of each row of rows(unit_id, tokens); a row without terms has one of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            sizes = pc.list_value_length(tokens).to_numpy()
            flat = tokens.flatten().dictionary_encode()
            words = len(flat.dictionary) + 1
            row = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(sizes == 0)])
            code = np.concatenate([flat.indices.to_numpy(), np.full(int((sizes == 0).sum()), words - 1)])
            each, n = np.unique(row * words + code, return_counts=True)
            names = pa.concat_arrays([flat.dictionary, pa.array(["<empty>"], flat.dictionary.type)])
            at = each // words
            yield pa.RecordBatch.from_arrays([batch.column("unit_id").take(pa.array(at)), names.take(pa.array(each % words)).cast(pa.string()), pa.array(n), pa.array(np.maximum(sizes, 1)[at].astype(np.int32))], ["unit_id", "term", "tf", "dl"])

    kind = rows.schema["unit_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"unit_id {kind}, term string, tf long, dl int")


def unique(docs: DataFrame) -> bool:
    return docs.groupBy("unit_id").count().where("count > 1").isEmpty()


def postings(docs: DataFrame) -> DataFrame:
    """(unit_id, term, tf, dl) of docs(unit_id, text); a document without terms has one of its own.
    Each row is counted where it is; only where ids repeat, their rows are brought together."""
    rows = counted(tokenised(docs))
    if unique(docs):
        return rows
    return rows.groupBy("unit_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))


def idf_table(posted: DataFrame, n: int) -> DataFrame:
    """(term, df, idf): negative values become EPSILON times the vocabulary's mean."""
    return with_idf(posted.groupBy("term").agg(F.count("*").alias("df")), n)


def with_idf(df: DataFrame, n: int) -> DataFrame:
    raw = df.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Okapi BM25 of queries(query_id, text) over one corpus docs(unit_id, text), as a saved table.

    Texts are read and cut into tokens once.  Document frequencies are counted over the whole
    vocabulary, for its mean idf; postings are made of the queries' terms alone, while the
    terms number at most BROADCAST_TERMS in one broadcast join before any shuffle.  They are
    shuffled once, by document; each task sends its best k of a query.
    Documents without a common term fill up to k in id order with score 0.
    """
    rows = saved(tokenised(spread(docs)), "tokens")
    n, length = rows.agg(F.count("*"), F.avg(F.greatest(F.size("tokens"), F.lit(1)))).first()
    seen = rows.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).groupBy(F.coalesce("term", F.lit("<empty>")).alias("term")).agg(F.count("*").alias("df"))
    terms = queries.select("query_id", F.explode(T.bm25_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = terms.select("term").distinct()
    few = F.broadcast if wanted.count() <= BROADCAST_TERMS else lambda x: x
    # one shuffle by document: all sums of a document and query are made there
    posted = counted(rows).join(few(wanted), "term", "left_semi").repartition("unit_id")
    weighted = saved(terms.join(with_idf(seen, n), "term"), "weighted")
    score = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(length or 1))))
    # rows of one id are one document
    posted = posted.groupBy("unit_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    size, least = weighted.agg(F.count("*"), F.min("idf")).first()
    asked = F.broadcast(weighted) if size <= BROADCAST_TERMS else weighted
    found = posted.join(asked, "term").groupBy("query_id", "unit_id").agg(F.round(F.sum(score), SCORE_DIGITS).alias("score"))
    out = saved(filled(found, queries, rows, k, least), "hits")
    discard(rows, weighted)
    return out


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def question_dense(units: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """Cosine within each question: units(question_id, unit_id, vec), questions(question_id, vec)."""
    pairs = units.select("question_id", "unit_id", "vec").join(questions.select("question_id", F.col("vec").alias("q")), "question_id")
    return top(pairs.select(F.col("question_id").alias("query_id"), "unit_id", F.round(dot("q", "vec"), SCORE_DIGITS).alias("score")), k, F.col("score").desc(), "unit_id")


def encoded_dense(units: DataFrame, questions: DataFrame, k: int = 10, encoder: str = "hashing-64", make: Callable[[], hooks.Encoder] = hooks.HashingEncoder, cache: VectorCache | None = None) -> DataFrame:
    """``question_dense`` of units and questions that an encoder, or a cache of its vectors, turns into vectors."""
    vectors = hooks.encoded if cache is None else cache.encoded
    return question_dense(vectors(units, "text", encoder, make), vectors(questions.select("question_id", "question"), "question", encoder, make, query=True), k)


def hybrid(units: DataFrame, questions: DataFrame, k: int = 10, recency_weight: float = 0.0, depth: int = 100, encoder: str = "hashing-64", make: Callable[[], hooks.Encoder] = hooks.HashingEncoder, cache: VectorCache | None = None) -> DataFrame:
    """BM25 and dense rankings of each question, each to ``depth``, fused; recency as a third ranking if it has a weight."""
    near = encoded_dense(units, questions, depth, encoder, make, cache)
    parts, weights = [question_bm25(units, questions, depth), near], [1.0, 1.0]
    if recency_weight:
        parts.append(recency_for_fusion(units.join(questions.select("question_id"), "question_id", "left_semi"), depth))
        weights.append(recency_weight)
    return fuse(parts, weights, k)


def arm_name(name: str, recency_weight: float = 0.0) -> str:
    """The name of a run: a weighted hybrid carries its weight, so it replaces no other."""
    return f"hybrid_rw{recency_weight:g}" if name == "hybrid" and recency_weight > 0 else name


def retriever(name: str, recency_weight: float = 0.0, **options: object) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """A function (units, questions, k) -> hits by its name."""
    known: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
        "bm25": question_bm25,
        "dense": lambda u, q, k: encoded_dense(u, q, k, **options),
        "hybrid": lambda u, q, k: hybrid(u, q, k, recency_weight, **options),
        "oracle": lambda u, q, k: oracle(u, k), "recency": lambda u, q, k: recency(u, k), "random": lambda u, q, k: random(u, k), "none": lambda u, q, k: nothing(u),
    }
    if name not in known:
        raise ValueError(f"unknown retriever {name!r}: one of {tuple(known)}")
    return known[name]


def fuse(rankings: list[DataFrame], weights: list[float] | None = None, k: int = 10, k_rrf: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; a ranking of weight 0 is left out; ties by first appearance."""
    weights = [1.0] * len(rankings) if weights is None else weights
    if len(weights) != len(rankings):
        raise ValueError("one weight for each ranking")
    parts = [r.select("query_id", "unit_id", F.struct(F.lit(i).alias("i"), F.col("rank")).alias("seen"), (F.lit(float(w)) / (k_rrf + F.col("rank") + 1)).alias("part")) for i, (r, w) in enumerate(zip(rankings, weights, strict=True)) if w]
    if not parts:
        return rankings[0].where(F.lit(False)).select("query_id", "unit_id", "rank", "score")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", "unit_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("seen"))
    return top(fused, k, F.col("score").desc(), "seen")


def by_order(units: DataFrame, k: int, *order: Column | str, score: Column | None = None) -> DataFrame:
    """Rank the units of each question by the given order."""
    rows = units.withColumn("query_id", F.col("question_id"))
    ranked = rows.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("int"))
    return ranked.where(F.col("rank") < k).select("query_id", "unit_id", "rank", (-F.col("rank").cast("double") if score is None else score).alias("score"))


def recency(units: DataFrame, k: int = 10) -> DataFrame:
    """Newest first; of equal dates and sessions the later unit."""
    return by_order(units, k, T.parse_date(F.col("session_date")).desc_nulls_last(), F.col("session_index").desc(), F.col("unit_id").desc())


def recency_for_fusion(units: DataFrame, k: int = 100) -> DataFrame:
    """Newest first; of equal dates and sessions the earlier unit."""
    return by_order(units, k, T.parse_date(F.col("session_date")).desc_nulls_last(), F.col("session_index").desc(), F.col("unit_id"))


def oracle(units: DataFrame, k: int = 10) -> DataFrame:
    return by_order(units, k, F.col("is_evidence").desc(), "unit_id", score=F.col("is_evidence").cast("double"))


def random(units: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    return by_order(units, k, F.md5(F.concat_ws("|", F.lit(seed), "question_id", "unit_id").cast("binary")), score=F.lit(0.0))


def nothing(units: DataFrame) -> DataFrame:
    return by_order(units, 1, "unit_id").where(F.lit(False))


def question_bm25(units: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """BM25 with an index per question: every statistic is grouped by ``question_id``."""
    tokens = T.bm25_tokens(F.col("text"))
    rows = units.select("question_id", "unit_id", F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("<empty>"))).alias("tokens")).withColumn("dl", F.size("tokens"))
    size = rows.groupBy("question_id").agg(F.count("*").alias("n"), F.avg("dl").alias("mean_dl"))
    posted = rows.select("question_id", "unit_id", "dl", F.explode("tokens").alias("term")).groupBy("question_id", "unit_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = posted.groupBy("question_id", "term").agg(F.count("*").alias("df")).join(size, "question_id")
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = raw.withColumn("mean", F.avg("raw").over(Window.partitionBy("question_id"))).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")))
    terms = questions.select("question_id", F.explode(T.bm25_tokens(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))
    score = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean_dl")))
    found = posted.join(terms.join(idf.select("question_id", "term", "idf", "mean_dl"), ["question_id", "term"]), ["question_id", "term"])
    found = found.groupBy("question_id", "unit_id").agg(F.round(F.sum(score), SCORE_DIGITS).alias("score"))
    every = units.join(questions.select("question_id"), "question_id").select("question_id", "unit_id").join(found, ["question_id", "unit_id"], "left")
    return top(every.select(F.col("question_id").alias("query_id"), "unit_id", F.coalesce("score", F.lit(0.0)).alias("score")), k, F.col("score").desc(), "unit_id")
