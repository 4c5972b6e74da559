"""Stored BM25 index, positional index and read-through cache."""

import os
import random

import pytest
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import bm25_index, hooks, positions, retrieve, survival, vector_cache
from memspark.sources import stage

WORDS = ["oak", "elm", "ash", "fir", "yew", "ivy", "fern", "moss", "reed", "rush"]


def texts(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, weights=range(1, 11), k=rng.randrange(0, 40)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "?!")], "unit_id long, text string")


def test_bm25_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = texts(spark, 300)
    path = f"file://{tmp_path}/index"
    bm25_index.build(docs, path, block_units=16)
    index = bm25_index.load(spark, path)
    for seed, asked in ((2, 12), (3, 7)):
        queries = texts(spark, asked, seed).select(F.concat(F.lit("q"), "unit_id").alias("query_id"), "text")
        got = sorted(map(tuple, bm25_index.search(index, queries, 5).collect()))
        assert got == sorted(map(tuple, retrieve.bm25(docs, queries, 5).collect())) and len(got) == 5 * (asked + 2)
    # the texts are not read again
    assert not any("text" in f.name for f in index.postings.schema.fields)


def test_bm25_blocks_are_left_out(spark, tmp_path):
    rows = [(i, "common " * (i % 5 + 1)) for i in range(400)] + [(1000, "needle needle common"), (1001, "needle")]
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame(rows, "unit_id long, text string")
    bm25_index.build(docs, path, block_units=8)
    index = bm25_index.load(spark, path)
    queries = spark.createDataFrame([("q", "needle common")], "query_id string, text string")
    assert [r.unit_id for r in bm25_index.search(index, queries, 2).orderBy("rank").collect()] == [r.unit_id for r in retrieve.bm25(docs, queries, 2).orderBy("rank").collect()]
    assert index.postings.select("block").distinct().count() > 30


def test_an_index_appears_whole_and_once(spark, tmp_path):
    docs = texts(spark, 20)
    path = f"file://{tmp_path}/index"
    bm25_index.build(docs, path)
    before = sorted(os.listdir(tmp_path / "index"))
    bm25_index.build(docs.limit(3), path)
    assert sorted(os.listdir(tmp_path)) == ["index"] and sorted(os.listdir(tmp_path / "index")) == before
    assert bm25_index.load(spark, path).units.count() == 22
    table = f"file://{tmp_path}/table"
    docs.write.parquet(table)
    bm25_index.stored(docs, spark.read.parquet(table))
    assert stage.exists(spark, f"{stage.shared_dir(spark)}/bm25-{stage.content_of(spark.read.parquet(table))}")


def test_empty_corpus(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    bm25_index.build(texts(spark, 5).limit(0), path)
    queries = spark.createDataFrame([("q", "oak")], "query_id string, text string")
    assert bm25_index.search(bm25_index.load(spark, path), queries, 5).count() == 0


GOLDS = [
    ("q1", "Which?", "oak elm"), ("q1", "Which?", "moss reed rush"), ("q1", "Which?", "oak"), ("q1", "Which?", "yew, ivy, and fern"), ("q1", "In what order?", "yew, ivy, and fern"),
    ("q1", "In what order?", "fern, ivy, and yew"), ("q1", "Which?", "the"), ("q1", "Which?", ""), ("q1", "Which?", "elm elm"), ("q1", "Which?", "nowhere"), ("q1", "Which?", "fir or yew fern"), ("q2", "In what order?", "oak, oak elm, and ash"), ("q2", "Which?", "rush moss"),
]


def naive(spark, units, golds):
    """Every gold with every unit."""
    rows = units.join(golds, "question_id").withColumns({"t": T.normal_tokens(F.col("text")), "key": T.answer_key(F.col("answer"), F.col("question"))})
    rows = rows.withColumns({"record": T.has_answer(F.col("t"), F.col("key")), "soft": T.covers(F.col("t"), T.normal_tokens(F.col("answer")))})
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "t"))), lambda u: u["t"]))
    per = rows.groupBy("store", "question_id", "nth", "key").agg(F.bool_or("record").alias("record"), F.bool_or("soft").alias("soft"), whole.alias("whole"))
    per = per.withColumn("union_hit", T.has_answer(F.col("whole"), F.col("key")))
    return {(r.store, r.question_id, r.nth): (r.record, r.soft, r.union_hit) for r in per.collect()}


@pytest.mark.parametrize("bin_size", [1024, 3])
def test_positional_index_against_every_pair(spark, monkeypatch, bin_size):
    monkeypatch.setattr(positions, "BIN", bin_size)
    rng = random.Random(9)
    rows = [(s, q, u, " ".join(rng.choices(WORDS, k=rng.randrange(0, 6)))) for s in ("a", "b") for q in ("q1", "q2", "q3") for u in range(12)]
    units = spark.createDataFrame(rows, "store string, question_id string, unit_id int, text string")
    golds = spark.createDataFrame([(q, w, i, g) for i, (q, w, g) in enumerate(GOLDS)], "question_id string, question string, nth int, answer string")
    got = {(r.store, r.question_id, r.nth): (r.record, r.soft, r.union_hit) for r in positions.found(units, golds, "store").collect()}
    want = naive(spark, units, golds)
    assert got == {k: v for k, v in want.items() if any(v)} and 8 < len(got) < len(want)


def test_a_large_store(spark):
    units = spark.range(100_000).select(F.lit("q").alias("question_id"), F.col("id").cast("int").alias("unit_id"), F.concat(F.lit("filler words number "), "id").alias("text"))
    units = units.withColumn("text", F.when(F.col("unit_id") == 77_777, "the copper kettle").when(F.col("unit_id") == 77_778, "whistles").otherwise(F.col("text")))
    q = spark.createDataFrame([("q", "t", "", "copper kettle whistles")], "question_id string, question_type string, question string, gold string")
    r = survival.score(units, q, 0).first()
    assert (r.record, r.soft, r.union_hit, r.n_records) == (False, False, True, 100_000)


def test_cache_encodes_misses_only(spark, tmp_path):
    class Counting(hooks.HashingEncoder):
        """Writes down what it is asked."""

        def __init__(self, log):
            super().__init__(8)
            self.log = log

        def encode(self, rows):
            with open(self.log, "a") as f:
                f.writelines(f"{r!r}\n" for r in rows)
            return super().encode(rows)

    log, path = str(tmp_path / "log"), f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "oak elm"), (2, "oak elm"), (3, "fern"), (4, None), (5, "")], "id int, text string")
    run = lambda rows: (c := vector_cache.VectorCache(spark, path), c.encoded(rows, "text", "m", lambda: Counting(log)).collect())
    cache, got = run(df)
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 5] and len(open(log).readlines()) == 3
    assert {r.id: r.vec for r in got} == {r.id: r.vec for r in hooks.encoded(df, "text", "plain", lambda: hooks.HashingEncoder(8)).collect()}
    u = cache.usage().first()
    assert (u.hits, u.misses, u.replayed_tokens, u.used_replayed_timings) == (0, 3, 0, False)
    cache, again = run(df.unionByName(spark.createDataFrame([(6, "new")], df.schema)))
    u = cache.usage().first()
    assert (u.hits, u.misses, u.replayed_tokens, u.used_replayed_timings) == (3, 1, 3, True) and len(open(log).readlines()) == 4
    # another model shares nothing
    vector_cache.VectorCache(spark, path).encoded(df, "text", "m2", lambda: Counting(log)).count()
    assert len(open(log).readlines()) == 7


def test_damaged_entries_are_misses(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "oak"), (2, "elm")], "id int, text string")
    vector_cache.VectorCache(spark, path).encoded(df, "text", "m").count()
    for folder, _, names in os.walk(tmp_path / "cache"):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{folder}/{n}", "wb") as f:
                    f.write(b"not a table at all")
            elif n.endswith(".crc"):
                os.remove(f"{folder}/{n}")
    cache = vector_cache.VectorCache(spark, path)
    assert sorted(r.id for r in cache.encoded(df, "text", "m").collect()) == [1, 2]
    assert tuple(cache.usage().first())[:2] == (0, 2)


def test_one_entry_of_two_counts(spark, tmp_path):
    cache = vector_cache.VectorCache(spark, f"file://{tmp_path}/cache")
    for v in (1.0, 2.0):
        cache.batches.append(spark.createDataFrame([("k", [v], 1, 0.5)], "key string, vec array<double>, tokens long, seconds double"))
    rows = cache.entries().collect()
    assert len(rows) == 1 and rows[0].vec in ([1.0], [2.0]) and cache.entries().first().vec == rows[0].vec
