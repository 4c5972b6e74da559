"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicate
removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet in the shared folder and rereads it for the next; what a later stage has
read and written anew is deleted.

Defined cases: those of the operators; rows without an id stand alone in the
near-duplicate stage and stay; an empty table gives an empty result; further
columns of ``docs`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import jaccard, langid, lines, mixing, packing
from memspark.llm.common import WORD, discard, saved

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (no letters, or no language that is likelier than not);
    ``lang`` becomes the language found."""
    found = langid.identify(docs, F.col("lang"), F.col("source")).where("accepted")
    return found.withColumn("lang", F.col("lang_id")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines are cut; documents left without a word, all of whose lines
    stand in another document, go."""
    out = lines.remove_boilerplate(docs, min_sites=8).where(F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the smallest id stays."""
    groups = jaccard.near_duplicates(docs, n=5, num=80, den=100)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    # rows that share an id: equal texts are one document
    kept = kept.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"]).drop("text_hash")
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them; the last one of a source may be cut."""
    mixed = mixing.mixed_rows(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER), max_len=1024)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language ID, mixing and tokenisation have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
