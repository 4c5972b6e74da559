import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from memspark.llm.common import saved

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    body = lambda i: " ".join(f"thing{i}x{k} and the" for k in range(60))
    rows = [(i, f"the same footer\n{body(i)}", "en", f"s{i % 10}", 0) for i in range(20)]
    rows += [(30, f"the same footer\n{body(3)} more", "en", "s1", 0), (31, "1234 5678", "en", "s1", 0), (32, None, "en", "s2", 0), (33, "the same footer", "en", "s3", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark, docs):
    kept, at = {}, docs
    for name, stage in pipeline.STAGES:
        at = saved(stage(spark, at, ""), name)
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "pack_sequences":
            assert at.columns == docs.columns
    assert kept["language_id"] == {*range(20), 30, 33}
    assert kept["line_dedup"] == {*range(20), 30}
    assert kept["near_duplicates"] == set(range(20))
    assert kept["mix_sources"] <= kept["near_duplicates"] and kept["pack_sequences"] == kept["mix_sources"]
    assert at.agg(F.count("*")).first()[0] > 0


def test_empty(spark, docs):
    at = docs.limit(0)
    for name, stage in pipeline.STAGES:
        at = saved(stage(spark, at, ""), name)
    assert at.count() == 0


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
