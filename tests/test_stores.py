"""Several stores scored at once have the outcomes that each has by itself."""

import pytest
from pyspark.sql import functions as F

from memspark.operators import survival
from memspark.sources import stage


def test_stores_at_once(spark):
    units = spark.createDataFrame(
        [("a", "q1", 0, "The kettle is copper red."), ("a", "q2", 0, "nothing here"), ("b", "q1", 0, "copper"), ("b", "q1", 1, "red kettle"), ("b", "q2", 0, "We took the night ferry.")],
        "store string, question_id string, unit_id int, text string",
    )
    questions = spark.createDataFrame([("q1", "t", "Which colour?", "copper red"), ("q2", "t", "How?", "night ferry")], "question_id string, question_type string, question string, gold string")
    together = survival.score(stage.saved(units, "stores"), questions, 1, "store").collect()
    rows = {(r.store, r.question_id): (r.record, r.soft, r.union_hit, r.n_records) for r in together}
    assert rows == {("a", "q1"): (True, True, True, 1), ("a", "q2"): (False, False, False, 1), ("b", "q1"): (False, False, True, 2), ("b", "q2"): (True, True, True, 1)}
    alone = survival.score(units.where("store = 'b'").drop("store"), questions, 1).withColumn("store", F.lit("b")).select(*together[0].__fields__).collect()
    assert sorted(alone) == sorted(r for r in together if r.store == "b")


def test_shared_folder(spark):
    assert stage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_no_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        stage.shared_dir(Session)
