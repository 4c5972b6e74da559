import json

from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import audit
from memspark.sources import benchmark
from memspark.streaming import metering


def test_split(spark, tmp_path):
    turn = lambda r, c, **k: {"role": r, "content": c, **k}
    split = [
        {"question_id": "a", "question_type": "t", "question": "q", "answer": 3, "question_date": "2023/05/01 (Mon) 10:00", "haystack_session_ids": ["s1", "s2", "s3"], "haystack_dates": ["2023/01/01", "2023/01/02"],
         "haystack_sessions": [[turn("user", "x", has_answer=True), turn("assistant", "y")], [turn("user", "z")], [turn("user", "lost")]]},
        {"question_id": "b_abs", "question_type": "t", "question": "q", "answer": "none", "question_date": None, "haystack_session_ids": [], "haystack_dates": [], "haystack_sessions": []},
    ]
    (tmp_path / "split.json").write_text(json.dumps(split))
    questions, turns = benchmark.read_split(spark, str(tmp_path / "split.json"))
    assert {(r.question_id, r.gold, r.is_abstention) for r in questions.collect()} == {("a", "3", False), ("b_abs", "none", True)}
    assert benchmark.read_split(spark, str(tmp_path / "split.json"), limit=1)[0].count() == 1
    assert [(r.session_id, r.turn_index, r.content, r.has_answer) for r in turns.orderBy("turn_index").collect()] == [("s1", 0, "x", True), ("s1", 1, "y", False), ("s2", 2, "z", False)]


def test_arms_and_worksheets(spark, tmp_path):
    good = {"retriever": "bm25", "model": "m", "accuracy": 0.5, "records": [{"question_id": "a", "question_type": "t", "deterministic": True}, {"question_id": "b", "deterministic": False}, {"question_id": "c", "deterministic": None}]}
    (tmp_path / "e2e_one.json").write_text(json.dumps(good))
    (tmp_path / "e2e_two.json").write_text("{broken")
    rows = benchmark.read_arms(spark, str(tmp_path / "e2e_*.json")).collect()
    assert {(r.arm, r.question_id, r.question_type, r.correct) for r in rows} == {("one", "a", "t", True), ("one", "b", "?", False), ("one", "c", "?", None)}
    cut = good | {"records": [{"question_id": str(i), "deterministic": True, "prompt_tokens": 4096} for i in range(6)]}
    (tmp_path / "e2e_three.json").write_text(json.dumps(cut))
    assert {r.arm for r in benchmark.read_arms(spark, str(tmp_path / "e2e_*.json")).collect()} == {"one"}
    judged = spark.createDataFrame([("q", "x", "g", "p", True)], "question_id string, question string, gold string, pred string, judge boolean")
    benchmark.write_worksheet(judged, str(tmp_path / "sheet"))
    assert spark.read.json(str(tmp_path / "sheet")).columns == ["gold", "human_label", "pred", "question", "question_id"]
    assert benchmark.read_worksheet(spark, str(tmp_path / "sheet")).count() == 0
    labelled = spark.createDataFrame([("q", True), ("r", None)], "question_id string, human_label boolean")
    labelled.write.option("ignoreNullFields", "false").json(str(tmp_path / "labelled"))
    assert [(r.question_id, r.human_label) for r in benchmark.read_worksheet(spark, str(tmp_path / "labelled")).collect()] == [("q", True)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", ["purchase", "view"][i % 2], "x" * i) for i in range(30)]
    events = spark.createDataFrame(rows, "ts string, event_type string, props string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = metering.ledger(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("ledger_test").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("ledger_test").collect())) == sorted(map(tuple, metering.ledger(events).collect()))


def test_audits(spark):
    p = spark.createDataFrame([("a", 7)] * 6 + [("b", i) for i in range(6)] + [("c", 0)] * 6 + [("d", 5)] * 5, "arm string, prompt_tokens int")
    assert [r.arm for r in audit.clamped_arms(p).collect()] == ["a"]
    before = spark.createDataFrame([("x", True), ("y", None), ("z", None)], "question_id string, correct boolean")
    after = spark.createDataFrame([("x", True), ("y", False), ("z", None)], "question_id string, correct boolean")
    assert [r.question_id for r in audit.changed_verdicts(before, after).collect()] == ["y"]


def test_digits_survive_the_sentence_split(spark):
    row = spark.createDataFrame([("0 a. 1 b. 2 c.",)], "t string").select(T.sentences(F.col("t")), T.set_items(F.lit("0 x, 1 y and 2 z"))).first()
    assert row[0] == ["0 a.", "1 b.", "2 c."] and row[1] == ["0 x", "1 y", "2 z"]
