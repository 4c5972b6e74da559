"""Sweeps that go on where they ended, prompts asked once, artifacts graded anew, token vocabularies."""

import json

import pytest
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import audit, hooks, policies, replies
from memspark.sources import batches, benchmark, regrade, stage


def test_a_killed_sweep_goes_on(spark, tmp_path):
    q = spark.createDataFrame([(f"q{i}",) for i in range(10)], "question_id string")
    path, seen = f"file://{tmp_path}/sweep", []

    def answer(some):
        seen.append(sorted(r.question_id for r in some.collect()))
        return some.select("question_id", F.length("question_id").alias("score"))

    def fails(some):
        raise RuntimeError("killed")

    sweep = batches.Sweep(spark, path, "score int")
    assert sweep.results().count() == 0
    assert sweep.run(q.where("question_id < 'q4'"), {"a": answer}) == {"a": 4}
    with pytest.raises(RuntimeError, match="killed"):
        sweep.run(q, {"a": answer, "b": fails})
    again = batches.Sweep(spark, path, "score int")
    assert again.run(q, {"a": answer, "b": answer}) == {"a": 0, "b": 10}
    assert [len(s) for s in seen] == [4, 6, 10] and not set(seen[0]) & set(seen[1])
    fresh = batches.Sweep(spark, f"file://{tmp_path}/fresh", "score int")
    fresh.run(q, {"a": answer, "b": answer})
    assert sorted(again.results().collect()) == sorted(fresh.results().collect()) and again.results().count() == 20


def test_unfinished_batches_are_not_read(spark, tmp_path):
    table = batches.Batches(spark, f"file://{tmp_path}/t", "k string, v int", ["k"])
    table.append(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    # what a run leaves behind that was killed while it wrote
    spark.createDataFrame([("c", 3, "x")], "k string, v int, batch string").write.parquet(f"file://{tmp_path}/t/_making-x")
    assert sorted(map(tuple, table.rows().collect())) == [("a", 1), ("b", 2)]
    table.append(spark.createDataFrame([("a", 9)], "k string, v int"))
    rows = {r.k: r.v for r in table.rows().collect()}
    assert rows["b"] == 2 and rows["a"] in (1, 9)
    assert [r.k for r in table.missing(spark.createDataFrame([("a",), ("z",)], "k string")).collect()] == ["z"]


def test_prompts_are_asked_once(spark, tmp_path):
    class Judge:
        def __init__(self, log):
            self.log = log

        def generate(self, prompt, max_new_tokens):
            with open(self.log, "a") as f:
                f.write(f"{prompt!r}\n")
            return ("CORRECT" if "yes" in prompt else "incorrect"), None, 2

    log = str(tmp_path / "log")
    rows = [(1, "Q", "g", "yes", False), (2, "Q", "g", "yes", False), (3, "Q", "g", "no", False), (4, "Q", "g", "no", True), (5, "Q", "g", None, False)]
    answers = spark.createDataFrame(rows, "i int, question string, gold string, pred string, is_abstention boolean").withColumn("verdict", F.lit("clash"))
    store = replies.ReplyStore(spark, f"file://{tmp_path}/replies")
    run = lambda s: {r.i: (r.pred, r.verdict) for r in s.judged(answers, "j", lambda: Judge(log), "{question} {gold} {pred}", "none: {pred}").collect()}
    want = {1: ("yes", True), 2: ("yes", True), 3: ("no", False), 4: ("no", False), 5: (None, False)}
    assert run(store) == want and store.asked == 4 and len(open(log).readlines()) == 4
    again = replies.ReplyStore(spark, f"file://{tmp_path}/replies")
    assert run(again) == want and again.asked == 0 and len(open(log).readlines()) == 4


def test_a_judge_sees_the_first_cases(spark, tmp_path):
    q = spark.createDataFrame([(f"q{i}", "t", "what", f"thing{i} stuff", False) for i in range(6)], "question_id string, question_type string, question string, gold string, is_abstention boolean")
    cases = audit.cases(q, q.limit(0))
    store, mark = replies.ReplyStore(spark, f"file://{tmp_path}/replies"), hooks.ContainmentJudge.MARK
    rows = {r.grader: r for r in audit.judged_rates(cases, store, "c", hooks.ContainmentJudge, "{gold}" + mark + "{pred}", mark + "{pred}", limit=7).collect()}
    assert rows["judge:c"].n_cases == 7 and rows["deterministic"].n_cases == cases.count() and store.asked <= 7
    assert not rows["deterministic"].too_lenient
    lenient = cases.withColumns({"expected": F.lit(False)})
    assert audit.judged_rates(lenient, store, "c", hooks.ContainmentJudge, "{gold}" + mark + "{pred}", mark + "{pred}").where("too_lenient").count() == 1


def artifact(records, **more):
    return {"retriever": "x", "n_examples": len(records), "accuracy": 0.5, "records": records, "nested": {"deep": [1, {"k": None}]}} | more


def record(i, pred, gold, verdict, question="What?", **more):
    return {"question_id": f"q{i}", "question_type": "t", "question": question, "gold": gold, "pred": pred, "is_abstention": False, "deterministic": verdict, "prompt_tokens": 7} | more


def test_a_folder_is_regraded(spark, tmp_path):
    right = [record(0, "It was a heron.", "heron", True), record(1, "No idea at all", "owl", False)]
    wrong = [record(0, "rye, oats, barley", "barley, oats, and rye", True, "In what order?"), record(1, "a wren", "wren", None, extra=[1, 2])]
    files = {"e2e_a.json": json.dumps(artifact(right)), "e2e_b.json": json.dumps(artifact(wrong)), "e2e_c.json": "{not json", "e2e_d.json": '{"other": 1}', "note.json": json.dumps(artifact(wrong))}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    changed = regrade.regrade(spark, f"file://{tmp_path}/e2e_*.json")
    assert sorted((r.question_id, r.before, r.after) for r in changed.collect()) == [("q0", True, False), ("q1", None, True)]
    assert all((tmp_path / n).read_text() == t for n, t in files.items())  # a dry run
    assert regrade.regrade(spark, f"file://{tmp_path}/e2e_*.json", write=True).count() == 2
    assert all((tmp_path / n).read_text() == t for n, t in files.items() if n != "e2e_b.json")
    new = json.loads((tmp_path / "e2e_b.json").read_text())
    assert [r["deterministic"] for r in new["records"]] == [False, True] and new["records"][1]["extra"] == [1, 2] and new["nested"] == {"deep": [1, {"k": None}]}
    assert (new["accuracy"], new["n_graded"], new["n_not_gradable"]) == (0.5, 2, 0) and new["accuracy_by_question_type"] == {"t": {"n": 2, "correct": 1, "accuracy": 0.5}}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == sorted(files)
    # nothing is left to change
    assert regrade.regrade(spark, f"file://{tmp_path}/e2e_*.json", write=True).count() == 0
    arms = benchmark.read_arms(spark, f"file://{tmp_path}/e2e_b.json")
    assert sorted(r.correct for r in arms.collect()) == [False, True]


def test_one_setting_counts_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = ["", "Hello there, world!", "naïve café 日本", "<|endoftext|> is text", "a" * 50, None]
    df = spark.createDataFrame([("q", i, t) for i, t in enumerate(texts)], "question_id string, unit_id int, text string")
    rule = [r[0] for r in df.orderBy("unit_id").select(T.count_tokens(F.col("text"))).collect()]
    assert rule == [1, 4, 3, 5, 12, 1]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    spark.conf.set(T.TOKENIZER, path)
    try:
        assert [r[0] for r in df.orderBy("unit_id").select(T.count_tokens(F.col("text"))).collect()] == want != rule
        # budgets follow
        assert policies.costed(df).first().total == sum(want)
    finally:
        spark.conf.unset(T.TOKENIZER)
    assert policies.costed(df).first().total == sum(rule)


def test_turns_by_hand(spark):
    """Rows that the queries' fixtures derive, spelt out."""
    from memspark.sources import fixtures

    long = "x" * 60
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", long), (11, 0, "user", None), (90, 0, "user", long)]
    path = f"{stage.shared_dir(spark)}/by-hand"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    got = sorted((r.question_id, r.session_id, r.session_index, r.session_date, r.turn_index, r.content, r.has_answer) for r in fixtures.turns(spark, path).collect())
    assert got == [
        ("q0", "s0", 0, "2023/01/01 (Mon) 10:00", 0, "hi", False), ("q0", "s0", 0, "2023/01/01 (Mon) 10:00", 1, long, True),
        ("q1", "s11", 1, "2023/12/12 (Mon) 10:00", 0, "", False), ("q9_abs", "s90", 0, "2023/07/07 (Mon) 10:00", 0, long, False),
    ]
