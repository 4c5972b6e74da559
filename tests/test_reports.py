"""Hand-built inputs for audits, dates, costs, runs and survival."""

import hashlib
import inspect

import pytest
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import audit, costs, dates, metrics, runs, survival, units
from memspark.sources import artifacts

TURN = "question_id string, session_id string, session_index int, session_date string, turn_index int, role string, content string, has_answer boolean"
QUESTION = "question_id string, question_type string, question string, gold string, is_abstention boolean"


def turns_of(spark, sizes, date="2023/01/01 (Sun) 10:00"):
    rows, at = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            rows.append(("q0", f"s{s}", s, date, at, "user", "x" * 34, False))
            at += 1
    return spark.createDataFrame(rows, TURN)


def test_batches_never_straddle_sessions(spark):
    starts = costs.batch_starts(turns_of(spark, (3, 4, 3)))
    got = starts.agg(*[F.count_if(b).alias(b) for b in costs.BATCHES]).first()
    assert tuple(got) == (10, 6, 3, 1)


def test_write_calls_send_ten_turns_again(spark):
    # every turn is ten tokens; a call at turn i sends the ten before it again
    rows = {r.batching: r for r in costs.write_calls(turns_of(spark, (12, 12))).collect()}
    assert rows["per_session"].resent == 100 and rows["per_conversation"].resent == 0
    assert rows["per_turn"].resent == 10 * (sum(range(10)) + 10 * 14) and rows["per_turn"].content == 240
    model = {r.batching: r for r in costs.write_cost(turns_of(spark, (12, 12))).collect()}
    total = 2 * (7671 + 200 + 300) + 100 + 240 + 2 * 300
    assert model["per_session"].total_tokens == total and model["per_session"].break_even == pytest.approx(total / 345)


def test_metering(spark):
    rows = [("llm", "write", 1, 100, 7, 5), ("llm", "write", 1, None, 7, 5), ("embed", "read", 3, 30, 7, 0)]
    got = {r.phase: r for r in costs.meter(spark.createDataFrame(rows, "kind string, phase string, n_items int, prompt_tokens int, estimate int, completion_tokens int")).collect()}
    assert (got["write"].llm_calls, got["write"].llm_prompt_tokens, got["write"].estimated) == (2, 107, True)
    assert (got["read"].embed_calls, got["read"].embed_tokens, got["read"].llm_calls, got["read"].estimated) == (3, 30, 0, False)


def test_extracted_store(spark):
    rows = [("q", "m1", 0, "old", "2023/01/01", [1, 0]), ("q", "m1", 1, "new", "2023/02/01", [2]), ("q", "m2", 0, "  ", "2023/01/01", [0])]
    out = costs.extracted_store(spark.createDataFrame(rows, "question_id string, memory_id string, batch int, text string, session_date string, turns array<int>")).collect()
    assert [(r.unit_id, r.text, r.session_date, r.provenance) for r in out] == [(0, "new", "2023/02/01", [0, 1, 2])]


def test_ledger_records_are_nested(spark):
    rows = [("a", "write", 1, 2, 3, 0, 0), ("a", "read", 4, 5, 6, 7, 8), ("b", "read", 1, 1, 1, 1, 1)]
    got = {r.u: r.cost.asDict(True) for r in costs.records(spark.createDataFrame(rows, "u string, phase string, " + ", ".join(f"{c} long" for c in costs.LEDGER)), "u").collect()}
    assert got["a"] == {"write": dict(zip(costs.LEDGER, (1, 2, 3, 0, 0), strict=True)), "read": dict(zip(costs.LEDGER, (4, 5, 6, 7, 8), strict=True))}
    assert got["b"]["write"] == dict.fromkeys(costs.LEDGER, 0)


def test_exported_memories(spark, tmp_path):
    lines = ['{"question_id": "q", "memory_id": "m", "batch": 0, "text": "old", "session_date": "d", "turns": [1]}', "not json", '{"memory_id": "m"}', '{"question_id": "q", "memory_id": "m", "batch": 2, "text": "new", "session_date": "e", "turns": [0, 1]}', '{"question_id": "q", "memory_id": "n", "text": "other"}']
    (tmp_path / "store.jsonl").write_text("\n".join(lines))
    out = costs.extracted_store(artifacts.read_memories(spark, f"file://{tmp_path}/store.jsonl")).orderBy("unit_id").collect()
    assert [(r.unit_id, r.text, r.session_date, r.provenance) for r in out] == [(0, "new", "e", [0, 1]), (1, "other", None, [])]


def test_many_rows_are_resampled_by_counts(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id AS pos", "CAST(id % 4 = 0 AS DOUBLE) AS value")
    exact = metrics.bootstrap_mean(rows, 400).first()
    monkeypatch.setattr(metrics, "BROADCAST_ROWS", 100)
    counted = metrics.bootstrap_mean(rows, 400).first()
    # the mean of 4,000 draws of which a quarter are ones has a deviation of 0.0068
    assert counted.point == exact.point == 0.25
    assert all(abs(getattr(counted, c) - want) < 0.004 for c, want in (("lo", 0.25 - 1.96 * 0.00685), ("hi", 0.25 + 1.96 * 0.00685)))
    assert counted == metrics.bootstrap_mean(rows, 400).first()
    paired = rows.selectExpr("pos", "value AS score", "0.2D AS floor")
    assert metrics.bootstrap_corrected(paired, 200).first().point == pytest.approx(0.0625)


def test_dates(spark):
    rows = [("2023/04/10 (Mon) 17:50",), ("2023/02/30 (Thu) 10:00",), ("0001/01/01",), ("never",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(dates.day_ordinal(F.col("t")).alias("d"), dates.minute_stamp(F.col("t")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(738620, 738620 * 1440 + 17 * 60 + 50), (None, None), (1, None), (None, None), (None, None)]


def test_date_audit_at_two_resolutions(spark):
    t = turns_of(spark, (2, 2), "2023/01/05 (Thu) 12:00")
    sessions, turn = units.build(t, "session"), units.build(t.withColumn("has_answer", F.lit(True)), "turn")
    asked = spark.createDataFrame([("q0", "2023/01/05 (Thu) 11:30")], "question_id string, question_date string")
    assert {(r.resolution, r.position, r.n) for r in dates.positions(sessions, asked).collect()} == {("day", "same", 1), ("minute", "after", 1)}
    leak = dates.leaks(turn, sessions, asked).first()
    assert (leak.n_post, leak.n_post_evidence, leak.n_evidence, leak.overshoot) == (4, 4, 4, 30)
    bad = spark.createDataFrame([("q0", "2023/02/30 (Thu) 11:30")], "question_id string, question_date string")
    assert dates.positions(sessions, bad).first().position == "unparsable" and dates.leaks(turn, sessions, bad).count() == 0
    assert dates.gaps(sessions, bad).first().n == 0


def test_matched_and_best_runs(spark):
    rows = [("bm25", "turn", 100), ("bm25", "turn", 500), ("bm25", "session", 100)]
    r = spark.createDataFrame(rows, "name string, granularity string, n int")
    assert {(x.granularity, x.n) for x in runs.best(r).collect()} == {("turn", 500), ("session", 100)}
    assert {(x.granularity, x.n) for x in runs.matched(r, ["turn", "session"]).collect()} == {("turn", 100), ("session", 100)}
    assert runs.matched(r.where("granularity = 'turn'"), ["turn", "session"]).count() == 0
    assert runs.matched(r.where("n = 500 OR granularity = 'session'"), ["turn", "session"]).count() == 0


def test_strongest_control_is_chosen_on_paired_questions(spark):
    rows = [("sys", False, i, i < 60) for i in range(100)] + [("weak", True, i, i < 10) for i in range(100)]
    rows += [("strong", True, i, i >= 20) for i in range(100)] + [("apart", True, i, True) for i in range(200, 300)]
    got = runs.strongest_control(spark.createDataFrame(rows, "arm string, is_control boolean, question_id int, correct boolean")).collect()
    assert [(g.control_arm, g.system_accuracy, g.control_accuracy, g.n) for g in got] == [("strong", 0.6, 0.8, 100)] and got[0].lift < 0


def test_positions_are_a_permutation(spark):
    got = metrics.positions(spark.range(1000).withColumnRenamed("id", "k"), "k", bins=7)
    assert sorted(r.pos for r in got.collect()) == list(range(1000))
    assert metrics.positions(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0


def test_bootstraps_draw_ten_thousand_replicates(spark):
    values = [0.0, 1.0, 1.0, -1.0, 0.5, 3.0]
    draw = lambda b, i: int(hashlib.md5(f"0|{b}|{i}".encode()).hexdigest()[:8], 16) % len(values)
    means = sorted(sum(values[draw(b, i)] for i in range(len(values))) / len(values) for b in range(10_000))
    rows = spark.createDataFrame(list(enumerate(values)), "pos long, value double")
    got = metrics.bootstrap_mean(rows).first()
    assert (got.lo, got.hi) == (round(means[250], 6), round(means[9750], 6))
    scored = rows.select("pos", F.col("value").alias("score"), F.lit(0.0).alias("floor"))
    got = metrics.bootstrap_corrected(scored).first()
    assert (got.lo, got.hi) == (round(means[250], 6), round(means[9750], 6))
    assert inspect.signature(runs.paired_mrr).parameters["replicates"].default == 10_000


def test_bootstrap_corrected(spark):
    rows = spark.range(50).select(F.col("id").alias("pos"), F.lit(0.8).alias("score"), F.lit(0.6).alias("floor"))
    got = metrics.bootstrap_corrected(rows, 20).first()
    assert (got.point, got.lo, got.hi) == (0.5, 0.5, 0.5)
    none = metrics.bootstrap_corrected(rows.withColumn("floor", F.lit(1.0)), 20).first()
    assert (none.point, none.lo, none.hi) == (None, None, None)


def test_placebos_match_type_and_length(spark):
    golds = [("q1", "t", "cashews"), ("q2", "t", "almonds"), ("q3", "t", "peanuts"), ("q4", "t", "one two three four"), ("q5", "u", "alone"), ("q6", "t", "peanuts")]
    q = spark.createDataFrame([(i, t, "", g, False) for i, t, g in golds], QUESTION)
    got = {}
    for r in survival.placebos(q, 5).collect():
        got.setdefault(r.question_id, set()).add(r.placebo)
    assert got["q3"] == got["q6"] == {"cashews", "almonds"} and got["q1"] == {"almonds", "peanuts"}
    assert got["q4"] == {"cashews", "almonds", "peanuts"} and "q5" not in got
    assert survival.placebos(q, 1).groupBy("question_id").count().agg(F.max("count")).first()[0] == 1


def test_survival_of_a_split_answer(spark):
    u = spark.createDataFrame([("q", 0, "We painted the hallway pale"), ("q", 1, "green with white trim")], "question_id string, unit_id int, text string")
    q = spark.createDataFrame([("q", "t", "", "pale green", False)], QUESTION)
    r = survival.score(u, q, 5).first()
    assert (r.record, r.union_hit, r.null_record, r.n_records, r.in_primary) == (False, True, 0.0, 2, True)


def test_verdicts_and_labels(spark):
    replies = [("CORRECT",), ("This is INCORRECT",), ("no idea",)]
    assert [r[0] for r in spark.createDataFrame(replies, "t string").select(T.parse_verdict(F.col("t"))).collect()] == [True, False, None]
    names = [("host:net-1.5b",), ("net-350m",), ("net",)]
    got = spark.createDataFrame(names, "t string").select(T.model_label(F.col("t")), T.parameters(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("net-1.5b", 1.5e9), ("net-350m", 3.5e8), ("net", float("inf"))]
    nums = [("3",), ("3.5",), (".",), ("3a",), ("",)]
    assert [r[0] for r in spark.createDataFrame(nums, "t string").select(T.is_numeral(F.col("t"))).collect()] == [True, True, False, False, False]


def test_audit_kinds(spark):
    golds = [
        ("a", "t", "how many", "2 cats"), ("b", "t", "when", "March 5"), ("c", "t", "price", "$640"), ("d", "t", "which", "cello, harp, and oboe"),
        ("e", "t", "in what order", "cello, harp, and oboe"), ("f", "t", "what", "blue bicycle"),
    ]
    q = spark.createDataFrame([(*g, False) for g in golds], QUESTION)
    none = spark.createDataFrame([("z_abs", "t", "what", "not enough information", True)], QUESTION)
    by = {}
    for r in audit.cases(q, none).collect():
        by.setdefault(r.kind, {})[r.question_id] = (r.pred, r.expected)
    assert by["hard_number_word"] == {"a": ("two cats", True), "b": ("March five", True)}
    assert by["hard_month_abbrev"] == {"b": ("Mar 5", True)} and by["hard_unit_expanded"] == {"c": ("640 dollars", True)}
    assert by["hard_list_reorder"] == {"d": ("harp, oboe, and cello", True)}
    assert by["reordered_ordered_list"] == {"e": ("harp, oboe, and cello", False)}
    assert by["hard_plural"]["f"] == ("blue bicycles", True) and by["perturbed_number"]["c"] == ("$647", False)
    assert "z_abs" in by["correct_abstention"] and "z_abs" in by["hallucinated_on_abstention"] and set(by["swapped_gold"]) < set("abcdef")
    assert all(not expected for pred, expected in by["swapped_gold"].values())
    report = {r.kind: r for r in audit.report(audit.cases(q, none)).collect()}
    for kind in ("identity", "padded", "sentence", "hard_number_word", "hard_month_abbrev", "hard_plural", "empty", "refusal_to_answerable", "correct_abstention", "hallucinated_on_abstention", "reordered_ordered_list", "hard_list_reorder"):
        assert report[kind].right == report[kind].n, kind
    # told nothing of the question, the grader takes the wrong order
    blind = audit.report(audit.cases(q, none).withColumn("question", F.lit(None).cast("string")))
    assert blind.where("kind = 'reordered_ordered_list'").first().false_accepts == 1


def test_placebos_weigh_as_often_as_they_come(spark):
    golds = ["often"] * 60 + [f"rare{i}" for i in range(20)] + ["own"] * 20
    q = spark.createDataFrame([(f"q{i}", "t", "", g, False) for i, g in enumerate(golds)], QUESTION)
    rows = survival.placebos(q, 10).join(q.select("question_id", "gold"), "question_id").collect()
    of_own = [r.placebo for r in rows if r.gold == "own"]
    # of the 80 other golds 60 are one
    assert len(of_own) == 200 and 140 <= of_own.count("often") <= 160 and "own" not in of_own
    assert len({frozenset(r.placebo for r in rows if r.question_id == f"q{i}") for i in range(80, 100)}) > 5
    assert all(sum(r.question_id == f"q{i}" for r in rows) == 10 for i in range(100))


def test_eligible_questions_alone_are_scored(spark):
    q = spark.createDataFrame([("a", "knowledge-update", "", "red fox", False), ("b", "temporal-reasoning", "", "two days", False), ("c", "knowledge-update", "", "blue jay", True)], QUESTION)
    assert [r.question_id for r in survival.routed(q).where("eligible").collect()] == ["a"]
