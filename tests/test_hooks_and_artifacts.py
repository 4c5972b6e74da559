"""Encoders, caches, backends, judges, artifacts, names and reports, on fakes and hand-built files."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from memspark.operators import audit, costs, dates, hooks, metrics, policies, retrieve, runs, survival, units, vector_index
from memspark.sources import artifacts

TURN = "question_id string, session_id string, session_index int, session_date string, turn_index int, role string, content string, has_answer boolean"


# the workers cannot import a test module: its fakes travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Lengths:
    """A fake encoder: a text's length and its number of spaces."""

    def encode(self, texts):
        return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float64)


class Echo:
    """A fake client: says the last line of the prompt, tells its usage for every second call."""

    def __init__(self):
        self.calls = 0

    def generate(self, prompt, max_new_tokens):
        self.calls += 1
        told = (len(prompt), 3) if "known" in prompt else (None, None)
        return prompt.splitlines()[-1][: 4 * max_new_tokens] if prompt else "", *told


def test_encoding_gives_unit_vectors_and_prefixes_queries(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab cd", "", None, "x" * 9])], "i int, text string").withColumn("vec", F.lit("clash"))
    got = {r.i: r.vec for r in hooks.encoded(df, "text", "plain", Lengths).collect()}
    assert got[0] == pytest.approx([5 / 26**0.5, 1 / 26**0.5]) and got[1] == got[2] == [0.0, 0.0] and got[3] == [1.0, 0.0]
    asked = hooks.encoded(df.where("i = 3"), "text", "some-bge-small", Lengths, query=True).first().vec
    n, s = len(hooks.QUERY_PREFIX) + 9, hooks.QUERY_PREFIX.count(" ")
    assert asked == pytest.approx([n / (n * n + s * s) ** 0.5, s / (n * n + s * s) ** 0.5])
    assert hooks.encoded(df.limit(0), "text", "plain", Lengths).count() == 0


def test_vector_cache(spark, tmp_path):
    groups = spark.createDataFrame([("a", ["ab", "c"]), ("b", ["a", "bc"]), ("c", ["x"]), ("d", [])], "cache_key string, texts array<string>")
    keys = {r.cache_key: r.key for r in groups.withColumn("key", hooks.content_key("m", F.lit("same"), F.col("texts"))).collect()}
    assert len(set(keys.values())) == 4 and all(len(k) == 20 for k in keys.values())  # the same bytes, cut elsewhere, are other texts
    first = hooks.cache_get(groups, spark.createDataFrame([], "key string, vectors array<array<double>>, cost double"), "m")
    assert tuple(hooks.cache_stats(first).first()) == (0, 4, False)
    new = first.where("cache_key <> 'd'").withColumns({"vectors": F.transform("texts", lambda t: F.array(F.lit(1.0))), "cost": F.lit(2.5)})
    # one entry has too few vectors: that is a miss
    new = new.withColumn("vectors", F.when(F.col("cache_key") == "a", F.slice("vectors", 1, 1)).otherwise(F.col("vectors")))
    hooks.cache_put(new, str(tmp_path / "cache"))
    again = hooks.cache_get(groups, spark.read.parquet(str(tmp_path / "cache")), "m")
    assert {r.cache_key: (r.hit, r.cost) for r in again.collect()} == {"a": (False, None), "b": (True, 2.5), "c": (True, 2.5), "d": (False, None)}
    assert hooks.cache_get(groups, spark.read.parquet(str(tmp_path / "cache")), "another").where("hit").count() == 0


def test_prompts_predictions_and_judges(spark):
    q = spark.createDataFrame([("q1", "Who?", "2023/01/02"), ("q2", "Where?", None)], "question_id string, question string, question_date string")
    ctx = spark.createDataFrame([("q1", "[d] known fact")], "query_id string, context string")
    rows = {r.question_id: r.prompt for r in hooks.prompts(q, ctx, closed_book=True).collect()}
    assert "[d] known fact" in rows["q1"] and "Today's date is 2023/01/02." in rows["q1"] and "excerpts" not in rows["q2"] and "Question: Where?" in rows["q2"]
    assert "excerpts" in {r.question_id: r.prompt for r in hooks.prompts(q, ctx).collect()}["q2"]
    got = {r.question_id: r for r in hooks.predictions(hooks.prompts(q, ctx), "echo", Echo).collect()}
    assert got["q1"].pred == "Answer concisely." and not got["q1"].estimated and got["q1"].completion_tokens == 3
    assert got["q2"].estimated and got["q2"].prompt_tokens == len(got["q2"].prompt) // 4 and got["q2"].completion_tokens == 4
    answers = spark.createDataFrame([("a", "g", "CORRECT", False), ("b", "g", "INCORRECT", False), ("c", "g", "well", True)], "question string, gold string, pred string, is_abstention boolean")
    seen = {r.question: (r.pred, r.verdict) for r in hooks.judged(answers, "judge", Echo, "{question}\n{gold}\n{pred}", "abstains: {pred}").collect()}
    assert seen == {"a": ("CORRECT", True), "b": ("INCORRECT", False), "c": ("well", None)}


def test_timer_adds_up_phases():
    t = hooks.Timer()
    for _ in range(2):
        with t.phase("write"):
            pass
    assert t.seconds["write"] > 0 and t.seconds["read"] == 0
    with pytest.raises(ValueError, match="phase"), t.phase("other"):
        pass


def run(n, granularity="turn", weight=0.0, ranks=()):
    per = [{"question_id": f"q{i}", "question_type": "t", "n_evidence": 0 if r == "none" else 1, "first_evidence_rank": None if r == "none" else r} for i, r in enumerate(ranks)]
    return {"config": {"granularity": granularity, "recency_weight": weight}, "metrics": {"n_total": n, "mrr": 0.5}, "per_question": per}


def test_runs_are_read_from_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"bm25": run(100, ranks=(0, None, "none", 3)), "hybrid_rw0.5": run(100, weight=0.5)}))
    (tmp_path / "b.json").write_text(json.dumps({"bm25": run(100, ranks=(1,)), "dense": run(7, "session")}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text(json.dumps({"tokens": {"mean": 3}}))
    (tmp_path / "e.json").write_text("[1, 2]")
    got = artifacts.read_runs(spark, str(tmp_path / "*.json"))
    rows = {(r.name, r.granularity, r.n): len(r.per_question) for r in got.collect()}
    assert rows == {("bm25", "turn", 100): 1, ("hybrid_rw0.5", "turn", 100): 0, ("dense", "session", 7): 0}  # the later file has bm25
    assert [r.name for r in got.where(artifacts.is_recency_variant(F.col("name"))).collect()] == ["hybrid_rw0.5"]
    order = [r.name for r in got.orderBy(*artifacts.table_order(F.col("name"), F.col("granularity"))).collect()]
    assert order == ["bm25", "dense", "hybrid_rw0.5"]
    one = artifacts.read_runs(spark, str(tmp_path / "a.json"))
    assert {r.question_id: r.rr for r in artifacts.reciprocal_ranks(one).collect()} == {"q0": 1.0, "q1": 0.0, "q3": 0.25}


def outcome(store, q, record, tokens=40, records=4, primary=True, kind="t"):
    return (store, "p", q, kind, "2-3", primary, record, record, record, 0.5, 0.5, 0.5, records, tokens)


OUTCOME = "store string, policy string, question_id string, question_type string, bucket string, in_primary boolean, record boolean, soft boolean, union_hit boolean, null_record double, null_soft double, null_union double, n_records long, store_tokens long"


def test_survival_artifacts(spark, tmp_path):
    stored = {"store_id": "leadk_25pct", "policy_config": {"policy": "leadk"}, "records": [{"question_id": "q1", "question_type": "t", "gold_len_bucket": "1", "in_primary": True, "survival_record": True, "n_records": 3}]}
    other = stored | {"store_id": "verbatim_turn", "policy_config": None}
    for name, x in (("survival_a", stored), ("survival_b", other)):
        (tmp_path / f"{name}.json").write_text(json.dumps(x))
    (tmp_path / "survival_c.json").write_text("{broken")
    old = artifacts.read_stores(spark, str(tmp_path / "survival_*.json"))
    assert {(r.store, r.policy, r.record, r.n_records) for r in old.collect()} == {("leadk_25pct", "leadk", True, 3), ("verbatim_turn", "?", True, 3)}
    now = spark.createDataFrame([outcome("leadk_25pct", "q1", False), outcome("leadk_25pct", "q2", False, primary=False)], OUTCOME)
    both = artifacts.union_current(old, now)
    assert {(r.store, r.question_id, r.record) for r in both.collect()} == {("verbatim_turn", "q1", True), ("leadk_25pct", "q1", False), ("leadk_25pct", "q2", False)}
    assert {(r.arm, r.question_id, r.correct) for r in artifacts.store_arms(both).collect()} == {("verbatim_turn", "q1", True), ("leadk_25pct", "q1", False)}


def test_stores_are_paired_and_compared_at_one_budget(spark):
    rows = [outcome(s, f"q{i}", i % k == 0, tokens=t) for s, k, t in (("verbatim_turn", 1, 100), ("leadk_25pct", 2, 25), ("tailk_25pct", 4, 24), ("lexrank_10pct", 3, 10)) for i in range(40)]
    df = spark.createDataFrame(rows, OUTCOME)
    table = survival.store_table(df).orderBy("place").collect()
    assert [r.store for r in table] == ["verbatim_turn", "leadk_25pct", "tailk_25pct", "lexrank_10pct"] and table[0].corrected == 1.0
    paired = {r.arm: r for r in artifacts.paired_with(df, "verbatim_turn", 500).collect()}
    assert paired["leadk_25pct"].difference == -0.5 and paired["leadk_25pct"].hi < 0 and paired["leadk_25pct"].p == pytest.approx(2 * 0.5**20, abs=1e-9)
    budgets = {(r.percent, r.selector): r for r in artifacts.matched_budgets(df, 500).collect()}
    assert set(budgets) == {(25, "leadk"), (25, "tailk")}  # one selector alone compares with nothing
    assert budgets[25, "leadk"].difference is None and budgets[25, "tailk"].difference == -0.25 and budgets[25, "tailk"].tokens_per_record == 6
    assert artifacts.paired_with(df.limit(0), "verbatim_turn", 10).count() == 0


def test_lift_with_intervals_and_types(spark):
    rows = [("sys", False, i, ["a", None][i % 2], i < 70) for i in range(100)] + [("weak", True, i, None, i < 20) for i in range(100)] + [("sys", False, 100, "a", None)]
    graded = spark.createDataFrame(rows, "arm string, is_control boolean, question_id int, question_type string, correct boolean")
    chosen = runs.strongest_control(graded)
    r = runs.lift_intervals(graded, chosen, 500).first()
    assert (r.lift, r.significant) == (0.5, True) and 0.35 < r.ci_lo < 0.5 < r.ci_hi < 0.65
    assert {x.question_type: (x.n, x.lift) for x in runs.lift_by_type(graded, chosen).collect()} == {"a": (50, 0.5), "?": (50, 0.5)}
    assert runs.lift_intervals(graded.where("not is_control"), runs.strongest_control(graded.where("not is_control")), 10).count() == 0


def test_published_costs_and_curves(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"read": {"systems": [{"name": "A", "tokens": 5}, {"name": "B", "tokens": 7}, {"name": "B", "tokens": 9}]}}, indent=1))
    assert artifacts.published_cost(spark, str(tmp_path / "p.json"), "read", "tokens", "B") == 7
    with pytest.raises(ValueError, match="no C"):
        artifacts.published_cost(spark, str(tmp_path / "p.json"), "read", "tokens", "C")
    curve = {(r.series, r.n_queries): r.dollars for r in artifacts.cost_curves(spark, {"x": (1e6, 1e3)}, 3).collect()}
    assert curve["x", 3] == pytest.approx(0.15 + 3 * 0.15e-3) and len(curve) == 3


def test_results_and_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, score double")
    for _ in range(2):
        artifacts.write_result(df, str(tmp_path / "r"))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("name", "score").collect()} == {("a", 0.5), ("b", None)}
    assert artifacts.markdown(df.orderBy("name")) == "| name | score |\n|---|---|\n| a | 0.500 |\n| b | -- |"
    with pytest.raises(ValueError, match="more than 1"):
        artifacts.markdown(df, 1)
    before = spark.createDataFrame([("x", "q1", True), ("x", "q2", None)], "arm string, question_id string, correct boolean")
    changed = spark.createDataFrame([("x", "q2", False)], "arm string, question_id string, after boolean")
    out = artifacts.write_regraded(before, changed, str(tmp_path / "g"))
    assert {tuple(r) for r in out.select("question_id", "correct").collect()} == {("q1", True), ("q2", False)} and spark.read.json(str(tmp_path / "g")).count() == 2


def test_policy_names_and_manifests(spark):
    names = {s: policies.parse(s).name for s in ("verbatim_session", "leadk_25", "truncated_random_5_s2", "truncated_recency_100")}
    assert names == {"verbatim_session": "verbatim_session", "leadk_25": "leadk_25pct", "truncated_random_5_s2": "truncated_random_5pct_s2", "truncated_recency_100": "truncated_recency_100pct"}
    config = policies.parse("truncated_random_5_s2").config()
    assert config == {"policy": "truncated_verbatim", "fraction": 0.05, "rule": "random", "seed": 2, "granularity": "turn"}
    assert spark.range(1).select(artifacts.manifest(config).alias("m")).first().m["fraction"] == "0.05"
    u = spark.createDataFrame([("q", 0, "text", "s", "2023/01/01", 0, False)], "question_id string, unit_id int, text string, session_id string, session_date string, session_index int, is_evidence boolean")
    assert policies.build(u, "verbatim_turn").collect() == u.collect()


def test_retriever_factory_and_hybrid(spark):
    rows = [("q0", "s", i, "2023/01/01", i, "user", t, i == 1) for i, t in enumerate(["cats sleep", "dogs bark loudly", "birds sing"])]
    u = units.build(spark.createDataFrame(rows, TURN), "user_turn")
    q = spark.createDataFrame([("q0", "which dogs bark")], "question_id string, question string")
    for name in ("bm25", "dense", "hybrid", "oracle"):
        assert retrieve.retriever(name)(u, q, 2).orderBy("rank").first().unit_id == 1, name
    assert retrieve.retriever("none")(u, q, 2).count() == 0 and retrieve.retriever("random")(u, q, 2).count() == 2
    assert retrieve.arm_name("hybrid", 0.5) == "hybrid_rw0.5" and retrieve.arm_name("hybrid") == "hybrid" and retrieve.arm_name("bm25", 1) == "bm25"
    with pytest.raises(ValueError, match="unknown retriever"):
        retrieve.retriever("oracles")


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "unit_id long, vec array<double>").repartition(3)
    queries = df.where("unit_id < 9").withColumnRenamed("unit_id", "query_id")
    want = {q: [i for _, i in sorted((-round(float(x[q] @ x[i]), 6), i) for i in range(60) if i != q)[:4]] for q in range(9)}
    other = queries.unionByName(spark.createDataFrame([(50, [1.0, 2.0])], queries.schema))
    for block, most in ((2, 1 << 20), (100, 1 << 20), (4, 0)):
        index, got = vector_index.packed(df, "unit_id", block), {}
        for r in vector_index.search(index, other, 4, block, most).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.unit_id)
        # no unit has the length of the last query
        assert got == want
    assert vector_index.search(vector_index.packed(df, "unit_id"), queries.limit(0), 4).count() == 0
    assert vector_index.search(vector_index.packed(df.limit(0), "unit_id"), queries, 4).count() == 0


def test_vector_index_is_stored_once(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i}", [float(i), 1.0]) for i in range(9)], "unit_id string, vec array<double>")
    df.write.parquet(f"file://{tmp_path}/table")
    table = spark.read.parquet(f"file://{tmp_path}/table")
    first = vector_index.stored(table, table)
    made = first.inputFiles()
    assert sorted(vector_index.stored(table, table).inputFiles()) == sorted(made)
    hits = vector_index.search(first, spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<double>"), 2)
    assert [(r.unit_id, r.score) for r in hits.orderBy("rank").collect()] == [("u8", 8.0), ("u7", 7.0)]
    df.limit(3).write.mode("append").parquet(f"file://{tmp_path}/table")
    table = spark.read.parquet(f"file://{tmp_path}/table")
    assert not set(vector_index.stored(table, table).inputFiles()) & set(made)


def test_plans_do_not_grow_with_queries(spark):
    df = spark.range(3000).selectExpr("id AS unit_id", "array(sin(id), cos(id)) AS vec")
    index = vector_index.packed(df, "unit_id")
    plan = lambda n: vector_index.search(index, df.limit(n).withColumnRenamed("unit_id", "query_id"), 3)._jdf.queryExecution().logical().toString().count("\n")
    assert plan(5) == plan(3000)
    assert vector_index.search(index, df.withColumnRenamed("unit_id", "query_id"), 3).count() == 9000


def test_items_are_found_in_documents(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox yy"), (2, "the quick brown fo"), (3, "aab"), (4, None)], "unit_id long, text string")
    items = spark.createDataFrame([("a", "e quick brown fo"), ("b", "ab"), ("c", "quick brown"), ("d", None), ("e", "no such words here")], "query_id string, text string")
    assert sorted(map(tuple, retrieve.holding(docs, items).collect())) == [("a", 1), ("a", 2), ("b", 3), ("c", 1), ("c", 2)]


def test_greedy_fill_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(f"q{q}", i, int(c)) for q in range(6) for i, c in enumerate(rng.integers(1, 30, 40))]
    total = {f"q{q}": sum(c for k, _, c in rows if k == f"q{q}") for q in range(6)}
    df = spark.createDataFrame([(*r, total[r[0]]) for r in rows], "question_id string, item int, tokens long, total long")
    for fraction in (0.02, 0.3, 1.0):
        got = {(r.question_id, r.item) for r in policies.fill(df, fraction, "item").collect()}
        want = set()
        for q in total:
            used = 0
            for k, i, c in rows:
                if k == q and used + c <= fraction * total[q]:
                    used += c
                    want.add((q, i))
        assert got == want


def test_order_statistics_of_a_histogram(spark):
    values = [("a", v) for v in [5, 1, 1, 9, 9, 9, 2, 7, 3, 3]] + [("b", 4), (None, 8)]
    got = {r.g: (r.n, r["mean"], r.median, r.p90, r["max"]) for r in metrics.order_statistics(spark.createDataFrame(values, "g string, v long"), "v", "g").collect()}
    a = sorted(v for g, v in values if g == "a")
    assert got == {"a": (10, 4.9, a[5], a[9], 9), "b": (1, 4.0, 4, 4, 4), None: (1, 8.0, 8, 8, 8)}


def test_store_limit_is_an_error(spark):
    rows = [("q", f"m{i}", 0, "t", "2023/01/01", [0]) for i in range(3)]
    df = spark.createDataFrame(rows, "question_id string, memory_id string, batch int, text string, session_date string, turns array<int>")
    assert costs.extracted_store(df, 4).count() == 3
    with pytest.raises(Exception, match="limit"):
        costs.extracted_store(df, 3).collect()


def test_eligible_types_and_exclusions(spark):
    kinds = ["single-session-user", "single-session-assistant", "knowledge-update", "multi-session", "temporal-reasoning"]
    rows = [(k, k, "q", "red car", False) for k in kinds] + [("x", kinds[0], "q", "red car", True), ("y", kinds[0], "q", " ".join("abcdefghijklmn"), False), ("z", kinds[0], "q", "not enough information", False)]
    q = spark.createDataFrame(rows, "question_id string, question_type string, question string, gold string, is_abstention boolean")
    assert {r.question_id for r in survival.routed(q).where("eligible").collect()} == set(kinds[:3])
    assert tuple(survival.exclusions(q).first()) == (8, 1, 1, 1, 5, 3)


def test_survival_accepts_alternatives_and_enumerations(spark):
    u = spark.createDataFrame([("q1", 0, "it took four days"), ("q2", 0, "leeks, then beans and carrots"), ("q3", 0, "leeks, then beans and carrots")], "question_id string, unit_id int, text string")
    rows = [("q1", "t", "how long", "3 days or 4 days", False), ("q2", "t", "which ones", "beans, carrots, leeks", False), ("q3", "t", "in what order", "beans, carrots, leeks", False)]
    q = spark.createDataFrame(rows, "question_id string, question_type string, question string, gold string, is_abstention boolean")
    got = {r.question_id: (r.record, r.union_hit) for r in survival.score(u, q, 2).collect()}
    assert got == {"q1": (True, True), "q2": (True, True), "q3": (False, False)}


def test_audit_rates(spark):
    q = spark.createDataFrame([("a", "t", "how many", "2 cats"), ("b", "t", "price", "100 guests")], "question_id string, question_type string, question string, gold string")
    none = spark.createDataFrame([("z_abs", "t", "what", "not enough information")], q.schema)
    r = audit.rates(audit.cases(q, none)).first()
    assert (r.accuracy, r.false_accept_rate, r.false_reject_rate, r.false_reject_rate_hard) == (1.0, 0.0, 0.0, 0.0) and r.n_cases == r.n_graded


def test_dates_of_no_rows(spark):
    empty = spark.createDataFrame([], TURN)
    asked = spark.createDataFrame([], "question_id string, question_date string")
    assert dates.leaks(units.build(empty, "turn"), units.build(empty, "session"), asked).count() == 0
