"""Registered queries that compare runs: audits, sweeps, costs, survival tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import audit, costs, dates, hooks, metrics, policies, replies, retrieve, runs, survival, vector_index
from memspark.plans.queries import QUERIES, abstentions, eligible, predictions, query, questions, turn_units, vectors
from memspark.sources import artifacts, batches, fixtures, stage
from memspark.sources.stage import saved

__all__ = ["QUERIES"]

ARMS = ["bm25", "none", "oracle", "random", "recency"]
SWEEP = {"w0": 0.0, "w025": 0.25, "w05": 0.5, "w1": 1.0}
GRANULARITIES = ["session", "turn"]


def named(**rankings: DataFrame) -> DataFrame:
    """The rankings as hits(arm, query_id, unit_id, rank)."""
    out = None
    for name, hits in rankings.items():
        part = hits.select(F.lit(name).alias("arm"), "query_id", "unit_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def asked_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).withColumnRenamed("question_id", "query_id")


def evidence(units: DataFrame) -> DataFrame:
    return units.where("is_evidence").select(F.col("question_id").alias("query_id"), "unit_id")


def arm_results(spark: SparkSession, d: str) -> DataFrame:
    u, q = turn_units(spark, d), questions(spark, d)
    hits = named(bm25=retrieve.question_bm25(u, q, 20), oracle=retrieve.oracle(u, 20), random=retrieve.random(u, 20), recency=retrieve.recency(u, 20))
    return runs.results(hits, evidence(u), asked_questions(spark, d), ARMS)


def sweep_results(spark: SparkSession, d: str) -> DataFrame:
    u, q = turn_units(spark, d), questions(spark, d)
    hits = named(**{name: retrieve.hybrid(u, q, 10, recency_weight=w) for name, w in SWEEP.items()})
    return runs.results(hits, evidence(u), asked_questions(spark, d), list(SWEEP))


@query
def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    return metrics.aggregate(arm_results(spark, d), "arm", "question_type")


@query
def recency_sweep(spark: SparkSession, d: str) -> DataFrame:
    return runs.sweep_grid(sweep_results(spark, d), list(SWEEP))


@query
def paired_dmrr(spark: SparkSession, d: str) -> DataFrame:
    return runs.paired_mrr(sweep_results(spark, d), "w0", "w1")


def labelled_results(spark: SparkSession, d: str) -> DataFrame:
    """Dense results of every 25th vector; vectors of its label are its evidence."""
    e = fixtures.read(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vec"), "label")
    q = e.where("unit_id % 25 = 0").select(F.col("unit_id").alias("query_id"), "vec", "label")
    hits = vector_index.search(*vectors(spark, d), 20)
    sizes = e.groupBy("label").agg(F.count("*").alias("n"))
    wanted = q.join(sizes, "label", "left").select("query_id", "label", (F.coalesce("n", F.lit(1)) - 1).alias("n_evidence"))
    labels = e.select("unit_id", "label")
    same = hits.join(labels, "unit_id").join(q.select("query_id", F.col("label").alias("own")), "query_id").where("label = own")
    found = same.groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    return wanted.join(found, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


@query
def hit_recall_gap(spark: SparkSession, d: str) -> DataFrame:
    """Labels for which a hit overstates recall by a tenth or more."""
    gap = F.col("any_hit_10") - F.col("recall_10")
    return metrics.aggregate(labelled_results(spark, d), "label").where(gap >= 0.1).select("label", "any_hit_10", "recall_10", F.round(gap, 6).alias("gap"))


@query
def dense_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.aggregate(labelled_results(spark, d))


def stored_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs (name, granularity, n, mrr): by turn over all questions and over the half of them that a
    hash picks, by session over that half."""
    q, half = asked_questions(spark, d), F.substring(F.md5(F.col("query_id").cast("binary")), 1, 1) < "8"
    out = None
    for granularity, sizes in (("turn", (F.lit(True), half)), ("session", (half,))):
        u = turn_units(spark, d, granularity)
        per = runs.results(named(oracle=retrieve.oracle(u), recency=retrieve.recency(u)), evidence(u), q, ["oracle", "recency"])
        for n in sizes:
            part = per.where(n).groupBy(F.col("arm").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg(runs.reciprocal()), 6).alias("mrr"))
            part = part.select("name", F.lit(granularity).alias("granularity"), "n", "mrr")
            out = part if out is None else out.unionByName(part)
    return out


@query
def best_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.best(stored_runs(spark, d))


@query
def matched_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.matched(stored_runs(spark, d), GRANULARITIES)


def graded_arms(spark: SparkSession, d: str) -> DataFrame:
    """Two systems and three controls on the labelled documents."""
    docs, labels = fixtures.read(spark, d, "documents"), fixtures.read(spark, d, "labels")
    verdicts = {("quality", False): F.col("quality") == 1, ("clean", False): F.col("toxic") == 0, ("long", True): F.col("n_chars") > 1000, ("short", True): F.col("n_chars") <= 200, ("even", True): F.col("doc_id") % 2 == 0}
    one = lambda arm, control, v: F.struct(F.lit(arm).alias("arm"), F.lit(control).alias("is_control"), v.alias("correct"))
    rows = labels.join(docs.select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("question_type"), F.inline(F.array(*[one(a, c, v) for (a, c), v in verdicts.items()])))


@query
def strongest_control(spark: SparkSession, d: str) -> DataFrame:
    return runs.strongest_control(graded_arms(spark, d))


@query
def lift_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Systems against their strongest controls, with the interval of the lift."""
    graded = graded_arms(spark, d)
    return runs.lift_intervals(graded, runs.strongest_control(graded)).select("system_arm", "control_arm", "lift", "ci_lo", "ci_hi", "significant")


@query
def lift_by_type(spark: SparkSession, d: str) -> DataFrame:
    graded = graded_arms(spark, d)
    return runs.lift_by_type(graded, runs.strongest_control(graded))


@query
def date_positions(spark: SparkSession, d: str) -> DataFrame:
    return dates.positions(turn_units(spark, d, "session"), fixtures.asked(spark, d))


@query
def date_gaps(spark: SparkSession, d: str) -> DataFrame:
    return dates.gaps(turn_units(spark, d, "session"), fixtures.asked(spark, d))


@query
def date_ordering(spark: SparkSession, d: str) -> DataFrame:
    sessions, asked, out = turn_units(spark, d, "session"), fixtures.asked(spark, d), None
    for g in ("session", "user_turn", "turn"):
        part = dates.ordering(turn_units(spark, d, g), sessions, asked).select(F.lit(g).alias("granularity"), "resolution", "agree", "differ")
        out = part if out is None else out.unionByName(part)
    return out


@query
def date_leaks(spark: SparkSession, d: str) -> DataFrame:
    return dates.leaks(turn_units(spark, d), turn_units(spark, d, "session"), fixtures.asked(spark, d))


@query
def date_leak_types(spark: SparkSession, d: str) -> DataFrame:
    rows = date_leaks(spark, d).join(questions(spark, d).select("question_id", "question_type"), "question_id", "left")
    some = F.col("n_post_evidence") > 0
    return rows.groupBy(F.coalesce("question_type", F.lit("?")).alias("question_type")).agg(
        F.count("*").alias("n_sessions"), F.count_if(some).alias("n_evidence"), F.count_if(some & (F.col("n_post_evidence") == F.col("n_evidence"))).alias("n_all_evidence"), F.max("overshoot").alias("overshoot"),
    )


@query
def date_origin(spark: SparkSession, d: str) -> DataFrame:
    return dates.origin_deviation(turn_units(spark, d, "session"), fixtures.asked(spark, d))


@query
def write_calls(spark: SparkSession, d: str) -> DataFrame:
    return costs.write_calls(fixtures.turns(spark, d))


@query
def write_cost_model(spark: SparkSession, d: str) -> DataFrame:
    return costs.write_cost(fixtures.turns(spark, d))


@query
def write_cost_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return costs.sensitivity(fixtures.turns(spark, d))


def metered(spark: SparkSession, d: str) -> DataFrame:
    """Events as metered calls; clicks are embeddings, every fifth call reports no usage."""
    e = fixtures.read(spark, d, "events")
    size = F.length(F.coalesce("props", F.lit(""))).cast("long")
    return e.select(
        "user_id", F.when(F.col("event_type") == "click", "embed").otherwise("llm").alias("kind"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("phase"),
        (F.col("event_id") % 3 + 1).alias("n_items"), F.when(F.col("event_id") % 5 != 0, size).alias("prompt_tokens"), F.floor(size / 4).alias("estimate"), (F.col("event_id") % 7).alias("completion_tokens"),
    )


@query
def meter_events(spark: SparkSession, d: str) -> DataFrame:
    return costs.meter(metered(spark, d), "user_id")


@query
def ledger_dollars(spark: SparkSession, d: str) -> DataFrame:
    """Write and read side by side per user, in dollars of two models and one without a price."""
    rows = costs.meter(metered(spark, d), "user_id")
    wide = rows.groupBy("user_id").pivot("phase", ["write", "read"]).agg(F.sum("llm_prompt_tokens").alias("prompt"), F.sum("llm_completion_tokens").alias("completion"))
    wide = wide.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("write_prompt", "write_completion", "read_prompt", "read_completion")])
    model = F.element_at(F.array(F.lit("gpt-4o-mini"), F.lit("gpt-4o"), F.lit("unpriced")), (F.col("user_id") % 3 + 1).cast("int"))
    price = lambda phase: costs.dollars(model, F.col(f"{phase}_prompt"), F.col(f"{phase}_completion"))
    return wide.select("*", F.round(price("write") + 100 * price("read"), 9).alias("dollars_100_queries"))


@query
def ledger_records(spark: SparkSession, d: str) -> DataFrame:
    """Each user's ledger as the nested record that results carry."""
    rows = costs.records(costs.meter(metered(spark, d), "user_id"), "user_id")
    return rows.select("user_id", F.to_json("cost").alias("cost"))


@query
def stored_memories(spark: SparkSession, d: str) -> DataFrame:
    """``extracted_store`` over memories that a store has exported and that are read back."""
    t = fixtures.turns(spark, d)
    path = f"{stage.shared_dir(spark)}/memories-{uuid.uuid4().hex}"
    rows = t.select("question_id", F.concat_ws("/", "session_id", F.col("turn_index") % 2).alias("memory_id"), F.floor(F.col("turn_index") / 2).cast("int").alias("batch"), F.col("content").alias("text"), "session_date", F.array("turn_index").alias("turns"))
    rows.write.json(path)
    out = costs.extracted_store(artifacts.read_memories(spark, path))
    return out.withColumn("provenance", F.array_join("provenance", ","))


@query
def extracted_store(spark: SparkSession, d: str) -> DataFrame:
    """Turns as versions of memories: one memory per session and half of its turns, in pair batches."""
    t = fixtures.turns(spark, d)
    rows = t.select("question_id", F.concat_ws("/", "session_id", F.col("turn_index") % 2).alias("memory_id"), F.floor(F.col("turn_index") / 2).alias("batch"), F.col("content").alias("text"), "session_date", F.array("turn_index").alias("turns"))
    out = costs.extracted_store(rows)
    return out.withColumn("provenance", F.array_join("provenance", ","))


@query
def eligible_questions(spark: SparkSession, d: str) -> DataFrame:
    return survival.routed(questions(spark, d).drop("question"))


@query
def benchmark_audit(spark: SparkSession, d: str) -> DataFrame:
    return survival.location_rates(survival.locations(fixtures.turns(spark, d), questions(spark, d)))


@query
def answer_location(spark: SparkSession, d: str) -> DataFrame:
    return survival.fates(survival.locations(fixtures.turns(spark, d), questions(spark, d)))


@query
def placebo_pool(spark: SparkSession, d: str) -> DataFrame:
    return survival.placebos(eligible(spark, d))


def survival_rows(spark: SparkSession, d: str) -> DataFrame:
    return survival.score(turn_units(spark, d), eligible(spark, d))


@query
def survival_groups(spark: SparkSession, d: str) -> DataFrame:
    return survival.groups(survival_rows(spark, d))


@query
def bootstrap_corrected(spark: SparkSession, d: str) -> DataFrame:
    rows = survival_rows(spark, d).select("question_id", F.col("soft").cast("double").alias("score"), F.col("null_soft").alias("floor"))
    return metrics.bootstrap_corrected(metrics.positions(rows, "question_id").select("pos", "score", "floor"))


def store_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of three selectors at two budgets, scored in one pass and kept: the
    comparisons read them many times."""
    u, q, stores = saved(turn_units(spark, d), "units"), saved(eligible(spark, d), "questions"), None
    for spec in ("leadk_25", "tailk_25", "lexrank_25", "leadk_50", "tailk_50", "lexrank_50"):
        part = policies.build(u, spec).select(F.lit(policies.parse(spec).name).alias("store"), "question_id", "unit_id", "text")
        stores = part if stores is None else stores.unionByName(part)
    return saved(survival.score(saved(stores, "stores"), q, survival.PLACEBOS, "store"), "outcomes")


@query
def survival_stores(spark: SparkSession, d: str) -> DataFrame:
    """Stores of the policies that SQL can follow, the largest first."""
    return survival.store_table(survival.score(stores(spark, d, "verbatim_turn", "leadk_25", "tailk_25"), eligible(spark, d), survival.PLACEBOS, "store"))


def stores(spark: SparkSession, d: str, *specs: str) -> DataFrame:
    """Units (store, question_id, unit_id, text) of several policies."""
    u, out = turn_units(spark, d), None
    for spec in specs:
        part = policies.build(u, spec).select(F.lit(policies.parse(spec).name).alias("store"), "question_id", "unit_id", "text")
        out = part if out is None else out.unionByName(part)
    return out


@query
def selector_budgets(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.matched_budgets(store_outcomes(spark, d))


@query
def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return survival.exclusions(questions(spark, d))


@query
def cost_curves(spark: SparkSession, d: str) -> DataFrame:
    """Dollars by number of queries: whole context against ten retrieved units and an extracting system, by the texts' measured tokens."""
    u = turn_units(spark, d).withColumn("tokens", T.count_tokens(F.col("text")).cast("long"))
    s = u.agg(F.avg("tokens").alias("unit"), (F.sum("tokens") / F.count_distinct("question_id")).alias("full")).first()
    return artifacts.cost_curves(spark, {"full": (0.0, s.full or 0.0), "retrieved": (0.0, 10 * (s.unit or 0.0)), "extracting": (1_233_500.0, 1764.0)}, 200).withColumn("dollars", F.round("dollars", 9))


@query
def matched_budget_selectors(spark: SparkSession, d: str) -> DataFrame:
    """First against last sentences at one budget: records, tokens, and paired survival."""
    q = eligible(spark, d)
    scored = survival.score(stores(spark, d, "leadk_25", "tailk_25"), q, 0, "store")
    found = lambda store: scored.where(F.col("store") == store).select("question_id", "record", "n_records", "store_tokens")
    first, last = "leadk_25pct", "tailk_25pct"
    pairs = q.select("question_id").join(found(first), "question_id", "left").join(found(last).toDF("question_id", "other", "other_records", "other_tokens"), "question_id", "left")
    pairs = pairs.withColumns({"system": F.coalesce("other", F.lit(False)), "control": F.coalesce("record", F.lit(False))})
    stats = pairs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("n_records", "lead_records"), ("store_tokens", "lead_tokens"), ("other_records", "tail_records"), ("other_tokens", "tail_tokens"))])
    c = metrics.contingency(pairs.select("system", "control"))
    return stats.crossJoin(c).select("*", F.round(metrics.mcnemar(F.col("system_only"), F.col("control_only")), 9).alias("p"))


@query
def arm_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and F1 of gradable predictions, per type and in all."""
    p = predictions(spark, d)
    rows = p.select("question_type", T.grade(F.col("pred"), F.col("gold"), F.col("is_abstention"), F.col("question")).alias("correct"), T.token_f1(T.normal_tokens(F.col("pred")), T.normal_tokens(F.col("gold"))).alias("f1"))
    return rows.rollup("question_type").agg(
        F.count("correct").alias("n_gradable"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("correct").isNotNull(), F.col("f1"))), 6).alias("f1"),
    ).withColumn("question_type", F.coalesce("question_type", F.lit("all")))


@query
def regrade_diff(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that change when predictions are cut to eight words."""
    p = predictions(spark, d).withColumn("question_id", F.concat_ws("/", "question_id", "turn_index"))
    verdict = lambda text: p.select("question_id", T.grade(text, F.col("gold"), F.col("is_abstention"), F.col("question")).alias("correct"))
    return audit.changed_verdicts(verdict(F.col("pred")), verdict(T.cap_words(F.col("pred"), 8)))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a judge's raw reply and a deterministic verdict."""
    reply = F.when(F.col("doc_id") % 7 == 0, "I am not sure.").when(F.col("quality") == 1, "Verdict: correct.").otherwise("This is INCORRECT.")
    docs = fixtures.read(spark, d, "documents").select("doc_id", "n_chars")
    return fixtures.read(spark, d, "labels").join(docs, "doc_id").select("doc_id", T.parse_verdict(reply).alias("judge"), (F.col("n_chars") > 1000).alias("deterministic"))


@query
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("doc_id", "judge")


@query
def disagreements(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).where(F.col("judge") != F.col("deterministic"))


@query
def judge_validation(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the judge with the rule, with the usual band of its kappa."""
    k = metrics.kappa(judged(spark, d).select(F.col("deterministic").alias("human"), "judge"))
    return k.withColumn("band", F.when(F.col("kappa") >= 0.8, "strong").when(F.col("kappa") >= 0.6, "moderate").otherwise("weak"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt lengths per role as an arm; the system's are all cut to one length."""
    sent = T.count_tokens(F.col("content")).cast("long")
    t = fixtures.turns(spark, d)
    return t.select(F.col("role").alias("arm"), "question_id", sent.alias("sent"), F.when(F.col("role") == "system", F.lit(16).cast("long")).otherwise(F.least(sent, F.lit(40))).alias("prompt_tokens"))


@query
def judge_audit(spark: SparkSession, d: str) -> DataFrame:
    """The grader on all constructed cases and a judge, which needs no model, on the first 400, asked each prompt once."""
    store = replies.ReplyStore(spark, f"{stage.shared_dir(spark)}/replies-{uuid.uuid4().hex}")
    mark = hooks.ContainmentJudge.MARK
    return audit.judged_rates(audit.cases(questions(spark, d), abstentions(spark, d)), store, "containment", hooks.ContainmentJudge, "{gold}" + mark + "{pred}", mark + "{pred}")


@query
def resumed_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal ranks of two arms in a sweep that was cut off: the first run had one arm on a
    third of the questions, the second makes the rest; asked tells how many it made."""
    u, q = turn_units(spark, d), questions(spark, d)
    sweep = batches.Sweep(spark, f"{stage.shared_dir(spark)}/sweep-{uuid.uuid4().hex}", "rr double")

    def arm(find: Callable[[DataFrame, DataFrame, int], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def answer(some: DataFrame) -> DataFrame:
            hits = named(x=find(u.join(some.select("question_id"), "question_id", "left_semi"), some, 20))
            found = runs.results(hits, evidence(u), some.withColumnRenamed("question_id", "query_id"), ["x"])
            return found.select(F.col("query_id").alias("question_id"), F.round(runs.reciprocal(), 6).alias("rr"))

        return answer

    arms = {"bm25": arm(retrieve.question_bm25), "recency": arm(lambda some, _, k: retrieve.recency(some, k))}
    sweep.run(q.where(F.regexp_extract("question_id", r"\d+", 0).cast("int") % 3 == 0), {"bm25": arms["bm25"]})
    asked = sweep.run(q, arms)
    counted = F.create_map(*[F.lit(x) for kv in asked.items() for x in kv])
    return sweep.results().withColumn("asked", F.element_at(counted, F.col("arm")).cast("long"))


@query
def clamped_arms(spark: SparkSession, d: str) -> DataFrame:
    return audit.clamped_arms(prompts(spark, d))


@query
def truncated_prompts(spark: SparkSession, d: str) -> DataFrame:
    return audit.truncated_prompts(prompts(spark, d), num_ctx=64, max_new=8)


@query
def model_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and sizes of model names made of the documents' languages and ids."""
    size = F.element_at(F.array(*[F.lit(x) for x in ("1.5b", "14b", "350m", "instruct")]), (F.col("doc_id") % 4 + 1).cast("int"))
    names = fixtures.read(spark, d, "documents").select(F.concat(F.coalesce("lang", F.lit("x")), F.when(F.col("doc_id") % 3 == 0, "-").otherwise(":"), F.lit("net-"), size).alias("name")).distinct()
    return names.select("name", T.model_label(F.col("name")).alias("label"), T.parameters(T.model_label(F.col("name"))).alias("parameters"))


@query
def sentence_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of a unit's sentences that share a term."""
    return policies.sentence_cosines(turn_units(spark, d))


@query
def temporal_misses(spark: SparkSession, d: str) -> DataFrame:
    """Twenty questions of one type whose gold is not in their evidence, in hash order, with the label of the document of their number."""
    rows = survival.locations(fixtures.turns(spark, d), questions(spark, d)).where("question_type = 'temporal-reasoning' AND NOT in_evidence AND bucket <> '1'")
    labels = fixtures.read(spark, d, "labels").select(F.col("doc_id").alias("number"), F.col("quality").alias("label"))
    rows = rows.withColumn("number", F.regexp_replace("question_id", "[a-z_]", "").cast("long"))
    drawn = rows.orderBy(F.md5(F.concat_ws("|", F.lit(0), "question_id").cast("binary"))).limit(20)
    return drawn.join(labels, "number", "left").select("question_id", "bucket", "label")
