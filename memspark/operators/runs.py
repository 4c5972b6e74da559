"""Comparing runs: results per arm, best and matched runs, sweeps, strongest controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators import metrics


def results(hits: DataFrame, evidence: DataFrame, questions: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, query_id, question_type, n_evidence, ranks): every arm and question, found or not."""
    found = hits.join(evidence, ["query_id", "unit_id"], "left_semi").groupBy("arm", "query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    wanted = evidence.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    every = questions.select("query_id", "question_type", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")).join(wanted, "query_id", "left").join(found, ["arm", "query_id"], "left")
    return every.select("arm", "query_id", "question_type", F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"))


def reciprocal(ranks: str = "ranks") -> Column:
    return F.when(F.size(ranks) > 0, 1.0 / (F.get(ranks, F.lit(0)) + 1)).otherwise(0.0)


def best(runs: DataFrame) -> DataFrame:
    """The run with most questions of each (name, granularity)."""
    nth = F.row_number().over(Window.partitionBy("name", "granularity").orderBy(F.col("n").desc()))
    return runs.withColumn("nth", nth).where("nth = 1").drop("nth")


def matched(runs: DataFrame, granularities: list[str]) -> DataFrame:
    """The runs at the largest n that every granularity has; none if there is no such n."""
    wanted = runs.where(F.col("granularity").isin(granularities))
    common = wanted.groupBy("n").agg(F.count_distinct("granularity").alias("g")).where(F.col("g") == len(granularities)).agg(F.max("n").alias("n"))
    return wanted.join(F.broadcast(common), "n")


def sweep_grid(per_question: DataFrame, arms: list[str]) -> DataFrame:
    """MRR per question type, one column per arm."""
    rows = per_question.where("n_evidence > 0").groupBy("question_type").pivot("arm", arms)
    return rows.agg(F.round(F.avg(reciprocal()), 6))


def paired_mrr(per_question: DataFrame, base: str, arm: str, replicates: int = 10_000) -> DataFrame:
    """(n, point, lo, hi) of the difference in reciprocal rank on shared questions, by a
    bootstrap with interpolated quantiles."""
    rr = per_question.where("n_evidence > 0").select("arm", "query_id", reciprocal().alias("rr"))
    pairs = rr.where(F.col("arm") == base).select("query_id", F.col("rr").alias("b")).join(rr.where(F.col("arm") == arm).select("query_id", F.col("rr").alias("a")), "query_id")
    diffs = metrics.positions(pairs.select("query_id", (F.col("a") - F.col("b")).alias("value")), "query_id")
    return metrics.bootstrap_mean(diffs.select("pos", "value"), replicates, interpolate=True)


def paired_arms(arms: DataFrame, baseline: str, replicates: int = 10_000, *group: str) -> DataFrame:
    """(group..., arm, n, difference, lo, hi, p) of every other arm against ``baseline`` on the
    questions that both have graded.

    arms(group..., arm, question_id, correct).  One driver step per pair of arms: they are
    systems, not rows."""
    graded = arms.where(F.col("correct").isNotNull())
    base = graded.where(F.col("arm") == baseline).select(*group, "question_id", F.col("correct").alias("control"))
    pairs = graded.where(F.col("arm") != baseline).withColumnRenamed("correct", "system").join(base, [*group, "question_id"])
    keys = [*group, "arm"]
    table = metrics.contingency(pairs, *keys).select(*keys, "n", F.round((F.col("system_only") - F.col("control_only")) / F.col("n"), 6).alias("difference"), F.round(metrics.mcnemar(F.col("system_only"), F.col("control_only")), 9).alias("p"))
    diffs = pairs.select(*keys, "question_id", (F.col("system").cast("int") - F.col("control").cast("int")).cast("double").alias("value"))
    bounds = None
    for key in table.select(*keys).distinct().collect():
        mine = diffs
        for k in keys:
            mine = mine.where(F.col(k) == key[k])
        part = metrics.bootstrap_mean(metrics.positions(mine, "question_id").select("pos", "value"), replicates).select(*[F.lit(key[k]).alias(k) for k in keys], "lo", "hi")
        bounds = part if bounds is None else bounds.unionByName(part)
    if bounds is None:
        return table.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    return table.join(F.broadcast(bounds), keys)


def lift_by_type(graded: DataFrame, chosen: DataFrame) -> DataFrame:
    """(system_arm, question_type, n, system_accuracy, control_accuracy, lift) of systems against the
    controls of ``strongest_control``; graded also has question_type, which may be null ('?')."""
    g = graded.where(F.col("correct").isNotNull())
    pick = F.broadcast(chosen.select("system_arm", "control_arm"))
    s = g.select(F.col("arm").alias("system_arm"), "question_id", F.coalesce("question_type", F.lit("?")).alias("question_type"), F.col("correct").alias("system")).join(pick, "system_arm")
    c = g.select(F.col("arm").alias("control_arm"), "question_id", F.col("correct").alias("control"))
    mean = lambda x: F.avg(F.col(x).cast("int"))
    return s.join(c, ["control_arm", "question_id"]).groupBy("system_arm", "question_type").agg(
        F.count("*").alias("n"), F.round(mean("system"), 6).alias("system_accuracy"), F.round(mean("control"), 6).alias("control_accuracy"), F.round(mean("system") - mean("control"), 6).alias("lift"),
    )


def lift_intervals(graded: DataFrame, chosen: DataFrame, replicates: int = 10_000) -> DataFrame:
    """``chosen`` (of ``strongest_control``) with the bootstrap interval of the lift, and whether
    it is significant: p under 0.05 and an interval above zero."""
    out = None
    for r in chosen.select("system_arm", "control_arm").collect():  # a row per system
        pair = graded.where(F.col("arm").isin(r.system_arm, r.control_arm))
        part = paired_arms(pair, r.control_arm, replicates).select(F.col("arm").alias("system_arm"), F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return chosen.withColumns({"ci_lo": F.lit(None).cast("double"), "ci_hi": F.lit(None).cast("double"), "significant": F.lit(False)})
    return chosen.join(out, "system_arm").withColumn("significant", (F.col("p") < 0.05) & (F.col("ci_lo") > 0))


def strongest_control(graded: DataFrame) -> DataFrame:
    """Each system against its strongest control on the questions both have graded.

    graded(arm, is_control, question_id, correct); an arm has a question once; of
    equally strong controls the first by name counts.
    """
    g = graded.where(F.col("correct").isNotNull())
    s = g.where(~F.col("is_control")).select(F.col("arm").alias("system_arm"), "question_id", F.col("correct").alias("system"))
    c = g.where("is_control").select(F.col("arm").alias("control_arm"), "question_id", F.col("correct").alias("control"))
    per = metrics.contingency(s.join(c, "question_id"), "system_arm", "control_arm")
    acc = (F.col("both") + F.col("control_only")) / F.col("n")
    nth = F.row_number().over(Window.partitionBy("system_arm").orderBy(acc.desc(), "control_arm"))
    top = per.withColumn("nth", nth).where("nth = 1")
    sys_acc = (F.col("both") + F.col("system_only")) / F.col("n")
    return top.select(
        "system_arm", "control_arm", "n", F.round(sys_acc, 6).alias("system_accuracy"), F.round(acc, 6).alias("control_accuracy"), F.round(sys_acc - acc, 6).alias("lift"),
        F.round(F.when(sys_acc > 0, (sys_acc - acc) / sys_acc).otherwise(0.0), 6).alias("attributable"), F.round(metrics.mcnemar(F.col("system_only"), F.col("control_only")), 9).alias("p"),
    )
