"""Run artifacts: JSON results of retrieval, answering and survival runs, read and written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.operators import metrics, runs

# The order of systems and granularities in tables, and the selectors compared at one budget.
SYSTEMS = ("random", "recency", "bm25", "dense", "hybrid", "oracle")
GRANULARITIES = ("turn", "user_turn", "session")
SELECTORS = ("leadk", "tailk", "lexrank")
# End of fixed values.
PER_QUESTION = "array<struct<question_id:string,question_type:string,n_evidence:long,first_evidence_rank:long>>"
RUN = f"struct<config:struct<granularity:string,recency_weight:double>,metrics:map<string,string>,per_question:{PER_QUESTION}>"
STORE = (
    "store_id string, policy_config struct<policy:string>, records array<struct<question_id:string,question_type:string,gold_len_bucket:string,in_primary:boolean,"
    "survival_record:boolean,survival_soft:boolean,survival_union:boolean,null_record:double,null_soft:double,null_union:double,n_records:long,store_tokens:long>>"
)


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """runs(name, granularity, n, metrics, per_question) of all artifacts of ``glob``: objects
    keyed by retriever whose values hold metrics.  Files that do not parse and other
    objects are passed over; of equal keys the file that is last by name counts."""
    raw = spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"map<string,{RUN}>").alias("of"))
    rows = raw.select("file", F.explode("of").alias("name", "run")).where(F.col("run.metrics").isNotNull())
    rows = rows.select(
        "file", "name", F.coalesce("run.config.granularity", F.lit("?")).alias("granularity"), F.coalesce(F.element_at("run.metrics", "n_total").cast("long"), F.lit(0)).alias("n"), F.col("run.metrics").alias("metrics"), F.col("run.per_question").alias("per_question"),
    )
    nth = F.row_number().over(Window.partitionBy("name", "granularity", "n").orderBy(F.col("file").desc()))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth", "file")


def is_recency_variant(name: Column) -> Column:
    """A hybrid at one weight of recency: a setting, not a system of its own."""
    return name.startswith("hybrid_rw")


def table_order(name: Column, granularity: Column) -> list[Column]:
    """Sort keys of tables: systems and granularities in their fixed order, others after them."""
    place = lambda c, of: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in of]), c), F.lit(0).cast("long")), F.lit(len(of) + 1).cast("long"))
    return [place(name, SYSTEMS), name, place(granularity, GRANULARITIES), granularity]


def reciprocal_ranks(stored: DataFrame) -> DataFrame:
    """(name, granularity, n, question_id, question_type, rr): questions with evidence; 0 if none was found."""
    rows = stored.select("name", "granularity", "n", F.inline("per_question")).where("n_evidence > 0")
    rr = F.when(F.col("first_evidence_rank").isNull(), 0.0).otherwise(1.0 / (F.col("first_evidence_rank") + 1))
    return rows.select("name", "granularity", "n", "question_id", "question_type", rr.alias("rr"))


def read_stores(spark: SparkSession, glob: str) -> DataFrame:
    """Survival outcomes (store, policy, question_id, ...) of all stored survival artifacts."""
    raw = spark.read.schema(STORE).option("multiLine", True).option("mode", "PERMISSIVE").json(glob).where(F.col("store_id").isNotNull())
    rows = raw.select(F.col("store_id").alias("store"), F.coalesce("policy_config.policy", F.lit("?")).alias("policy"), F.explode("records").alias("r")).select("store", "policy", "r.*")
    return rows.withColumnsRenamed({"gold_len_bucket": "bucket", "survival_record": "record", "survival_soft": "soft", "survival_union": "union_hit"})


def read_memories(spark: SparkSession, glob: str) -> DataFrame:
    """Versions of memories that external stores have exported as JSON lines, as ``costs.extracted_store``
    takes them: (question_id, memory_id, batch, text, session_date, turns).  Lines that do not
    parse, or name no question or memory, are passed over."""
    raw = spark.read.schema("question_id string, memory_id string, batch int, text string, session_date string, turns array<int>").option("mode", "PERMISSIVE").json(glob)
    rows = raw.where("question_id IS NOT NULL AND memory_id IS NOT NULL")
    return rows.withColumns({"batch": F.coalesce("batch", F.lit(0)), "turns": F.coalesce("turns", F.array().cast("array<int>"))})


def union_current(stored: DataFrame, current: DataFrame, key: str = "store") -> DataFrame:
    """All stored outcomes and those of this run; a store of this run replaces the stored one whole."""
    return stored.join(current.select(key).distinct(), key, "left_anti").unionByName(current, allowMissingColumns=True)


def store_arms(outcomes: DataFrame) -> DataFrame:
    """Arms (arm, question_id, question_type, correct) of survival outcomes: the primary questions, correct if the record survives."""
    return outcomes.where("in_primary").select(F.col("store").alias("arm"), "question_id", "question_type", F.col("record").alias("correct"))


def paired_with(outcomes: DataFrame, baseline: str, replicates: int = 10_000) -> DataFrame:
    """(arm, n, difference, lo, hi, p) of every store against ``baseline`` on the primary questions of both."""
    return runs.paired_arms(store_arms(outcomes), baseline, replicates)


def matched_budgets(outcomes: DataFrame, replicates: int = 10_000) -> DataFrame:
    """Selectors at equal budgets: (percent, selector, records, tokens_per_record, corrected) and,
    but for the first selector, its difference from the first at that budget with interval and p."""
    named = F.regexp_extract("store", r"^(" + "|".join(SELECTORS) + r")_([0-9]+)pct$", 1), F.regexp_extract("store", r"_([0-9]+)pct$", 1)
    rows = outcomes.withColumns({"selector": named[0], "percent": named[1]}).where("selector <> ''").withColumn("percent", F.expr("try_cast(percent AS INT)"))
    kinds = rows.groupBy("percent").agg(F.collect_set("selector").alias("kinds")).where((F.size("kinds") > 1) & F.array_contains("kinds", SELECTORS[0])).select("percent")
    rows = rows.join(kinds, "percent")
    primary = lambda c: F.avg(F.when(F.col("in_primary"), F.col(c).cast("double")))
    table = rows.groupBy("percent", "selector").agg(
        F.round(F.avg("n_records"), 6).alias("records"), F.round(F.avg(F.when(F.col("n_records") > 0, F.col("store_tokens") / F.col("n_records"))), 6).alias("tokens_per_record"),
        F.round(metrics.chance_corrected(primary("record"), primary("null_record")), 6).alias("corrected"),
    )
    arms = rows.where("in_primary").select("percent", F.col("selector").alias("arm"), "question_id", "question_type", F.col("record").alias("correct"))
    compared = runs.paired_arms(arms, SELECTORS[0], replicates, "percent")
    return table.join(compared.withColumnRenamed("arm", "selector"), ["percent", "selector"], "left")


def published_cost(spark: SparkSession, path: str, block: str, field: str, name: str) -> float:
    """A number that a publication reports for a system: of the first system of that name in a block."""
    raw = spark.read.option("multiLine", True).schema(f"{block} struct<systems:array<struct<name:string,{field}:double>>>").json(path)
    found = raw.select(F.posexplode(f"{block}.systems").alias("pos", "s")).where(F.col("s.name") == name).orderBy("pos").select(f"s.{field}").first()
    if found is None:
        raise ValueError(f"{path}: no {name} in {block}")
    return found[0]


def cost_curves(spark: SparkSession, curves: dict[str, tuple[float, float]], max_queries: int = 20_000, price: float = 0.15) -> DataFrame:
    """(series, n_queries, dollars): tokens written once and tokens read per query, at a price per million."""
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.lit(w).alias("w"), F.lit(r).alias("r")) for k, (w, r) in curves.items()]))
    rows = spark.range(1, max_queries + 1).select(F.col("id").alias("n_queries"), ends.alias("c"))
    return rows.select("c.series", "n_queries", ((F.col("c.w") + F.col("n_queries") * F.col("c.r")) * price / 1e6).alias("dollars"))


def context_tokens(n_units: Column, mean_tokens: Column) -> Column:
    return n_units * mean_tokens


def write_result(df: DataFrame, path: str) -> None:
    """A result as JSON lines, nulls written out; an earlier one is replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small result as a Markdown table; it is an error if it has more than ``rows`` rows."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows")
    cell = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(map(cell, r)) + " |" for r in found]])


def write_regraded(before: DataFrame, changed: DataFrame, path: str | None = None) -> DataFrame:
    """Verdicts (arm, question_id, correct) with the changed ones (arm, question_id, after) in their
    place; written to ``path`` if one is given, else a dry run."""
    out = before.join(changed.select("arm", "question_id", F.col("after"), F.lit(True).alias("changed")), ["arm", "question_id"], "left")
    out = out.withColumn("correct", F.when(F.col("changed"), F.col("after")).otherwise(F.col("correct"))).drop("after", "changed")
    if path is not None:
        write_result(out, path)
    return out


def manifest(config: dict[str, object]) -> Column:
    """A policy's settings as a literal map, to stand beside its results."""
    return F.create_map(*[F.lit(x) for k, v in sorted(config.items()) for x in (k, json.dumps(v))])
