"""Memory units at three granularities, store contract, stratified sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as T

GRANULARITIES = ("turn", "user_turn", "session")


def renumber(df: DataFrame, *order: str) -> DataFrame:
    """``unit_id`` from 0 per question in the given order."""
    return df.withColumn("unit_id", (F.row_number().over(Window.partitionBy("question_id").orderBy(*order)) - 1).cast("int"))


def build(turns: DataFrame, granularity: str) -> DataFrame:
    """units(question_id, unit_id, text, session_id, session_date, session_index, is_evidence)."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}: one of {GRANULARITIES}")
    cols = ["question_id", "unit_id", "text", "session_id", "session_date", "session_index", "is_evidence"]
    if granularity == "session":
        # a session id that comes again joins its first session
        line = F.concat_ws(": ", "role", "content")
        rows = turns.groupBy("question_id", "session_id").agg(
            F.min("turn_index").alias("first"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"),
            F.min_by("session_date", "turn_index").alias("session_date"),
            F.min_by("session_index", "turn_index").alias("session_index"),
            F.bool_or("has_answer").alias("is_evidence"),
        )
        return renumber(rows, "first").select(*cols)
    if granularity == "user_turn":
        turns = turns.where(F.col("role") == "user")
    text = F.col("content") if granularity == "user_turn" else F.concat_ws(": ", "role", "content")
    return renumber(turns.withColumns({"text": text, "is_evidence": F.col("has_answer")}), "turn_index").select(*cols)


def violations(units: DataFrame) -> DataFrame:
    """One row per question: ids contiguous from 0, and dates that parse."""
    return units.groupBy("question_id").agg(
        F.count("*").alias("n_units"),
        ((F.min("unit_id") == 0) & (F.max("unit_id") == F.count("*") - 1) & (F.count_distinct("unit_id") == F.count("*"))).alias("contiguous"),
        F.count_if(T.parse_date(F.col("session_date")).isNull()).alias("bad_dates"),
    )


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """About n rows, at least one of each stratum, by a seeded hash; all rows if n <= 0."""
    if n <= 0:
        return df
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)).cast("binary"))
    sizes = df.groupBy(F.col(stratum).alias("stratum_of")).agg(F.count("*").alias("size"))
    share = F.col("size") * F.lit(float(n)) / F.col("total")
    quotas = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("total")))).select("stratum_of", F.greatest(F.lit(1.0), F.bround(share, 0)).alias("quota"))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("draw"))
    # no quota exceeds n, and a limit by a constant cuts each task's rows before they move
    first = df.withColumn("draw", draw).withColumn("nth", nth).where(F.col("nth") <= n)
    ranked = first.join(quotas, F.col(stratum).eqNullSafe(F.col("stratum_of")))
    return ranked.where("nth <= quota").orderBy("draw").limit(n).select(*df.columns)
