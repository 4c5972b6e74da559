"""Benchmark splits and run artifacts in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string,has_answer:boolean>"
SPLIT_SCHEMA = (
    "question_id string, question_type string, question string, answer string, question_date string, "
    f"haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{TURN}>>"
)
GRADED_SCHEMA = "retriever string, model string, accuracy double, records array<struct<question_id:string,question_type:string,deterministic:boolean,prompt_tokens:long>>"


def read_split(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, turns) of a split: a JSON array with one object per question.

    Sessions, dates and ids are zipped up to the shortest of the three; turn
    indices run on over a question's sessions; a missing flag is false; an answer
    written as a number is read as text.  ``limit`` keeps the first questions of
    the file.
    """
    raw = spark.read.schema(SPLIT_SCHEMA).option("multiLine", True).json(path)
    # one array in one file: its objects come in one partition, in their order
    raw = raw if limit is None else raw.withColumn("ordinal", F.monotonically_increasing_id()).orderBy("ordinal").limit(limit).drop("ordinal")
    questions = raw.select("question_id", "question_type", "question", F.col("answer").alias("gold"), "question_date", F.col("question_id").endswith("_abs").alias("is_abstention"))
    zipped = F.arrays_zip("haystack_sessions", "haystack_dates", "haystack_session_ids")
    shortest = F.least(F.size("haystack_sessions"), F.size("haystack_dates"), F.size("haystack_session_ids"))
    sessions = raw.select("question_id", F.posexplode(F.slice(zipped, F.lit(1), F.greatest(shortest, F.lit(0)))).alias("session_index", "s"))
    rows = sessions.select("question_id", "session_index", F.col("s.haystack_dates").alias("session_date"), F.col("s.haystack_session_ids").alias("session_id"), F.posexplode("s.haystack_sessions").alias("pos", "t"))
    order = Window.partitionBy("question_id").orderBy("session_index", "pos")
    turns = rows.select(
        "question_id", "session_id", "session_index", "session_date", (F.row_number().over(order) - 1).cast("int").alias("turn_index"),
        F.col("t.role").alias("role"), F.col("t.content").alias("content"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"),
    )
    return questions, turns


def read_arms(spark: SparkSession, glob: str) -> DataFrame:
    """arms(arm, model, retriever, question_id, question_type, correct) of all artifacts
    that hold records and an accuracy.  Ungraded questions have a null verdict: they
    count for no accuracy but keep their type.  Arms whose prompts all have one
    length were cut to it and are left out."""
    raw = spark.read.schema(GRADED_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(glob)
    raw = raw.where(F.col("records").isNotNull() & F.col("accuracy").isNotNull())
    arm = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1), "^e2e_", "")
    lengths = F.array_distinct(F.transform("records", lambda r: F.coalesce(r["prompt_tokens"], F.lit(-1))))
    clamped = (F.size("records") > 5) & (F.size(lengths) == 1) & (F.element_at(lengths, 1) != 0)
    name = F.coalesce(F.nullif(arm, F.lit("")), "retriever")
    rows = raw.where(~clamped).select(name.alias("arm"), "model", "retriever", F.explode("records").alias("r"))
    return rows.select("arm", "model", "retriever", "r.question_id", F.coalesce("r.question_type", F.lit("?")).alias("question_type"), F.col("r.deterministic").alias("correct"))


def write_worksheet(judged: DataFrame, path: str, limit: int = 100) -> None:
    """The first ``limit`` answers by question id for labelling, verdicts left out, as JSON lines."""
    rows = judged.select("question_id", "question", "gold", "pred", F.lit(None).cast("boolean").alias("human_label"))
    rows.orderBy("question_id").limit(limit).write.option("ignoreNullFields", "false").json(path)


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows of a worksheet."""
    return spark.read.schema("question_id string, question string, gold string, pred string, human_label boolean").json(path).where("human_label IS NOT NULL")
