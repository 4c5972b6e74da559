"""Stored answers graded anew: verdicts and totals replaced inside many JSON artifacts at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.sources import stage

RECORDS = "struct<records:array<struct<question_id:string,question_type:string,question:string,gold:string,pred:string,is_abstention:boolean,deterministic:boolean>>>"


def payloads(spark: SparkSession, glob: str) -> DataFrame:
    """(path, value) of the files of ``glob`` that hold records."""
    raw = spark.read.option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.withColumn("of", F.from_json("value", RECORDS)).where(F.col("of.records").isNotNull())


def verdicts(files: DataFrame) -> DataFrame:
    """(path, at, question_id, question_type, gold, pred, before, after, f1) of every record."""
    rows = files.select("path", F.posexplode("of.records").alias("at", "r")).select("path", "at", "r.*")
    after = T.grade(F.col("pred"), F.col("gold"), F.coalesce("is_abstention", F.lit(False)), F.col("question"))
    f1 = T.token_f1(T.normal_tokens(F.col("pred")), T.normal_tokens(F.col("gold")))
    return rows.select("path", "at", "question_id", "question_type", "gold", "pred", F.col("deterministic").alias("before"), after.alias("after"), f1.alias("f1"))


def changes(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("before").eqNullSafe(F.col("after"))).drop("at", "f1")


def replaced(value: str, after: list[bool | None], f1: list[float]) -> str:
    """The artifact with these verdicts, and with the totals that follow from them."""
    payload = json.loads(value)
    by_type: dict[str, dict[str, float]] = {}
    for record, verdict in zip(payload["records"], after, strict=True):
        record["deterministic"] = verdict
        if verdict is not None:
            cell = by_type.setdefault(record["question_type"], {"n": 0, "correct": 0})
            cell["n"] += 1
            cell["correct"] += int(verdict)
    graded, correct = sum(c["n"] for c in by_type.values()), sum(c["correct"] for c in by_type.values())
    payload |= {"accuracy": correct / max(graded, 1), "n_graded": graded, "n_not_gradable": len(after) - graded, "token_f1_mean": sum(f1) / payload.get("n_examples", max(len(after), 1))}
    payload["accuracy_by_question_type"] = {t: c | {"accuracy": c["correct"] / c["n"]} for t, c in sorted(by_type.items())}
    return json.dumps(payload, indent=2)


def rewritten(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, value) of the artifacts in which a verdict changes."""
    moved = changes(rows).select("path").distinct()
    each = rows.join(moved, "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "after", "f1"))).alias("new"))  # a file's own

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [replaced(v, [x["after"] for x in n], [x["f1"] for x in n]) for v, n in zip(batch.column("value").to_pylist(), batch.column("new").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(new, pa.string())], ["path", "value"])

    return files.select("path", "value").join(each, "path").mapInArrow(edit, "path string, value string")


def regrade(spark: SparkSession, glob: str, write: bool = False) -> DataFrame:
    """All changed verdicts of the artifacts of ``glob``, as a saved table.  With ``write`` those
    artifacts, and no others, are replaced: the new texts are written aside by Spark, and each
    takes its file's place in one step, so a reader sees the old file or the new one."""
    files = payloads(spark, glob)
    rows = stage.saved(verdicts(files), "verdicts")
    found = stage.saved(changes(rows), "changes")
    if write:
        aside = f"{stage.shared_dir(spark)}/regraded-{uuid.uuid4().hex}"
        rewritten(files, rows).select("value", F.sha1(F.col("path").cast("binary")).alias("file")).write.partitionBy("file").text(aside)
        for path, name in found.select("path", F.sha1(F.col("path").cast("binary"))).distinct().collect():  # names of files
            fs, at = stage.filesystem(spark, f"{aside}/file={name}/part-*")
            stage.swap(spark, fs.globStatus(at)[0].getPath(), path)
        stage.remove(spark, aside)
    stage.discard(rows)
    return found
