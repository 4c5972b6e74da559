"""Tables that grow by whole folders, so that a run that is cut off leaves nothing half done."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.sources import stage


class Batches:
    """Rows of ``schema`` under ``path``.  A batch takes its place by one rename; of rows with
    the same ``key`` those of the batch that comes first by name count; damaged files are passed over."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), f"{schema}, batch string", key

    def rows(self) -> DataFrame:
        """One row per key."""
        fs, at = stage.filesystem(self.spark, f"{self.path}/batch-*")
        if not fs.globStatus(at):
            return self.spark.createDataFrame([], self.schema).drop("batch")
        found = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(f"{self.path}/batch-*")
        rest = [c for c in found.columns if c not in (*self.key, "batch")]
        whole = found.where(" AND ".join(f"{k} IS NOT NULL" for k in self.key))
        return whole.groupBy(*self.key).agg(F.min_by(F.struct(*rest), "batch").alias("r")).select(*self.key, "r.*")

    def append(self, rows: DataFrame) -> None:
        batch = uuid.uuid4().hex
        made = f"{self.path}/_making-{batch}"
        rows.withColumn("batch", F.lit(batch)).write.parquet(made)
        stage.commit(self.spark, made, f"{self.path}/batch-{batch}")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` whose keys are not there."""
        return wanted.join(self.rows().select(*self.key), self.key, "left_anti")


class Sweep:
    """Results (arm, question_id, ...) of many arms over many questions, which a later run takes up where an earlier one ended."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.done = Batches(spark, path, f"arm string, question_id string, {schema}", ["arm", "question_id"])

    def run(self, questions: DataFrame, arms: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, int]:
        """Have each arm answer the questions(question_id, ...) that it has no result for; an arm
        makes (question_id, ...), and its results are kept as soon as it ends.  The number asked, by arm."""
        asked = {}
        for arm, answer in arms.items():
            left = stage.saved(self.done.missing(questions.withColumn("arm", F.lit(arm))).drop("arm"), "left")
            asked[arm] = left.count()
            if asked[arm]:
                self.done.append(answer(left).withColumn("arm", F.lit(arm)))
            stage.discard(left)
        return asked

    def results(self) -> DataFrame:
        return self.done.rows()
