"""Models and judges that are asked each prompt once: replies are kept by their prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import hooks
from memspark.sources import stage
from memspark.sources.batches import Batches


class ReplyStore:
    """Replies under ``path``, known by the model's name, the prompt and the length allowed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.batches = Batches(spark, path, "key string, reply string, prompt_tokens long, completion_tokens long, estimated boolean", ["key"])
        self.asked = 0

    def replies(self, rows: DataFrame, name: str, make: Callable[[], hooks.Backend], max_new_tokens: int = 64) -> DataFrame:
        """``rows`` (with ``prompt``) with reply, prompt_tokens, completion_tokens and estimated.
        Only prompts without a reply are asked, each once, however many rows have it."""
        made = ["reply", "prompt_tokens", "completion_tokens", "estimated"]
        keep = [c for c in rows.columns if c not in made]
        key = F.sha1(F.concat_ws("|", F.lit(name), F.lit(max_new_tokens), F.coalesce("prompt", F.lit(""))).cast("binary"))
        keyed = rows.select(*keep).withColumn("key_of_prompt", key)
        wanted = keyed.select(F.col("key_of_prompt").alias("key"), "prompt").dropDuplicates(["key"])
        fresh = hooks.predictions(self.batches.missing(wanted), name, make, max_new_tokens)
        fresh = stage.saved(fresh.select("key", F.col("pred").alias("reply"), "prompt_tokens", "completion_tokens", "estimated"), "replies")
        n = fresh.count()
        if n:
            self.batches.append(fresh)
        self.asked += n
        stage.discard(fresh)
        return keyed.join(self.batches.rows().withColumnRenamed("key", "key_of_prompt"), "key_of_prompt").select(*keep, *made)

    def judged(self, answers: DataFrame, name: str, make: Callable[[], hooks.Backend], template: str, abstain_template: str) -> DataFrame:
        """``answers`` (question, gold, pred, is_abstention) with raw_verdict and verdict, as ``hooks.judged`` gives them."""
        keep = [c for c in answers.columns if c not in ("raw_verdict", "verdict")]
        asked = answers.select(*keep, hooks.judge_prompt(template, abstain_template).alias("prompt"))
        found = self.replies(asked, name, make, max_new_tokens=hooks.VERDICT_TOKENS)
        return found.select(*keep, F.col("reply").alias("raw_verdict"), T.parse_verdict(F.col("reply")).alias("verdict"))
