"""A cache of vectors that is read through: only texts it does not hold are encoded.

An entry is known by the model's name and the very text (with the prefix that the
model wants), and keeps the cost it was made at: tokens, and the seconds that the
encoder took.  Each run appends one folder of new entries, which takes its place
by one rename; when two runs have made the same entry, the one of the folder that
comes first by name counts.  A damaged file is a miss, never an error: its texts
are encoded again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as T
from memspark.operators import hooks
from memspark.sources import stage
from memspark.sources.batches import Batches

def text_key(name: str, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(name), text).cast("binary"))


class VectorCache:
    """The entries under ``path``, and what reading through them has cost (``used``)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.batches = Batches(spark, path, "key string, vec array<double>, tokens long, seconds double", ["key"])
        self.used: list[DataFrame] = []

    def entries(self) -> DataFrame:
        """(key, vec, tokens, seconds), one per key."""
        return self.batches.rows()

    def encoded(self, df: DataFrame, text_col: str, name: str, make: Callable[[], hooks.Encoder] = hooks.HashingEncoder, device: str = "cpu", query: bool = False) -> DataFrame:
        """As ``hooks.encoded``, but each distinct text is encoded at most once in the cache's life."""
        keep = [c for c in df.columns if c != "vec"]
        text = F.coalesce(F.concat(F.lit(hooks.prefix_of(name, query)), F.col(text_col)), F.lit(""))
        keyed = df.select(*keep).withColumn("key_of_text", text_key(name, text))
        wanted = keyed.select(F.col("key_of_text").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["key"])
        known = self.entries()
        hits = wanted.join(known.select("key", "tokens"), "key").agg(F.count("*").alias("hits"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("replayed_tokens"))
        use = stage.saved(hits, "use")
        missing = wanted.join(known.select("key"), "key", "left_anti")
        fresh = hooks.encoded(missing.withColumn("tokens", T.count_tokens(F.col("text")).cast("long")), "text", name, make, device, query, seconds=True)
        # a damaged folder may hold what is made again: both are read, one counts
        made = stage.saved(fresh.select("key", "vec", "tokens", "seconds"), "fresh")
        if not made.isEmpty():
            self.batches.append(made)
        self.used.append(stage.saved(use.crossJoin(F.broadcast(made.agg(F.count("*").alias("misses"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("measured_tokens")))), "use"))  # a row each
        stage.discard(made, use)
        return keyed.join(self.entries().select(F.col("key").alias("key_of_text"), "vec"), "key_of_text").select(*keep, "vec")

    def usage(self) -> DataFrame:
        """One row: hits, misses, tokens replayed and measured, and whether any cost was replayed."""
        out = None
        for u in self.used:
            out = u if out is None else out.unionByName(u)
        total = out.agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "replayed_tokens", "measured_tokens")])
        return total.withColumn("used_replayed_timings", F.col("hits") > 0)
