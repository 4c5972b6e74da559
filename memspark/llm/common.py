"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as every operator here understands it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, in the JVM and in a Python worker: of a session that still has Spark's default.
BATCH, SPARKS_BATCH = "8m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Have the session send Python workers batches of 8 MB instead of Spark's 64, of
    which each running task would hold two; a size that someone has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARKS_BATCH:
        spark.conf.set(name, BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset a local session (tests)
    uses a temporary folder; on a cluster that would be lost with its machine, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/memspark-{spark.sparkContext.applicationId}"
    return root.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: it is
    computed once, and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._memspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``saved`` that no later plan reads, and let the driver
    collect its garbage: Spark removes shuffle files once their plans are collected."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._memspark_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def n_words(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
