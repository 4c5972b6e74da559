"""Tables written on the way: what several plans read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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
    """``df`` written as Parquet to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._memspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``saved`` that no later plan reads."""
    for df in frames:
        remove(df.sparkSession, df._memspark_path)


def filesystem(spark: SparkSession, path: str) -> tuple[object, object]:
    """(file system, path) of the JVM, for any store that Spark reaches."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def commit(spark: SparkSession, made: str, path: str) -> bool:
    """Give a finished folder its place by one rename; false, and the folder is gone, if another came first."""
    fs, source = filesystem(spark, made)
    _, target = filesystem(spark, path)
    fs.mkdirs(target.getParent())
    # a rename into a folder that exists would nest
    if not fs.exists(target) and fs.rename(source, target):
        return True
    fs.delete(source, True)
    return False


def content_of(df: DataFrame) -> str:
    """A name for what a file-based table holds now: its files, their sizes and times of change."""
    m = F.col("_metadata")
    files = df.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("at")).distinct()
    r = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "size", "at")).alias("x"), F.bit_xor(F.xxhash64("at", "path", F.lit(1))).alias("y")).first()
    return f"{r.n}-{(r.x or 0) & (2**64 - 1):016x}{(r.y or 0) & (2**64 - 1):016x}"


def swap(spark: SparkSession, source: object, path: str) -> None:
    """Put a finished file (a path of the JVM) in the place of another one, in one step."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    # beside its target first, as one step is possible within a store only
    fs = target.getFileSystem(conf)
    near = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, near, True, conf)
    how = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    how[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(near, target, how)
