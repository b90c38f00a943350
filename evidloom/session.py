"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("EVIDLOOM_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint.

    The folder is the one that ``spark.checkpoint.dir`` names, which all executors share.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that nothing refers to any more, which else waits for its driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, under ``spark.checkpoint.dir``.

    Where that is unset, a session on a cluster raises. One in a single process, as in tests, gets a folder of
    this machine, which goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"evidloom-{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scan_splits(df: DataFrame) -> int:
    """About how many tasks scan the files behind ``df``, from their sizes alone: no job runs."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, len(df.inputFiles()), -(-min(size, 2**60) // split_bytes(spark)))


def split_bytes(spark: SparkSession) -> int:
    """Bytes of a file that one task scans at most."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` over at least ``per_core`` partitions a core, for Python stages behind a few small files.

    A scan that already has enough splits, and the output of a shuffle, stay as they are.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= want // 2 else df.repartition(want)
