"""Resumable processing of files that keep arriving: what is done stays done, each key comes out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.sources.readers import processed


def run_available(spark: SparkSession, source: str, schema: str, key: str, out: str, state: str, work: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Process all files of ``source`` that no earlier call has processed, and append the results to ``out``.

    A key already in ``out`` is skipped (an anti-join, so no state grows with the keys), null like any other; within
    a call the first row of a key counts. The checkpoint in ``state`` makes a call after a failure go on where the last one stopped.
    """

    def batch(df: DataFrame, _: int) -> None:
        done = processed(spark, out, key, dict(df.dtypes)[key]).withColumnRenamed(key, "_done")
        new = df.dropDuplicates([key]).join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
        work(new).write.mode("append").parquet(out)

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def chunk_stream(spark: SparkSession, source: str, schema: str, out: str, state: str, largest: int = 1) -> None:
    """Articles that keep arriving as a growing chunk corpus."""
    from evidloom.operators.windows import chunks

    run_available(spark, source, schema, "source", out, state, lambda d: chunks(d, largest=largest))
