"""Comparing two versions of a data set record by record, and hashing its content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(a: DataFrame, b: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """(ord, status, field): records that differ: only in one version, or the first field whose value does."""
    pack = lambda d, n: d.select(F.col(order).alias("ord"), F.struct(*(F.col(c).cast("string").alias(c) for c in cols)).alias(n))
    x = pack(a, "l").join(pack(b, "r"), "ord", "full_outer")
    first = F.lit(None).cast("string")
    for c in reversed(cols):
        first = F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)).otherwise(first)
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise(F.when(first.isNotNull(), "differs"))
    return x.withColumn("status", status).where("status is not null").select("ord", "status", F.when(F.col("status") == "differs", first).alias("field"))


def json_compared(a: DataFrame, b: DataFrame, order: str, json: str) -> DataFrame:
    """(ord, same, only_left, only_right): JSON objects of two versions, equal whatever the order of their keys, and the keys only one has."""
    x = a.select(F.col(order).alias("ord"), F.col(json).alias("l")).join(b.select(F.col(order).alias("ord"), F.col(json).alias("r")), "ord", "full_outer")
    lk, rk = F.json_object_keys("l"), F.json_object_keys("r")
    canon = lambda c: F.to_json(F.try_parse_json(c))
    return x.select("ord", canon("l").eqNullSafe(canon("r")).alias("same"), F.array_sort(F.array_except(lk, rk)).alias("only_left"), F.array_sort(F.array_except(rk, lk)).alias("only_right"))


def content_hash(df: DataFrame, order: str, cols: list[str], fan_in: int = 4096) -> DataFrame:
    """One row: records and a SHA-256 over the ordered records.

    Records are hashed where they are, then the hashes of ``fan_in`` neighbours, then those of as many such blocks,
    and so on: no task holds more than ``fan_in`` hashes at once (up to fan_in cubed records), and the same data
    give the same hash in every partitioning. ``order`` is a dense place or id; repeated rows hash each time.
    """
    rec = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols)), 256)
    level = df.select(F.col(order).cast("bigint").alias("o"), rec.alias("h"), F.lit(1).cast("bigint").alias("k"))
    ordered = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n"), 256).alias("h")
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("o") / fan_in).cast("bigint").alias("b")).agg(F.sum("k").alias("k"), ordered).withColumnRenamed("b", "o")
    return level.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("records"), ordered).select("records", F.col("h").alias("hash"))


def well_formed(df: DataFrame, json: str) -> DataFrame:
    """(well_formed, n): how many texts are JSON."""
    return df.groupBy(F.try_parse_json(json).isNotNull().alias("well_formed")).agg(F.count("*").alias("n"))
