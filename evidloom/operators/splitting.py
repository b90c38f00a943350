"""Seeded samples and leakage-free stratified splits of articles, their mixes and manifests."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions.text import seeded

#: Article size buckets: up to 20, 50, 80 records, and more.
EDGES = (20, 50, 80)


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded order of their key: the same in every engine and for every partitioning."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def bucket(n: Column) -> Column:
    return F.when(n <= EDGES[0], 0).when(n <= EDGES[1], 1).when(n <= EDGES[2], 2).otherwise(3)


def stratified(records: DataFrame, source: str, seed: int = 42, replay: bool = False) -> DataFrame:
    """(source, n, bucket, split): 80/10/10 of the articles of each size bucket, rounded half to even.

    Buckets of ten articles or more give val and test one at least. The order within a bucket is that of a seeded
    hash. ``replay`` draws it from Python's generator on the driver instead, which suits tables of articles that
    a driver can hold; it is for comparing with splits made that way.
    """
    per = records.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")).withColumn("bucket", bucket(F.col("n")))
    if replay:
        return _replayed(per, seed)
    x = per.withColumn("_h", seeded("source", seed)).withColumn("_p", F.substring("_h", 1, 3))
    # places are counted per leading digits of the hash, so no task orders a whole bucket
    w = Window.partitionBy("bucket").orderBy("_p")
    before = x.groupBy("bucket", "_p").agg(F.count("*").alias("_k")).withColumn("_before", F.sum("_k").over(w) - F.col("_k")).withColumn("_m", F.sum("_k").over(Window.partitionBy("bucket")))
    x = x.join(before.drop("_k"), ["bucket", "_p"])
    x = x.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy("bucket", "_p").orderBy("_h", "source")) - 1)
    return x.select("source", "n", "bucket", _split(F.col("_i"), F.col("_m")).alias("split"))


def _split(i: Column, m: Column) -> Column:
    train, val = F.rint(m * F.lit(0.8)), F.rint(m * F.lit(0.1))
    val = F.when((m >= 10) & (val < 1), F.lit(1.0)).otherwise(val)
    train = F.when((m >= 10) & (m - train - val < 1), m - val - 1).otherwise(train)
    return F.when(i < train, "train").when(i < train + val, "val").otherwise("test")


def _replayed(per: DataFrame, seed: int) -> DataFrame:
    rng, out = random.Random(seed), []
    rows: dict[int, list] = {}
    for r in per.orderBy("bucket", "source").collect():
        rows.setdefault(r.bucket, []).append(r)
    for b in sorted(rows):
        own = rows[b]
        rng.shuffle(own)
        m = len(own)
        train, val = round(m * 0.8), round(m * 0.1)
        if m >= 10:
            val = max(val, 1)
            train = min(train, m - val - 1)
        out += [(r.source, r.n, r.bucket, "train" if i < train else "val" if i < train + val else "test") for i, r in enumerate(own)]
    return per.sparkSession.createDataFrame(out, "source bigint, n bigint, bucket int, split string")


def mix(split_records: DataFrame) -> DataFrame:
    """(split, claims, articles, supported, refuted, exact, fuzzy): one row a split."""
    j = F.lower(F.trim("judgement"))
    return split_records.groupBy("split").agg(
        F.count("*").alias("claims"), F.count_distinct("source").alias("articles"), F.count_if(j == "supported").alias("supported"), F.count_if(j == "refuted").alias("refuted"),
        F.count_if(F.col("gold_match_type") == "exact").alias("exact"), F.count_if(F.col("gold_match_type") == "fuzzy").alias("fuzzy"),
    )


def leaks(split_records: DataFrame, key: str = "source") -> DataFrame:
    """(key, splits): keys that stand in more than one split; none in a sound split."""
    return split_records.where(F.col("split").isNotNull()).groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
