"""Joins and set operations of the claim pipeline: verification, exclusion, patches, reasons of rejection, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``. A null key is a key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def verification_by_source(ver: DataFrame) -> DataFrame:
    """One row a source of the table of attempts: a successful one before a failed one, then the latest."""
    return latest(ver, "source", [F.desc("found"), F.desc("verified_at"), F.desc("ingested_at"), F.desc_nulls_last("resolution_notes")])


def with_verification(claims: DataFrame, ver: DataFrame) -> DataFrame:
    """Every claim with found (false where its source was never verified), title and url."""
    v = ver.select("source", "found", "title", "url")
    return claims.join(v, "source", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def verified(claims: DataFrame, ver: DataFrame) -> DataFrame:
    return claims.join(ver.where("found").select("source").distinct(), "source", "left_semi")


def excluding(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known; a null key is never known."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def patched(df: DataFrame, patch: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``df`` with the values of ``cols`` from the patch's row of the same key, where it has one; null values patch too."""
    p = patch.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_p_{c}") for c in cols))
    x = df.join(p, df[key] == F.col("_key"), "left")
    there = F.col("_key").isNotNull()
    keep = [F.when(there, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns]
    return x.select(*keep)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows and the old rows of keys that the new ones don't have."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def appended_chunks(corpus: DataFrame, found: DataFrame, dedupe: bool = True) -> DataFrame:
    """The corpus and those found chunks that it lacks, of sources it has. Without ``dedupe`` a chunk found twice is there twice."""
    new = found.join(corpus.select("source").distinct(), "source", "left_semi").join(corpus.select("source", "chunk_id").distinct(), ["source", "chunk_id"], "left_anti")
    return corpus.unionByName(new.dropDuplicates(["source", "chunk_id"]) if dedupe else new, allowMissingColumns=True)


def reject_reason() -> Column:
    """Why a claim joined with its gold label and the corpus is no example; the first reason that holds, null if none."""
    return (
        F.when(~F.coalesce(F.lower(F.trim("judgement")).isin("supported", "refuted"), F.lit(False)), "not_supported_refuted")
        .when(F.col("gold_match_type").isNull(), "no_gold")
        .when(~F.col("gold_match_type").isin("exact", "fuzzy"), F.concat(F.lit("match_"), "gold_match_type"))
        .when(F.coalesce("gold_chunk_id", F.lit("")) == "", "no_chunk_id")
        .when(~F.col("chunk_there"), "chunk_id_missing")
    )


def with_reasons(claims: DataFrame, gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims (final_id, source, judgement) with their gold label and ``reason``; a claim several labels name comes with each."""
    g = gold.select("final_id", "source", "gold_chunk_id", "gold_match_type").distinct()
    c = chunks.select("source", F.col("chunk_id").alias("gold_chunk_id")).distinct().withColumn("chunk_there", F.lit(True))
    x = claims.select("final_id", "source", "judgement").distinct().join(g, ["final_id", "source"], "left").join(c, ["source", "gold_chunk_id"], "left")
    return x.withColumn("chunk_there", F.coalesce("chunk_there", F.lit(False))).withColumn("reason", reject_reason())


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, key): keys that only one of two one-column tables has."""
    k = a.columns[0]
    one, two = a.select(F.col(k).alias("key")).distinct(), b.select(F.col(b.columns[0]).alias("key")).distinct()
    return one.join(two, "key", "left_anti").select(F.lit("left").alias("side"), "key").unionByName(two.join(one, "key", "left_anti").select(F.lit("right").alias("side"), "key"))


def batched(df: DataFrame, order: str, size: int = 20) -> DataFrame:
    """``df`` with ``batch``: rows dealt by a dense 0-based order column into batches of a fixed size."""
    return df.withColumn("batch", F.floor(F.col(order) / size))


def bookkeeping(articles: DataFrame, ver: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: found, cached and chunked sources, found ones that aren't cached, found ones without chunks."""
    found = ver.where("found").select("source").distinct()
    cached = articles.where("coalesce(text, '') <> ''").select("source").distinct()
    chunked = chunks.select("source").distinct()
    tag = lambda d, n: d.withColumn(n, F.lit(1))
    x = tag(found, "f").join(tag(cached, "c"), "source", "full_outer").join(tag(chunked, "k"), "source", "full_outer")
    return x.agg(F.count("f").alias("found"), F.count("c").alias("cached"), F.count("k").alias("chunked"), F.count_if(F.col("f").isNotNull() & F.col("c").isNull()).alias("found_not_cached"), F.count_if(F.col("f").isNotNull() & F.col("k").isNull()).alias("found_not_chunked"))
