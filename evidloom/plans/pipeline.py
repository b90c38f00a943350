"""The pipeline end to end: each step reads tables, writes one, and can be run by itself (``python -m evidloom``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.functions.text import is_blank, segment
from evidloom.operators import lexical, match, metrics, profile, quality, relate, splitting, windows
from evidloom.sources import readers, schemas, writers


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims from a JSON array or from parquet, by the name."""
    df = readers.json_array(spark, path) if path.endswith(".json") else spark.read.parquet(path)
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


def dump_to_chunks(spark: SparkSession, dump: str, verification: DataFrame | None, out: str, largest: int = 1, most: int | None = None, resume: bool = False) -> DataFrame:
    """Dump files as a chunk corpus: known sources excluded, each source once (the first by file), articles with a sentence.

    ``resume`` skips the sources that ``out`` has already and appends.
    """
    a = readers.dump_articles(spark, dump).where(~is_blank("text")).where(F.size(segment("text")) >= 1)
    if verification is not None:
        a = relate.excluding(a, readers.known_sources(verification), "source")
    if resume:
        a = relate.excluding(a, readers.processed(spark, out, "source"), "source")
    a = a.groupBy("source").agg(F.min_by(F.struct("text", "title"), "file").alias("x")).select("source", "x.*")
    if most is not None:
        a = a.orderBy("source").limit(most)
    windows.chunks(a, largest=largest).write.mode("append" if resume else "overwrite").parquet(out)
    return spark.read.parquet(out)


def gold(spark: SparkSession, claims: DataFrame, verification: DataFrame, articles: DataFrame, out: str, sample: int | None = None, seed: int = 42, resume: bool = False) -> DataFrame:
    """Gold labels of the claims whose source is verified, written to ``out``; ``resume`` labels only claims it lacks."""
    c = relate.verified(claims, verification).select("final_id", "source", "evidence")
    if sample is not None:
        c = c.join(splitting.sampled(c.select("final_id").distinct(), "final_id", sample, seed), "final_id", "left_semi")
    if resume:
        c = relate.excluding(c, readers.processed(spark, out, "final_id"), "final_id")
    match.gold_labels(c, windows.chunks(articles), articles).write.mode("append" if resume else "overwrite").parquet(out)
    return spark.read.parquet(out)


def localization(claims: DataFrame, labels: DataFrame, chunks: DataFrame, out: str, seed: int = 42) -> DataFrame:
    """The records that no reason rejects, split by article, written per split; returns the manifest."""
    g = labels.select("final_id", "source", F.col("chunk_id").alias("gold_chunk_id"), F.col("match_type").alias("gold_match_type"), "similarity")
    kept = relate.with_reasons(claims, g, chunks).where("reason is null").select("final_id", "source", "gold_chunk_id", "gold_match_type").distinct()
    x = claims.select("final_id", "source", "claim", "evidence", "judgement", "type").distinct().join(kept, ["final_id", "source"]).join(g.select("final_id", "source", "similarity").distinct(), ["final_id", "source"])
    x = x.join(splitting.stratified(x, "source", seed).select("source", "split"), "source")
    return writers.split_files(x, out)


def bm25_eval(queries: DataFrame, chunks: DataFrame, field: str = "claim", k: int = 50) -> tuple[DataFrame, DataFrame]:
    """(ranks, metrics) of BM25 within the known article; ``field`` is the query's column, evidence for the ceiling."""
    r = lexical.gold_ranks(queries, chunks, "final_id", field, k)
    return r, metrics.retrieval_metrics(r)


def open_eval(claims: DataFrame, labels: DataFrame, chunks: DataFrame, k: int = 10, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Metrics of BM25 over the whole chunk collection; blank claims are skipped and don't count."""
    g = labels.where("match_type in ('exact', 'fuzzy') and coalesce(chunk_id, '') <> ''").select("final_id", F.col("chunk_id").alias("gold_chunk_id")).distinct()
    q = claims.select("final_id", "claim").where(~is_blank("claim")).distinct().join(g, "final_id")
    if sample is not None:
        q = splitting.sampled(q, "final_id", sample, seed)
    hit = lexical.rank_in_collection(q, chunks.select("chunk_id", "text").distinct(), "final_id", "claim", "chunk_id", "text", k)
    r = q.select("final_id", "gold_chunk_id").join(hit.select("final_id", F.col("chunk_id").alias("gold_chunk_id"), F.col("rk").alias("rank")), ["final_id", "gold_chunk_id"], "left")
    return metrics.retrieval_metrics(r)


def claims_verification(claims: DataFrame, verification: DataFrame) -> DataFrame:
    return relate.with_verification(claims.select("final_id", "source").distinct(), verification)


def metadata(claims: DataFrame) -> dict[str, DataFrame]:
    """The profile of a claim dataset, a table a part."""
    return {
        "totals": profile.totals(claims, "final_id"),
        "completeness": profile.completeness(claims, [c.lower() for c in schemas.CLAIM_FIELDS]),
        "judgements": profile.histogram(claims, "judgement"),
        "types": profile.histogram(claims, "type"),
        "crosstab": profile.crosstab(claims, "type", "judgement"),
        "lengths": profile.text_lengths(claims, ["claim", "evidence", "reasoning"]),
        "per_source": profile.records_per_key(claims, "source"),
        "top_sources": profile.top_keys(claims, "source"),
    }


def validated(spark: SparkSession, original: str, formatted: str) -> DataFrame:
    """The records of two JSON arrays that differ, whatever the order of their keys."""
    a, b = readers.json_array_texts(spark, original), readers.json_array_texts(spark, formatted)
    return quality.json_compared(a, b, "ord", "record").where("not coalesce(same, false)")
