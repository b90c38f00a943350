"""The queries of the training-data problems, one function each, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm import crosssplit, encode, leakage, lookalikes, nearset, pieces, sentences, splits, truncated
from evidloom.session import table


def _sentence_model(spark: SparkSession, d: str) -> sentences.Model:
    """Trained on the whole articles, which the chunks and the evidence are taken from."""
    return sentences.train(table(spark, d, "articles"), "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    m = _sentence_model(spark, d)
    chunk = sentences.sentences(table(spark, d, "wikipedia_chunks"), "chunk_id", "text", m).select(F.lit("chunk").alias("field"), "key", "end_pos")
    evidence = sentences.sentences(table(spark, d, "arafa"), "final_id", "evidence", m).select(F.lit("evidence").alias("field"), "key", "end_pos")
    return chunk.unionByName(evidence).withColumnRenamed("key", "rec_key")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    p = pieces.pieces(table(spark, d, "wikipedia_chunks"), "chunk_id", "text", _sentence_model(spark, d), limit=480)
    return p.withColumnRenamed("key", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearset.near_duplicates(table(spark, d, "arafa"), "final_id", ["claim", "reasoning"], likeness=0.7)


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return nearset.near_duplicate_classes(table(spark, d, "arafa"), "final_id", ["claim", "reasoning"], likeness=0.7)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_sources(table(spark, d, "arafa"), "final_id", "source", table(spark, d, "source_verification"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_splits(table(spark, d, "arafa"), "final_id", "source", "judgement", table(spark, d, "source_verification"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_classes(table(spark, d, "arafa"), "final_id", "source", table(spark, d, "source_verification"))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    a, c = table(spark, d, "arafa"), table(spark, d, "wikipedia_chunks")
    each = lambda df, field, key, text: df.where(F.col(key).isNotNull()).select(F.lit(field).alias("field"), "source", F.col(key).cast("string").alias("key"), F.col(text).alias("t"))
    return lookalikes.repaired_forms(each(a, "claim", "final_id", "claim").unionByName(each(a, "evidence", "final_id", "evidence")).unionByName(each(c, "chunk", "chunk_id", "text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    f = _forms(spark, d)
    claims = lookalikes.same_looking(f.where("field = 'claim'")).select(F.lit("claim").alias("field"), F.col("key_a").cast("string").alias("key_a"), F.col("key_b").cast("string").alias("key_b"))
    return claims.unionByName(lookalikes.found_again(f, "evidence", "chunk").select(F.lit("evidence").alias("field"), "key_a", "key_b"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.looks_classes(_forms(spark, d).where("field = 'claim'"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.cross_split_pairs(table(spark, d, "arafa"), table(spark, d, "localization"), "final_id", "claim", "evidence", likeness=0.6)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_report(table(spark, d, "arafa"), table(spark, d, "localization"), "final_id", "claim", "evidence", "source", likeness=0.6)


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.classes(table(spark, d, "arafa"), table(spark, d, "localization"), "final_id", "claim", "evidence")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"), "doc_id", "text")


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(_leaked(spark, d), table(spark, d, "eval_items"), "item_id")


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncated.truncated(table(spark, d, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("cut").select(F.col("doc").alias("doc_id")).distinct()


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncated.truncation_report(_truncated(spark, d))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_splits": p4_splits, "p4_classes": p4_classes, "p6_found": p6_found, "p6_classes": p6_classes, "p7_found": p7_found, "p7_report": p7_report, "p7_classes": p7_classes, "p8_ids": p8_ids, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_sources": p10_sources}
SQL: dict[str, str] = {
    "p4_found": """WITH RECURSIVE e AS (SELECT a.source AS s, b.source AS t FROM (SELECT DISTINCT final_id, source FROM arafa) a JOIN (SELECT DISTINCT final_id, source FROM arafa) b ON a.final_id = b.final_id AND a.source <> b.source
        UNION SELECT source, resolved_pageid FROM source_verification WHERE resolved_pageid > 0),
      u AS (SELECT s, t FROM e UNION SELECT t, s FROM e), r AS (SELECT s AS a, s AS b FROM u UNION SELECT r.a, u.t FROM r JOIN u ON u.s = r.b)
      SELECT DISTINCT a AS source_a, b AS source_b FROM r WHERE a < b AND a IN (SELECT source FROM arafa) AND b IN (SELECT source FROM arafa)""",
}
