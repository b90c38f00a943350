"""Span extraction: examples, crops for training and search, span evaluation. Models come in as scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import chunk_id, exact_match, span_end, span_iou, span_start, token_f1
from evidloom.operators.lexical import rank_in_document
from evidloom.operators.windows import centered_crop, crop_with_gold, crops, sentences_of_chunks


def examples(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """final_id, source, claim, sents, gold_start, gold_end, gold_text of claims whose span lies in a gapless article and has text."""
    s = sentences_of_chunks(chunks)
    g = gold.select("final_id", "source", "claim", "gold_chunk_id", span_start("gold_chunk_id").cast("int").alias("gold_start"), span_end("gold_chunk_id").cast("int").alias("gold_end"))
    x = g.join(s, "source").where("gold_start is not null and gold_start <= gold_end and gold_end < size(sents)")
    x = x.withColumn("gold_text", F.array_join(F.slice("sents", F.col("gold_start") + 1, F.col("gold_end") - F.col("gold_start") + 1), " "))
    return x.where("gold_text <> ''")


def training_crops(ex: DataFrame, window: int = 6, stride: int = 3, centered: bool = False) -> DataFrame:
    """(final_id, source, crop_start, crop_end, text, char_start, char_end): the crops that hold the gold span, and where it is in them."""
    n = F.size("sents")
    all_ = F.array(centered_crop(F.col("gold_start"), F.col("gold_end"), n, window)) if centered else crops(n, window, stride)
    x = ex.select("final_id", "source", "sents", "gold_start", "gold_end", F.explode(all_).alias("c"))
    x = x.withColumn("g", crop_with_gold(F.col("sents"), F.col("c.start"), F.col("c.end"), F.col("gold_start"), F.col("gold_end"))).where("g is not null")
    return x.select("final_id", "source", F.col("c.start").alias("crop_start"), F.col("c.end").alias("crop_end"), "g.text", "g.char_start", "g.char_end")


def search_crops(ex: DataFrame, chunks: DataFrame, top: int = 5, window: int = 6, stride: int = 3) -> DataFrame:
    """(final_id, source, crop_start, crop_end): windows around each claim's best single sentences; sliding crops for a claim without tokens."""
    one = chunks.where("window_size = 1").select("source", "ord", "chunk_id", "text").distinct()
    r = rank_in_document(ex.select("final_id", "source", "claim").distinct(), one, "final_id", "claim", k=top)
    at = r.select("final_id", "source", span_start("chunk_id").cast("int").alias("s"))
    n = ex.select("final_id", "source", F.size("sents").alias("n")).distinct()
    near = at.join(n, ["final_id", "source"]).select("final_id", "source", centered_crop(F.col("s"), F.col("s"), F.col("n"), window).alias("c")).distinct()
    rest = n.join(near.select("final_id", "source"), ["final_id", "source"], "left_anti").select("final_id", "source", F.explode(crops(F.col("n"), window, stride)).alias("c"))
    return near.unionByName(rest).select("final_id", "source", F.col("c.start").alias("crop_start"), F.col("c.end").alias("crop_end"))


SpanScorer = Callable[[pd.DataFrame], pd.DataFrame]


def predicted_spans(crop_rows: DataFrame, scorer: SpanScorer, schema: str) -> DataFrame:
    """A span model over crops in Arrow batches: ``scorer`` turns a frame of crops into one of the given schema.

    A crop that the scorer leaves out is missing from the result, so the number skipped can be counted.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield scorer(f)

    return crop_rows.mapInPandas(run, schema)


def evaluated(spans: DataFrame) -> DataFrame:
    """Rows (final_id, source, pred_text, gold_text, pred_start, pred_end, gold_start, gold_end) with exact_match, token_f1, sentence_iou and pred_chunk_id."""
    return spans.select(
        "*",
        exact_match("pred_text", "gold_text").alias("exact_match"),
        F.round(token_f1("pred_text", "gold_text"), 4).alias("token_f1"),
        F.round(span_iou("pred_start", "pred_end", "gold_start", "gold_end"), 4).alias("sentence_iou"),
        chunk_id("source", "pred_start", "pred_end").alias("pred_chunk_id"),
    )
