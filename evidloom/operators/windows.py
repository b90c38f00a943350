"""Sentence windows, crops and offsets as array expressions: nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import chunk_id, segment


def window_array(sents: Column, largest: int, smallest: int = 1) -> Column:
    """(size, start, end, text) of all windows of ``smallest`` to ``largest`` sentences: by size, then by start; ends inclusive."""
    n = F.size(sents)
    kind = "array<struct<size:int,start:int,end:int,text:string>>"

    def of_size(k: Column) -> Column:
        def one(i: Column) -> Column:
            return F.struct(k.alias("size"), i.alias("start"), (i + k - 1).alias("end"), F.array_join(F.slice(sents, i + 1, k), " ").alias("text"))

        return F.when((k < 1) | (k > n), F.array().cast(kind)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), one))

    return F.flatten(F.transform(F.sequence(F.lit(smallest), F.lit(max(smallest, largest))), of_size)) if largest >= smallest else F.array().cast(kind)


def chunks(articles: DataFrame, source: str = "source", text: str = "text", largest: int = 3, smallest: int = 1) -> DataFrame:
    """(source, ord, chunk_id, sentence_start, sentence_end, window_size, text): the window corpus of a table of articles.

    ``largest=1`` builds single sentences only, which costs less than filtering them afterwards.
    """
    s = articles.select(F.col(source).alias("source"), segment(text).alias("_s"))
    w = s.select("source", F.posexplode(window_array(F.col("_s"), largest, smallest)).alias("ord", "w"))
    return w.select("source", "ord", chunk_id("source", "w.start", "w.end").alias("chunk_id"), F.col("w.start").alias("sentence_start"), F.col("w.end").alias("sentence_end"), F.col("w.size").alias("window_size"), F.col("w.text").alias("text"))


def crops(n: Column, window: int = 6, stride: int = 3) -> Column:
    """(start, end) of sliding crops over n sentences, ends exclusive; the last is clipped and reaches n."""
    last = F.when(n <= window, F.lit(0)).otherwise(F.ceil((n - window).cast("double") / stride).cast("int") * stride)
    one = lambda i: F.struct(i.alias("start"), F.least(i + window, n).alias("end"))
    return F.when(n <= 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), one))


def centered_crop(gold_start: Column, gold_end: Column, n: Column, window: int = 6) -> Column:
    """(start, end), end exclusive: a window around an inclusive gold span, moved inside [0, n); a longer gold span is kept whole."""
    size = gold_end - gold_start + 1
    room = F.greatest(F.lit(window) - size, F.lit(0))
    s = F.greatest(F.lit(0), gold_start - F.floor(room / 2).cast("int"))
    e = F.least(n, F.greatest(s + window, gold_end + 1))
    s2 = F.greatest(F.lit(0), F.least(s, e - F.least(F.lit(window), e)))
    return F.struct(F.least(s2, gold_start).cast("int").alias("start"), e.cast("int").alias("end"))


def offsets(sents: Column) -> Column:
    """Where each sentence begins in the text that joins them with one character, and the length of that text."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("got"))
    step = lambda acc, s: F.struct((acc["at"] + F.length(s) + 1).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got"))
    return F.aggregate(sents, first, step, lambda acc: F.concat(acc["got"], F.array(F.greatest(acc["at"] - 1, F.lit(0)))))


def char_to_sentences(starts: Column, a: Column, b: Column) -> Column:
    """(first, last) sentence that the characters a to b (exclusive) touch; a sentence owns the separator after it. Null if none."""
    n = F.size(starts) - 1
    idx = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (F.get(starts, i) < b) & (F.when(i == n - 1, F.get(starts, n)).otherwise(F.get(starts, i + 1)) > a))
    return F.when((n > 0) & (F.size(idx) > 0), F.struct(F.array_min(idx).alias("first"), F.array_max(idx).alias("last")))


def crop_with_gold(sents: Column, crop_start: Column, crop_end: Column, gold_start: Column, gold_end: Column) -> Column:
    """(text, char_start, char_end) of a crop and its gold span's characters in it; null if the crop doesn't hold the gold."""
    inside = (crop_start <= gold_start) & (gold_end < crop_end) & (gold_start <= gold_end)
    text = F.array_join(F.slice(sents, crop_start + 1, F.greatest(crop_end - crop_start, F.lit(0))), " ")
    lead = F.array_join(F.slice(sents, crop_start + 1, F.greatest(gold_start - crop_start, F.lit(0))), " ")
    at = F.when(gold_start == crop_start, F.lit(0)).otherwise(F.length(lead) + 1)
    gold = F.array_join(F.slice(sents, gold_start + 1, F.greatest(gold_end - gold_start + 1, F.lit(0))), " ")
    return F.when(inside, F.struct(text.alias("text"), at.alias("char_start"), (at + F.length(gold)).alias("char_end")))


def sentences_of_chunks(chunks_df: DataFrame) -> DataFrame:
    """(source, sents): the sentences of each article from its single-sentence chunks; none where one is missing."""
    one = chunks_df.where("window_size = 1").select("source", "sentence_start", "text").distinct()
    per = one.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("sentence_start", "text"))).alias("a"), F.count("*").alias("n"), F.max("sentence_start").alias("m"), F.min("sentence_start").alias("k"))
    return per.where("n = m + 1 and k = 0").select("source", F.transform("a", lambda x: x["text"]).alias("sents"))
