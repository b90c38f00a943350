"""Profiles of a table of records: totals, completeness, histograms, lengths, records per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import is_blank


def totals(df: DataFrame, key: str) -> DataFrame:
    """One row: records, distinct, smallest and largest keys, and how many records repeat a key."""
    r = df.agg(F.count("*").alias("records"), F.count_distinct(key).alias("distinct_keys"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(key).alias("keyed"))
    return r.select("records", "distinct_keys", "min_key", "max_key", (F.col("keyed") - F.col("distinct_keys")).alias("duplicates"))


def histogram(df: DataFrame, value: str | Column, total: int | None = None) -> DataFrame:
    """(value, n, pct): most frequent first, ties by value; null as its own value. pct is rounded to 4 places."""
    v = F.col(value) if isinstance(value, str) else value
    h = df.select(v.alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    all_rows = F.lit(total) if total is not None else df.agg(F.count("*")).scalar()
    return h.select("value", "n", F.round(F.lit(100.0) * F.col("n") / all_rows, 4).alias("pct"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with null as ``(null)``."""
    null = F.lit("(null)")
    return df.groupBy(F.coalesce(F.col(a).cast("string"), null).alias(a), F.coalesce(F.col(b).cast("string"), null).alias(b)).agg(F.count("*").alias("n"))


def text_lengths(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, n, min_len, max_len, mean_len, total_len) of the texts that are there, mean to 2 places; one pass for all fields."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.length(c).cast("bigint").alias("len")) for c in cols))).alias("x")).select("x.field", "x.len").where("len is not null")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.round(F.avg("len"), 2).alias("mean_len"), F.sum("len").alias("total_len"))


def records_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row: smallest, largest, mean (2 places) and exact median number of records a key; a null key is none."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.round(F.avg("n"), 2).alias("mean_n"), F.percentile("n", 0.5).alias("median_n"), F.count("*").alias("keys"))


def top_keys(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k keys with the most records, ties by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def json_completeness(df: DataFrame, json: str, expected: list[str]) -> DataFrame:
    """(field, populated, null_or_empty, missing, pct): of JSON objects kept as text, so that a missing key and null differ."""
    keys = F.json_object_keys(json)

    def one(f: str) -> Column:
        there = F.coalesce(F.array_contains(keys, f), F.lit(False))
        full = there & ~is_blank(F.get_json_object(json, f"$.{f}"))
        return F.struct(F.lit(f).alias("field"), full.cast("bigint").alias("p"), (there & ~full).cast("bigint").alias("e"), (~there).cast("bigint").alias("m"))

    x = df.select(F.explode(F.array(*(one(f) for f in expected))).alias("x")).select("x.*")
    s = x.groupBy("field").agg(F.sum("p").alias("populated"), F.sum("e").alias("null_or_empty"), F.sum("m").alias("missing"), F.count("*").alias("n"))
    return s.select("field", "populated", "null_or_empty", "missing", F.round(F.lit(100.0) * F.col("populated") / F.col("n"), 4).alias("pct"))


def unexpected_fields(df: DataFrame, json: str, expected: list[str]) -> DataFrame:
    """(field, n): keys of JSON objects beyond the expected ones."""
    extra = F.array_except(F.json_object_keys(json), F.array(*(F.lit(f) for f in expected)).cast("array<string>"))
    return df.select(F.explode(extra).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, populated, null_or_empty, pct) of columns: blank texts count as empty."""
    one = lambda c: F.struct(F.lit(c).alias("field"), (~is_blank(F.col(c).cast("string"))).cast("bigint").alias("p"))
    x = df.select(F.explode(F.array(*(one(c) for c in cols))).alias("x")).select("x.*")
    s = x.groupBy("field").agg(F.sum("p").alias("populated"), F.count("*").alias("n"))
    return s.select("field", "populated", (F.col("n") - F.col("populated")).alias("null_or_empty"), F.round(F.lit(100.0) * F.col("populated") / F.col("n"), 4).alias("pct"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with how many records meet each condition."""
    return df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): distinct keys with the smallest order they occur at."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
