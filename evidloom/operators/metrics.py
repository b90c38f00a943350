"""Retrieval and span metrics: recall at k, MRR, IoU-relaxed ranks, slices, bins and quintiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions.text import span_end, span_iou, span_start


def recall_aggs(rank: str = "rank", ks: tuple[int, ...] = (1, 5, 10), suffix: str = "") -> list[Column]:
    """n-free aggregates of a rank column; a null rank is a miss; an empty group gives null."""
    hit = lambda k: F.round(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_at_{k}{suffix}")
    return [*(hit(k) for k in ks), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0))), 4).alias(f"mrr{suffix}")]


def retrieval_metrics(ranks: DataFrame, by: list[str] | None = None, rank: str = "rank", ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    g = ranks.groupBy(*by) if by else ranks.groupBy()
    return g.agg(F.count("*").alias("n"), *recall_aggs(rank, ks))


def relaxed_metrics(ranks: DataFrame) -> DataFrame:
    """Recalls and MRR of the strict ranks and of those relaxed by IoU, side by side."""
    return ranks.agg(F.count("*").alias("n"), *recall_aggs("rank"), *recall_aggs("rank_relaxed", suffix="_relaxed"))


def breakdown(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """(slice, value, n, recalls, mrr): overall, by judgement, by gold_match_type, and by type of the refuted.

    One pass: every record is expanded to the slices it belongs to and the partial aggregates meet in one shuffle.
    """
    one = lambda s, v: F.struct(F.lit(s).alias("slice"), v.alias("value"))
    refuted = (F.col("judgement") == "refuted") & F.col("type").isNotNull() & (F.col("type") != "")
    slices = F.array(one("overall", F.lit("all")), one("judgement", F.col("judgement")), one("match_type", F.col("gold_match_type")), F.when(refuted, one("refuted_type", F.col("type"))))
    x = ranks.select(rank, F.explode(F.array_compact(slices)).alias("s")).select(rank, "s.slice", "s.value")
    return x.groupBy("slice", "value").agg(F.count("*").alias("n"), *recall_aggs(rank))


def ranks_of(ranked: DataFrame, gold: DataFrame, query: str, least_iou: float = 0.5) -> DataFrame:
    """query, gold_chunk_id, rank and rank_relaxed: where the gold chunk stands, and the first chunk that overlaps it.

    The relaxed rank is the gold chunk's own wherever it is in the list, even if a neighbour stands before it.
    """
    x = gold.select(query, "source", "gold_chunk_id").distinct().join(ranked.select(query, "source", "chunk_id", "rk"), [query, "source"], "left")
    iou = span_iou(span_start("chunk_id"), span_end("chunk_id"), span_start("gold_chunk_id"), span_end("gold_chunk_id"))
    r = x.groupBy(query, "source", "gold_chunk_id").agg(F.min(F.when(F.col("chunk_id") == F.col("gold_chunk_id"), F.col("rk"))).alias("rank"), F.min(F.when(iou >= least_iou, F.col("rk"))).alias("_near"))
    return r.select(query, "source", "gold_chunk_id", F.col("rank").cast("bigint").alias("rank"), F.coalesce("rank", "_near").cast("bigint").alias("rank_relaxed"))


def overlap_bins(df: DataFrame, overlap: str, rank: str) -> DataFrame:
    """(bin, n, recall_at_1): ten bins of a tenth, half open, the last with 1; bins without records are left out."""
    bounds = [i / 10 for i in range(11)]
    b = F.lit(None).cast("int")
    for i in range(9, -1, -1):
        hi = F.lit(1.01) if i == 9 else F.lit(bounds[i + 1])
        b = F.when((F.col(overlap) >= F.lit(bounds[i])) & (F.col(overlap) < hi), F.lit(i)).otherwise(b)
    return df.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col(rank) <= 1, 1.0).otherwise(0.0)), 4).alias("recall_at_1"))


def quintiles(df: DataFrame, value: str, key: str, rank: str) -> DataFrame:
    """(quintile, n, mean_value, recall_at_1) of five slices of the order by (value, key), slice q from q*n//5 to (q+1)*n//5.

    Positions are counted per value first and the counts summed over the distinct values, so no task sorts all rows.
    """
    n = df.agg(F.count("*")).scalar()
    counts = df.groupBy(value).agg(F.count("*").alias("_k"))
    before = counts.withColumn("_before", F.sum("_k").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)))
    x = df.join(before.select(F.col(value).alias("_v"), F.coalesce("_before", F.lit(0)).alias("_before")), df[value] == F.col("_v"))
    x = x.withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(value).orderBy(key)) - 1)
    q = F.lit(4)
    for i in range(3, -1, -1):
        q = F.when(F.col("_i") < F.floor(F.lit(i + 1) * n / 5), F.lit(i)).otherwise(q)
    return x.withColumn("quintile", q + 1).groupBy("quintile").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.avg(F.when(F.col(rank) <= 1, 1.0).otherwise(0.0)), 4).alias("recall_at_1"))


def threshold_slices(df: DataFrame, overlap: str, rank: str) -> DataFrame:
    """One row: records and recall at 1 below an overlap of 0.3 and from 0.5 on."""
    hit = F.when(F.col(rank) <= 1, 1.0).otherwise(0.0)
    low, high = F.col(overlap) < F.lit(0.3), F.col(overlap) >= F.lit(0.5)
    return df.agg(F.count_if(low).alias("n_low"), F.round(F.avg(F.when(low, hit)), 4).alias("recall_low"), F.count_if(high).alias("n_high"), F.round(F.avg(F.when(high, hit)), 4).alias("recall_high"))


def span_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, exact match, mean F1, mean IoU and the share of IoU >= 0.5, of rows whose F1 and IoU are already rounded to 4 places."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("exact_match").cast("double")), 4).alias("exact_match"),
        F.round(F.avg("token_f1"), 4).alias("token_f1"),
        F.round(F.avg("sentence_iou"), 4).alias("sentence_iou"),
        F.round(F.avg((F.col("sentence_iou") >= 0.5).cast("double")), 4).alias("iou_at_half"),
    )
