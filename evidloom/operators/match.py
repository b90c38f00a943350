"""Locating evidence in the chunks of its article: exact at the smallest window, else the most similar window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.fuzzy import best_fuzzy_ratio
from evidloom.functions.text import holds, normalize, overlap_of, segment, token_set

#: Least ratio of a fuzzy match, least share of evidence tokens that a candidate window holds.
FUZZY, PREFILTER = 0.75, 0.3


def sentences_of(evidence: str) -> Column:
    return F.size(segment(evidence))


def exact_windows(claims: DataFrame, chunks: DataFrame, bounded: bool = False) -> DataFrame:
    """(final_id, source, chunk_id): the chunk that holds the normalised evidence, at the smallest window, then the first.

    ``bounded`` leaves out windows of more sentences than the claim's own evidence has.
    """
    e = claims.select("final_id", "source", normalize("evidence").alias("e"), sentences_of("evidence").alias("n")).where("e <> ''").distinct()
    c = chunks.select("source", "ord", "chunk_id", "window_size", normalize("text").alias("t"))
    hit = e.join(c, "source").where(F.lit(not bounded) | (F.col("window_size") <= F.col("n"))).where(holds("t", "e"))
    return hit.groupBy("final_id", "source", "e").agg(F.min_by("chunk_id", F.struct("window_size", "ord")).alias("chunk_id")).select("final_id", "source", "chunk_id").distinct()


def fuzzy_windows(claims: DataFrame, chunks: DataFrame, bounded: bool = False) -> DataFrame:
    """(final_id, source, e, chunk_id, ratio): the most similar window among those that share enough tokens, the first of equals.

    The cheap token test runs before the edit similarity; each different (evidence, window) of a source is compared
    once. ``bounded`` leaves out windows of more sentences than the claim's own evidence has.
    """
    n = sentences_of("evidence") if bounded else F.lit(0)
    e = claims.select("source", normalize("evidence").alias("e"), n.alias("n")).where("e <> ''").distinct().withColumn("es", token_set("e"))
    c = chunks.select("source", "ord", "chunk_id", "window_size", normalize("text").alias("t")).withColumn("cs", token_set("t"))
    near = e.join(c, "source").where(F.lit(not bounded) | (F.col("window_size") <= F.col("n"))).where(overlap_of("es", "cs") >= PREFILTER).select("source", "e", "n", "ord", "chunk_id", "t")
    scored = near.withColumn("ratio", best_fuzzy_ratio("e", "t"))
    best = scored.groupBy("source", "e", "n").agg(F.max_by(F.struct("chunk_id", "ratio"), F.struct("ratio", (-F.col("ord")).alias("o"))).alias("b")).select("source", "e", "n", "b.chunk_id", "b.ratio")
    own = claims.select("final_id", "source", normalize("evidence").alias("e"), n.alias("n")).distinct()
    return own.join(best, ["source", "e", "n"]).drop("n")


def long_windows(articles: DataFrame, claims: DataFrame, smallest: int = 4) -> DataFrame:
    """Chunks of 4 sentences up to the longest evidence of the source (or the whole article), for sources where one is that long.

    They serve all claims of the source; a claim is searched only in those that its own evidence allows (``bounded``).
    """
    need = claims.select("source", F.size(segment("evidence")).alias("n")).where(F.col("n") >= smallest).groupBy("source").agg(F.max("n").alias("n"))
    a = articles.join(need, "source").select("source", segment("text").alias("s"), "n").where(F.size("s") >= smallest)
    top = F.least("n", F.size("s"))
    sizes = F.sequence(F.lit(smallest), F.greatest(top, F.lit(smallest)))
    per = a.select("source", "s", F.explode(sizes).alias("k"))
    w = F.transform(F.sequence(F.lit(0), F.size("s") - F.col("k")), lambda i: F.struct(i.alias("start"), (i + F.col("k") - 1).alias("end"), F.array_join(F.slice("s", i + 1, F.col("k")), " ").alias("text")))
    x = per.where(F.col("k") <= F.size("s")).select("source", "k", F.explode(w).alias("w"))
    return x.select("source", (F.lit(1_000_000) * F.col("k") + F.col("w.start")).cast("int").alias("ord"), F.concat_ws("", F.col("source").cast("string"), F.lit(":"), F.col("w.start").cast("string"), F.lit("-"), F.col("w.end").cast("string")).alias("chunk_id"), F.col("k").alias("window_size"), F.col("w.text").alias("text"))


def gold_labels(claims: DataFrame, chunks: DataFrame, articles: DataFrame | None = None, threshold: float = FUZZY) -> DataFrame:
    """(final_id, source, chunk_id, match_type, similarity): exact, else fuzzy from ``threshold`` on, else none with the nearest miss.

    With ``articles`` a claim that isn't located and whose evidence has more than three sentences is looked for in
    longer windows, of as many sentences as its own evidence has at most; if that fails too, the longer windows' nearest miss replaces the first one. Claims whose
    evidence is blank are ``none`` without a chunk. similarity is rounded to 3 places after the test.
    """
    one = claims.select("final_id", "source", "evidence").distinct()

    def search(some: DataFrame, where: DataFrame, bounded: bool = False) -> DataFrame:
        ex = exact_windows(some, where, bounded).select("final_id", "source", F.col("chunk_id").alias("x"))
        rest = some.join(ex.select("final_id", "source"), ["final_id", "source"], "left_anti")
        fz = fuzzy_windows(rest, where, bounded).groupBy("final_id", "source").agg(F.max_by(F.struct("chunk_id", "ratio"), "ratio").alias("f"))
        got = some.select("final_id", "source").distinct().join(ex, ["final_id", "source"], "left").join(fz, ["final_id", "source"], "left")
        kind = F.when(F.col("x").isNotNull(), "exact").when(F.col("f.ratio") >= threshold, "fuzzy").otherwise("none")
        return got.select("final_id", "source", F.coalesce("x", "f.chunk_id").alias("chunk_id"), kind.alias("match_type"), F.round(F.when(F.col("x").isNotNull(), F.lit(1.0)).otherwise(F.coalesce("f.ratio", F.lit(0.0))), 3).alias("similarity"))

    first = search(one, chunks)
    if articles is None:
        return first
    missed = one.join(first.where("match_type = 'none'").select("final_id", "source"), ["final_id", "source"], "left_semi").where(F.size(segment("evidence")) > 3)
    more = search(missed, long_windows(articles, missed), bounded=True)
    hit = more.where("match_type <> 'none' or chunk_id is not null")
    return first.join(hit.select("final_id", "source"), ["final_id", "source"], "left_anti").unionByName(hit)


def located_in_article(claims: DataFrame, articles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(final_id, source, match_type): the evidence in its whole article, exact or by the best window of its length."""
    e = claims.select("final_id", "source", normalize("evidence").alias("e")).distinct()
    x = e.join(articles.select("source", normalize("text").alias("t")), "source", "left")
    exact = x.withColumn("exact", F.coalesce(holds("t", "e"), F.lit(False)))
    rest = exact.where(~F.col("exact")).withColumn("r", best_fuzzy_ratio("e", F.coalesce("t", F.lit(""))))
    kind = F.when(F.col("r") >= threshold, "fuzzy").otherwise("none")
    return exact.where("exact").select("final_id", "source", F.lit("exact").alias("match_type")).unionByName(rest.select("final_id", "source", kind.alias("match_type")))

