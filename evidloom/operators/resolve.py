"""Resolving missing sources from look-up tables that were fetched before, and patching the tables with the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import html_title
from evidloom.operators.relate import patched

#: Kinds of log events, the first that a title has decides.
EVENTS = ("move", "merge", "delete")


def resolution(missing: DataFrame, live: DataFrame, redirects: DataFrame, snapshots: DataFrame, titles: DataFrame, log: DataFrame) -> DataFrame:
    """source, resolved, resolution_method, title, resolved_pageid, wayback_found: the first way that works.

    live (source, title), redirects (source, target, title), snapshots (source, variant, html) of which the first
    variant counts, titles (title, pageid), log (title, kind, target_title). A move or merge resolves to the page
    of its target title; a deletion, a snapshot alone, and nothing at all leave the source unresolved.
    """
    m = missing.select("source").distinct()
    s = snapshots.groupBy("source").agg(F.min_by("html", "variant").alias("html")).select("source", html_title("html").alias("snap"), F.lit(True).alias("wayback"))
    ev = log.groupBy("title").agg(*(F.max(F.when(F.col("kind") == k, F.col("target_title"))).alias(f"{k}_to") for k in EVENTS[:2]), F.max((F.col("kind") == "delete").cast("int")).alias("gone"))
    t = titles.groupBy("title").agg(F.min("pageid").alias("pageid"))
    x = m.join(live.select("source", F.col("title").alias("live")), "source", "left").join(redirects.select("source", F.col("target").alias("rid"), F.col("title").alias("rtitle")), "source", "left").join(s, "source", "left")
    x = x.join(t.select(F.col("title").alias("snap"), F.col("pageid").alias("tid")), "snap", "left").join(ev.withColumnRenamed("title", "snap"), "snap", "left")
    for k in EVENTS[:2]:
        x = x.join(t.select(F.col("title").alias(f"{k}_to"), F.col("pageid").alias(f"{k}_id")), f"{k}_to", "left")
    has = lambda c: F.col(c).isNotNull()
    method = F.when(has("live"), "live").when(has("rid"), "redirect").when(has("tid"), "title_lookup").when(has("move_id"), "move").when(has("merge_id"), "merge").when(F.col("gone") == 1, "deleted").when(has("wayback"), "wayback_only").otherwise("unresolved")
    x = x.withColumn("resolution_method", method)
    pid = F.when(has("live"), F.col("source")).otherwise(F.coalesce("rid", "tid", "move_id", "merge_id"))
    title = F.coalesce("live", "rtitle", F.when(has("tid"), F.col("snap")), F.when(has("move_id"), F.col("move_to")), F.when(has("merge_id"), F.col("merge_to")), "snap")
    return x.select("source", F.col("resolution_method").isin("live", "redirect", "title_lookup", "move", "merge").alias("resolved"), "resolution_method", title.alias("title"), pid.alias("resolved_pageid"), F.coalesce("wayback", F.lit(False)).alias("wayback_found"))


def applied(ver: DataFrame, found: DataFrame) -> DataFrame:
    """The verification table with found, title, resolution_method and resolved_pageid of resolved sources filled in."""
    p = found.where("resolved").select("source", F.lit(True).alias("found"), "title", "resolution_method", "resolved_pageid")
    return patched(ver, p, "source", ["found", "title", "resolution_method", "resolved_pageid"])


def read_through(cache: DataFrame, fetched: DataFrame, key: str = "source") -> DataFrame:
    """(key, text): the cached text, or the fetched one where the cache has none or an empty one."""
    c, f = cache.select(key, F.col("text").alias("_c")), fetched.select(key, F.col("text").alias("_f"))
    return c.join(f, key, "full_outer").select(key, F.coalesce(F.nullif("_c", F.lit("")), "_f").alias("text"))


def to_fetch(wanted: DataFrame, cache: DataFrame, key: str = "source") -> DataFrame:
    """The wanted keys without a non-empty text in the cache, once each."""
    return wanted.select(key).distinct().join(cache.where("coalesce(text, '') <> ''").select(key), key, "left_anti")
