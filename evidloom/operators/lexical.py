"""BM25 within known documents and over a whole collection, as joins of term tables.

Scores are doubles, rounded to six places before they order anything: sums in shuffle order differ in the last
bits, and the rounding makes ties the same in every run. Of equal scores the higher ordinal comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions.text import tokens

K1, B = 1.5, 0.75
#: Queries of a source that one task takes.
PART = 2_000


def term_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, term, tf, dl: how often each term occurs in each text, and the text's number of tokens."""
    t = df.select(*keys, tokens(text).alias("_t"))
    return t.select(*keys, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")).select(*keys, "term", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl"))


def collection_stats(docs: DataFrame, scope: list[str], text: str) -> DataFrame:
    """scope, n, avgdl: number of texts and their mean length; texts without tokens count."""
    d = docs.select(*scope, F.size(tokens(text)).cast("double").alias("dl"))
    agg = [F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl")]
    return d.groupBy(*scope).agg(*agg) if scope else d.agg(*agg)


def weight(tf: str, dl: str, n: Column | None = None, avgdl: Column | None = None, k1: float = K1, b: float = B) -> Column:
    """What a term adds to a text's score each time a query has it, of columns tf, dl, df and, if not given, n and avgdl."""
    n, avgdl = F.col("n") if n is None else n, F.col("avgdl") if avgdl is None else avgdl
    idf = F.log((n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + F.lit(1.0))
    return idf * F.col(tf) * F.lit(k1 + 1) / (F.col(tf) + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col(dl) / avgdl))


def postings(docs: DataFrame, scope: list[str], doc: list[str], text: str, k1: float = K1, b: float = B) -> DataFrame:
    """scope, doc, term, weight: what a term of a text adds to its score each time a query has it."""
    # within a document's scope a term's texts fit a window, and the queries join on the same partitioning; over a
    # whole collection a frequent term is in any part of it, so its texts are counted apart, with partial sums
    tc = term_counts(docs, [*scope, *doc], text)
    if scope:
        x = tc.withColumn("df", F.count("*").over(Window.partitionBy(*scope, "term")).cast("double"))
    else:
        x = tc.join(tc.groupBy("term").agg(F.count("*").cast("double").alias("df")), "term")
    st = collection_stats(docs, scope, text)
    # one row of statistics a scope; without a scope it is a single row, whose values are taken as such
    if scope:
        x = x.join(st, scope)
        n, avgdl = F.col("n"), F.col("avgdl")
    else:
        n, avgdl = st.select("n").scalar(), st.select("avgdl").scalar()
    return x.select(*scope, *doc, "term", weight("tf", "dl", n, avgdl, k1, b).alias("weight"))


def scores(queries: DataFrame, query: list[str], text: str, index: DataFrame, scope: list[str], doc: list[str]) -> DataFrame:
    """query, doc, score of all pairs that share a term; a term that a query repeats counts each time."""
    q = term_counts(queries, [*query, *scope], text).select(*query, *scope, "term", F.col("tf").alias("_qtf"))
    s = q.join(index, [*scope, "term"]).groupBy(*query, *scope, *doc).agg(F.sum(F.col("_qtf") * F.col("weight")).alias("s"))
    return s.select(*query, *scope, *doc, F.round("s", 6).alias("score"))


def rank_in_document(queries: DataFrame, chunks: DataFrame, query: str, text: str, k: int = 50) -> DataFrame:
    """(query, source, chunk_id, ord, score, rk): each query's best k chunks of its known source.

    ``queries`` has ``query``, source and the text; ``chunks`` source, ord, chunk_id and text. Chunks that share
    no term score 0 and are ranked too. A query without tokens, or whose source has no chunks, has no rows.
    """
    idx = postings(chunks, ["source"], ["ord"], "text")
    hit = scores(queries, [query], text, idx, ["source"], ["ord"])
    w = Window.partitionBy(query, "source").orderBy(F.desc("score"), F.desc("ord"))
    best = hit.where("score > 0").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    # queries of fewer than k hits are filled up with the last of the others: those are among the source's last 2 k
    have = best.groupBy(query, "source").agg(F.max("rk").alias("_h"), F.collect_list("ord").alias("_own"))
    q = queries.where(F.size(tokens(text)) > 0).select(query, "source").distinct()
    short = q.join(have, [query, "source"], "left").withColumn("_h", F.coalesce("_h", F.lit(0))).where(F.col("_h") < k)
    last = chunks.groupBy("source").agg(F.array_sort(F.collect_set("ord")).alias("_o")).select("source", F.expr(f"slice(_o, greatest(1, size(_o) - {2 * k} + 1), {2 * k})").alias("_o"))
    rest = short.join(last, "source").withColumn("_o", F.reverse(F.array_except("_o", F.coalesce("_own", F.array().cast("array<int>")))))
    fill = rest.select(query, "source", F.lit(0.0).alias("score"), "_h", F.posexplode(F.slice("_o", F.lit(1), F.lit(k) - F.col("_h"))).alias("_p", "ord"))
    all_ = best.select(query, "source", "ord", "score", "rk").unionByName(fill.select(query, "source", "ord", "score", (F.col("_h") + F.col("_p") + 1).alias("rk")))
    return all_.join(chunks.select("source", "ord", "chunk_id"), ["source", "ord"]).select(query, "source", "chunk_id", "ord", "score", "rk")


def gold_ranks(queries: DataFrame, chunks: DataFrame, query: str, text: str, k: int = 50, also: tuple[str, ...] = (), sized: DataFrame | None = None) -> DataFrame:
    """query, source, gold_chunk_id, ``also`` and rank: that of each query's gold chunk, null where it isn't among the best k.

    Only chunks that share a term are scored: a gold chunk without score ranks after all of those, among the
    others by its ordinal. So the chunks that score 0 are counted, never listed. Rows that ``queries`` or ``chunks``
    repeat count once.

    Queries and chunks are shuffled together, once, by source and part; terms, hits and counts stay where they are
    made. A source of many queries is in several parts, each with all of its chunks. ``sized`` has about a row for
    each query with its source, by which parts are sized; any such table gives the same ranks.
    """
    scope = ["source", "_part"]
    n = (queries if sized is None else sized).groupBy("source").agg(F.count("*").alias("_n"))
    # a row for each PART queries at most
    parts = F.broadcast(n.where(F.col("_n") > PART).select("source", F.ceil(F.col("_n") / PART).cast("int").alias("_parts")))
    of = F.coalesce("_parts", F.lit(1))
    rest = [c for c in chunks.columns if c not in ("source", "ord", "chunk_id", "text")]
    asked = queries.join(parts, "source", "left").withColumn("_part", F.pmod(F.xxhash64(query), of).cast("int"))
    asked = asked.select(*scope, F.struct(query, *also).alias("_q"), F.col("gold_chunk_id").alias("_id"), F.col(text).alias("_text"))
    there = chunks.where("source is not null").join(parts, "source", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of - 1)))
    there = there.select(*scope, "ord", F.col("chunk_id").alias("_id"), F.col("text").alias("_text"), F.struct(F.lit(0), *rest).alias("_rest"))
    both = asked.unionByName(there, allowMissingColumns=True).repartition(*scope).distinct()
    # a row is a chunk where _q is null: from here on its place from the end, the source's statistics, and the gold chunk of queries
    chunk = F.col("_q").isNull()
    own, same = Window.partitionBy(*scope), Window.partitionBy(*scope, "_id")
    x = both.select(*scope, "_q", "ord", "_id", tokens("_text").alias("_t"), F.monotonically_increasing_id().alias("_row"))
    x = x.withColumn("_behind", F.row_number().over(own.orderBy(F.col("_q").isNotNull(), F.desc("ord"))) - 1)
    x = x.withColumn("n", F.count_if(chunk).over(own).cast("double")).withColumn("avgdl", F.avg(F.when(chunk, F.size("_t").cast("double"))).over(own))
    gold = lambda c: F.when(F.col("_id").isNotNull(), c.over(same))
    x = x.withColumn("_g", gold(F.max(F.when(chunk, F.col("ord"))))).withColumn("_behind", gold(F.min(F.when(chunk, F.col("_behind")))))
    # queries have an empty term too, which no chunk has: with it goes what the result has of them
    entry = F.struct("_q", F.col("_id").alias("gold_chunk_id"), (F.size("_t") > 0).alias("some"), "_behind")
    x = x.select(*scope, "_row", chunk.alias("_c"), "ord", "_g", "n", "avgdl", F.size("_t").alias("dl"), F.when(~chunk, entry).alias("_e"), F.explode(F.when(chunk, F.col("_t")).otherwise(F.array_append("_t", F.lit("")))).alias("term"))
    x = x.withColumn("_e", F.when(F.col("term") == "", F.col("_e")))
    in_chunks = F.col("_c")
    tf = x.groupBy(*scope, "term", "_c", F.when(in_chunks, F.col("ord")).otherwise(F.col("_g")).alias("_o"), F.when(~in_chunks, F.col("_row")).alias("_row"), F.when(in_chunks, F.col("dl")).alias("dl"), "n", "avgdl", "_e").agg(F.count("*").cast("double").alias("tf"))
    met = tf.groupBy(*scope, "term", "n", "avgdl").agg(
        F.collect_list(F.when(in_chunks, F.struct(F.col("_o").alias("ord"), "dl", "tf"))).alias("_p"),
        F.collect_list(F.when(~in_chunks, F.struct("_row", F.col("_o").alias("_g"), F.col("tf").alias("_qtf"), "_e"))).alias("_a"),
    )
    met = met.select(*scope, "n", "avgdl", F.size("_p").cast("double").alias("df"), "_p", F.explode("_a").alias("_a")).select(*scope, "n", "avgdl", "df", "_a.*", F.explode_outer("_p").alias("_p"))
    hit = met.groupBy(*scope, "_row", "_g", "_e", F.col("_p.ord").alias("_o")).agg(F.sum(F.col("_qtf") * weight("_p.tf", "_p.dl")).alias("s"))
    hit = hit.withColumn("s", F.round("s", 6)).select(*scope, "_row", "_g", "_e", "_o", F.when(F.col("s") > 0, F.col("s")).alias("_s"))
    hit = hit.withColumn("_gs", F.max(F.when(F.col("_o") == F.col("_g"), F.col("_s"))).over(Window.partitionBy(*scope, "_row")))
    better = hit.groupBy(*scope, "_row", "_g", "_gs").agg(
        F.first("_e", ignorenulls=True).alias("_e"),
        F.count_if((F.col("_s") > F.col("_gs")) | ((F.col("_s") == F.col("_gs")) & (F.col("_o") > F.col("_g")))).alias("above"),
        F.count("_s").alias("positive"),
        F.count_if(F.col("_s").isNotNull() & (F.col("_o") > F.col("_g"))).alias("positive_after"),
    )
    after = F.col("_e._behind") - F.col("positive_after")
    rank = F.when(F.col("_gs").isNotNull(), 1 + F.col("above")).otherwise(1 + F.col("positive") + after)
    ok = F.col("_e.some") & F.col("_g").isNotNull()
    return better.select(f"_e._q.{query}", "source", "_e.gold_chunk_id", *(f"_e._q.{c}" for c in also), F.when(ok & (rank <= k), rank).cast("bigint").alias("rank"))


def rank_in_collection(queries: DataFrame, docs: DataFrame, query: str, text: str, doc: str, doc_text: str, k: int = 10) -> DataFrame:
    """(query, doc, score, rk): each query's best k texts of a collection, ties by the larger id; only texts that share a term."""
    idx = postings(docs.select(doc, doc_text), [], [doc], doc_text)
    hit = scores(queries, [query], text, idx, [], [doc])
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(doc))
    return hit.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select(query, doc, "score", "rk")


def hard_negatives(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, query: str, n: int = 7, seed: int = 42) -> DataFrame:
    """(query, source, chunk_id, place): the n best chunks that aren't gold, filled from the rest in seeded order."""
    top = max(40, 5 * n)
    gold = queries.select(query, "source", "gold_chunk_id").where("gold_chunk_id is not null").distinct()
    r = ranked.where(F.col("rk") <= top).select(query, "source", "chunk_id", "rk")
    own = chunks.select("source", "chunk_id").distinct()
    w = Window.partitionBy(query, "source").orderBy("rk")
    best = gold.join(r, [query, "source"]).where("chunk_id <> gold_chunk_id").join(own, ["source", "chunk_id"], "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    have = r.groupBy(query, "source").agg(F.collect_list("chunk_id").alias("_own"))
    count = best.groupBy(query, "source").agg(F.max("place").alias("_h"))
    short = gold.join(count, [query, "source"], "left").withColumn("_h", F.coalesce("_h", F.lit(0))).where(F.col("_h") < n).join(have, [query, "source"], "left")
    # a source's first chunks in seeded order, as many as are enough whatever is taken already
    seeded = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "chunk_id")), "chunk_id")
    first = own.withColumn("_i", F.row_number().over(seeded)).where(F.col("_i") <= top + n + 1).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("_i", "chunk_id"))).alias("_f"))
    rest = short.join(first, "source").withColumn("_f", F.array_except(F.transform("_f", lambda x: x["chunk_id"]), F.array_append(F.coalesce("_own", F.array().cast("array<string>")), F.col("gold_chunk_id"))))
    fill = rest.select(query, "source", "_h", F.posexplode(F.slice("_f", F.lit(1), F.lit(n) - F.col("_h"))).alias("_p", "chunk_id"))
    return best.select(query, "source", "chunk_id", "place").unionByName(fill.select(query, "source", "chunk_id", (F.col("_h") + F.col("_p") + 1).alias("place")))


def reranker_pairs(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, query: str, n: int = 4) -> DataFrame:
    """(query, chunk_id, label): the gold chunk as 1 and the n best others of the top 40 as 0."""
    gold = queries.select(query, "source", "gold_chunk_id").distinct()
    pos = gold.join(chunks.select("source", F.col("chunk_id").alias("gold_chunk_id")).distinct(), ["source", "gold_chunk_id"]).select(query, F.col("gold_chunk_id").alias("chunk_id"), F.lit(1).alias("label"))
    neg = ranked.where("rk <= 40").join(gold, [query, "source"]).where("chunk_id <> gold_chunk_id")
    neg = neg.withColumn("p", F.row_number().over(Window.partitionBy(query, "source").orderBy("rk"))).where(F.col("p") <= n)
    return pos.unionByName(neg.select(query, "chunk_id", F.lit(0).alias("label"))).distinct()
