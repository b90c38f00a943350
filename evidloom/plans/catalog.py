"""The query catalogue: every operator of the pipeline over the test tables, by name, as functions of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.functions import text as T
from evidloom.operators import dense, lexical, match, metrics, profile, quality, relate, resolve, spans, splitting, treeagg, windows
from evidloom.session import checkpointed, shared_folder, table
from evidloom.streaming.resume import run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- the pipeline's tables, each record once


def articles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "articles")


def claims(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "arafa")


def chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "wikipedia_chunks").distinct()


def verification(s: SparkSession, d: str) -> DataFrame:
    return relate.verification_by_source(table(s, d, "source_verification").distinct())


def located(s: SparkSession, d: str, n_labels: int = 5, n_texts: int = 3) -> DataFrame:
    """One row for each (final_id, source) of the gold labels, with the texts of its claim.

    The row taken is the largest; so its first ``n_labels`` and ``n_texts`` columns don't need the others, and
    a query that asks for no more leaves the rest unread.
    """
    gold, a = table(s, d, "localization"), claims(s, d)
    one = lambda df, cols: df.groupBy("final_id", "source").agg(F.max(F.struct(*cols)).alias("r")).select("final_id", "source", "r.*")
    g = one(gold, ["gold_chunk_id", "gold_match_type", "judgement", "type", "split"][:n_labels])
    return g.join(one(a, ["claim", "evidence", "reasoning"][:n_texts]), ["final_id", "source"])


def gold_ranks(s: SparkSession, d: str, queries: DataFrame, text: str = "claim", **how) -> DataFrame:
    return lexical.gold_ranks(queries, table(s, d, "wikipedia_chunks"), "final_id", text, sized=table(s, d, "localization"), **how)


# ---- text


@query
def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query
def blank_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.is_blank("text").alias("blank"))


@query
def segment_sentences(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select("doc_id", F.posexplode(T.segment("text")).alias("i", "sentence"))
    return x


@query
def token_stats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), F.size(T.token_set("text")).alias("n_distinct"), T.digest("text").alias("sha256"), T.preview("text", 80).alias("preview"))


@query
def token_f1(s: SparkSession, d: str) -> DataFrame:
    return located(s, d).select("final_id", "source", F.round(T.token_f1("claim", "evidence"), 4).alias("f1"), T.exact_match("claim", "evidence").alias("exact"))


@query
def chunk_spans(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select("chunk_id", T.span_start("chunk_id").alias("s"), T.span_end("chunk_id").alias("e")).distinct()


@query
def span_iou(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d).select("source", "chunk_id").distinct()
    g = located(s, d).select("source", "gold_chunk_id").distinct()
    x = g.join(c, "source")
    iou = T.span_iou(T.span_start("chunk_id"), T.span_end("chunk_id"), T.span_start("gold_chunk_id"), T.span_end("gold_chunk_id"))
    return x.select("source", "gold_chunk_id", "chunk_id", F.round(iou, 6).alias("iou"))


@query
def html_title(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "articles")
    html = F.concat(F.lit("<html><head>\n<TITLE> "), F.coalesce("title", F.lit("")), F.lit(" - Wiki, the encyclopedia</title></head><body>"), F.coalesce("text", F.lit("")), F.lit("</body></html>"))
    return a.select("source", T.html_title(html).alias("title"))


@query
def model_inputs(s: SparkSession, d: str) -> DataFrame:
    return located(s, d).select("final_id", "source", T.prefixed("claim", "multilingual-e5-small", "query").alias("query"), T.prefixed("evidence", "multilingual-E5-small", "passage").alias("passage"), T.clipped("claim", 8).alias("clipped"))


# ---- windows, crops, offsets


@query
def sentence_windows(s: SparkSession, d: str) -> DataFrame:
    return windows.chunks(articles(s, d))


@query
def windows_fixed_size(s: SparkSession, d: str) -> DataFrame:
    return windows.chunks(articles(s, d), largest=2, smallest=2)


@query
def corpus_flatten_dedup(s: SparkSession, d: str) -> DataFrame:
    """Documents as a dump: unknown ids only, each text once (the smallest id), single sentences of those that have any."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("source"), "text").where("coalesce(text, '') <> ''")
    known = table(s, d, "eval_items").select(F.col("item_id").alias("source"))
    new = relate.excluding(docs, known, "source")
    first = new.groupBy("text").agg(F.min("source").alias("source"))
    return windows.chunks(first, largest=1)


@query
def sliding_crops(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).select("source", F.size(T.segment("text")).alias("n"))
    return a.select("source", F.posexplode(windows.crops(F.col("n"))).alias("i", "c")).select("source", "i", F.col("c.start").alias("crop_start"), F.col("c.end").alias("crop_end"))


@query
def sentence_offsets(s: SparkSession, d: str) -> DataFrame:
    return articles(s, d).select("source", F.posexplode(windows.offsets(T.segment("text"))).alias("i", "at"))


@query
def char_to_sentence(s: SparkSession, d: str) -> DataFrame:
    a = articles(s, d).select("source", windows.offsets(T.segment("text")).alias("o"))
    x = a.select("source", windows.char_to_sentences(F.col("o"), F.lit(40), F.lit(160)).alias("r"))
    return x.select("source", F.col("r.first").alias("first_sentence"), F.col("r.last").alias("last_sentence"))


@query
def qa_examples(s: SparkSession, d: str) -> DataFrame:
    return spans.examples(located(s, d), chunks(s, d)).select("final_id", "source", "gold_start", "gold_end", F.size("sents").alias("n_sents"), "gold_text")


@query
def crops_with_gold(s: SparkSession, d: str) -> DataFrame:
    return spans.training_crops(spans.examples(located(s, d), chunks(s, d))).select("final_id", "source", "crop_start", "crop_end", "char_start", "char_end")


@query
def centered_crops(s: SparkSession, d: str) -> DataFrame:
    return spans.training_crops(spans.examples(located(s, d), chunks(s, d)), centered=True).select("final_id", "source", "crop_start", "crop_end", "char_start", "char_end")


@query
def bm25_crops(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    return spans.search_crops(spans.examples(located(s, d), c), c)


@query
def span_summary(s: SparkSession, d: str) -> DataFrame:
    """Spans predicted as the best chunk of BM25, evaluated by match type."""
    loc, c = located(s, d), chunks(s, d)
    top = lexical.rank_in_document(loc, c, "final_id", "claim", k=1).select("final_id", "source", "chunk_id")
    t = c.select("source", "chunk_id", "text").distinct()
    x = loc.join(top, ["final_id", "source"]).join(t.withColumnRenamed("text", "pred_text"), ["source", "chunk_id"])
    x = x.join(t.select("source", F.col("chunk_id").alias("gold_chunk_id"), F.col("text").alias("gold_text")), ["source", "gold_chunk_id"])
    x = x.select("final_id", "source", "gold_match_type", "pred_text", "gold_text", T.span_start("chunk_id").alias("pred_start"), T.span_end("chunk_id").alias("pred_end"), T.span_start("gold_chunk_id").alias("gold_start"), T.span_end("gold_chunk_id").alias("gold_end"))
    return metrics.span_summary(spans.evaluated(x), ["gold_match_type"])


# ---- profile


@query
def profile_totals(s: SparkSession, d: str) -> DataFrame:
    return profile.totals(claims(s, d), "final_id")


@query
def profile_judgements(s: SparkSession, d: str) -> DataFrame:
    return profile.histogram(claims(s, d), F.lower(F.trim("judgement")))


@query
def profile_types(s: SparkSession, d: str) -> DataFrame:
    return profile.histogram(claims(s, d), "type")


@query
def profile_crosstab(s: SparkSession, d: str) -> DataFrame:
    return profile.crosstab(claims(s, d), "type", "judgement")


@query
def profile_lengths(s: SparkSession, d: str) -> DataFrame:
    return profile.text_lengths(claims(s, d), ["claim", "evidence", "reasoning", "type"])


@query
def field_completeness(s: SparkSession, d: str) -> DataFrame:
    return profile.completeness(claims(s, d), ["claim", "evidence", "judgement", "reasoning", "entity_in_claim", "co_referenced_in_evidence", "co_referenced_in_text", "type"])


@query
def json_completeness(s: SparkSession, d: str) -> DataFrame:
    return profile.json_completeness(table(s, d, "events"), "props", ["k", "absent"])


@query
def unexpected_fields(s: SparkSession, d: str) -> DataFrame:
    return profile.unexpected_fields(table(s, d, "events"), "props", ["other"])


@query
def records_per_source(s: SparkSession, d: str) -> DataFrame:
    return profile.records_per_key(claims(s, d), "source")


@query
def records_per_customer(s: SparkSession, d: str) -> DataFrame:
    return profile.records_per_key(table(s, d, "orders"), "o_custkey")


@query
def top10_sources(s: SparkSession, d: str) -> DataFrame:
    return profile.top_keys(claims(s, d), "source")


@query
def first_seen_sources(s: SparkSession, d: str) -> DataFrame:
    return profile.first_seen(claims(s, d), "source", "final_id")


@query
def verification_counts(s: SparkSession, d: str) -> DataFrame:
    v = verification(s, d)
    return profile.conditional_counts(v, {"sources": F.lit(True), "not_found": ~F.col("found"), "unresolved": F.col("resolution_method").isNull() & ~F.col("found"), "failed": F.col("error") == "request_failed"})


@query
def match_type_summary(s: SparkSession, d: str) -> DataFrame:
    return profile.histogram(located(s, d), "gold_match_type")


@query
def evidence_lengths(s: SparkSession, d: str) -> DataFrame:
    n = F.size(T.segment("evidence"))
    g = located(s, d).withColumn("n", n).groupBy("gold_match_type")
    return g.agg(F.count("*").alias("claims"), F.round(F.avg("n"), 3).alias("mean_sentences"), F.count_if(F.col("n") > 3).alias("long"), F.round(F.avg((F.col("n") > 3).cast("double")), 4).alias("share_long"))


# ---- joins and sets


@query
def verified_left_join(s: SparkSession, d: str) -> DataFrame:
    return relate.with_verification(claims(s, d).select("final_id", "source").distinct(), verification(s, d))


@query
def verified_semi(s: SparkSession, d: str) -> DataFrame:
    return relate.verified(claims(s, d).select("final_id", "source").distinct(), verification(s, d))


@query
def exclude_known_anti(s: SparkSession, d: str) -> DataFrame:
    """Articles in which no evidence of the validation records was found word for word."""
    known = table(s, d, "localization").where("gold_match_type = 'exact' and split = 'val'")
    return relate.excluding(articles(s, d).select("source", "title"), known.select("source"), "source")


@query
def update_join(s: SparkSession, d: str) -> DataFrame:
    """Sources that were not found, patched from their resolved attempts."""
    v = table(s, d, "source_verification")
    failed = v.where("not found").groupBy("source").agg(F.max("error").alias("error")).withColumn("found", F.lit(False)).withColumn("resolved_pageid", F.lit(None).cast("bigint"))
    p = v.where("resolved_pageid > 0").groupBy("source").agg(F.max("resolved_pageid").alias("resolved_pageid")).withColumn("found", F.lit(True))
    return relate.patched(failed, p, "source", ["found", "resolved_pageid"]).select("source", "error", "found", "resolved_pageid")


@query
def upsert(s: SparkSession, d: str) -> DataFrame:
    v = verification(s, d).select("source", "title")
    return relate.upserted(articles(s, d).select("source", "title"), v.where("title is not null"), "source")


@query
def append_extended(s: SparkSession, d: str) -> DataFrame:
    a, c = articles(s, d), chunks(s, d).select("source", "ord", "chunk_id", "window_size")
    long = windows.chunks(a, largest=4, smallest=4).select("source", "ord", "chunk_id", "window_size")
    return relate.appended_chunks(c, long)


@query
def reject_reasons(s: SparkSession, d: str) -> DataFrame:
    r = relate.with_reasons(claims(s, d), table(s, d, "localization"), chunks(s, d))
    return r.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def set_differences(s: SparkSession, d: str) -> DataFrame:
    """Sources of longer articles against those of test records."""
    return relate.differences(articles(s, d).where("num_sentences > 10").select("source"), table(s, d, "localization").where("split = 'test'").select("source"))


@query
def bookkeeping(s: SparkSession, d: str) -> DataFrame:
    return relate.bookkeeping(articles(s, d), verification(s, d), chunks(s, d))


@query
def cache_to_fetch(s: SparkSession, d: str) -> DataFrame:
    """What a cache of the longer articles lacks."""
    return resolve.to_fetch(claims(s, d), articles(s, d).where("num_sentences > 10"))


@query
def read_through(s: SparkSession, d: str) -> DataFrame:
    fetched = table(s, d, "documents").where("kind = 'article'").select(F.col("doc_id").alias("source"), "text")
    return resolve.read_through(articles(s, d), fetched).select("source", F.length("text").alias("n"))


@query
def batches(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "eval_items").select("item_id")
    return relate.batched(x, "item_id").groupBy("batch").agg(F.count("*").alias("n"))


# ---- samples and splits


@query
def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return splitting.sampled(claims(s, d).select("final_id").distinct(), "final_id", 100)


@query
def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return splitting.stratified(claims(s, d), "source")


@query
def split_mix(s: SparkSession, d: str) -> DataFrame:
    return splitting.mix(located(s, d))


@query
def split_leaks(s: SparkSession, d: str) -> DataFrame:
    """Mutation types that stand in more than one split (sources may not, and do not)."""
    return splitting.leaks(table(s, d, "localization"), "type")


# ---- evidence


@query
def evidence_exact_window(s: SparkSession, d: str) -> DataFrame:
    return match.exact_windows(claims(s, d), chunks(s, d))


@query
def evidence_gold(s: SparkSession, d: str) -> DataFrame:
    return match.gold_labels(claims(s, d), chunks(s, d), articles(s, d))


@query
def evidence_article(s: SparkSession, d: str) -> DataFrame:
    return match.located_in_article(claims(s, d), articles(s, d))


@query
def token_overlap(s: SparkSession, d: str) -> DataFrame:
    return located(s, d).select("final_id", "source", F.round(T.containment("claim", "evidence"), 6).alias("overlap"))


def _overlap_ranks(s: SparkSession, d: str) -> DataFrame:
    loc = located(s, d, 3, 2).withColumn("overlap", F.round(T.containment("claim", "evidence"), 6))
    return gold_ranks(s, d, loc, also=("judgement", "overlap"))


@query
def overlap_bins(s: SparkSession, d: str) -> DataFrame:
    return metrics.overlap_bins(_overlap_ranks(s, d), "overlap", "rank")


@query
def overlap_quintiles(s: SparkSession, d: str) -> DataFrame:
    x = _overlap_ranks(s, d).select("overlap", "rank", (F.col("final_id") * F.lit(10_000_000_000) + F.col("source")).alias("k"))
    return metrics.quintiles(checkpointed(x), "overlap", "k", "rank")  # which reads them three times


@query
def overlap_subgroups(s: SparkSession, d: str) -> DataFrame:
    return _overlap_ranks(s, d).groupBy("judgement").agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 3).alias("mean_overlap"))


@query
def overlap_slices(s: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_slices(_overlap_ranks(s, d), "overlap", "rank")


# ---- retrieval


@query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return lexical.rank_in_document(located(s, d), chunks(s, d), "final_id", "claim", k=10).select("final_id", "source", "chunk_id", "score", "rk")


@query
def bm25_gold_ranks(s: SparkSession, d: str) -> DataFrame:
    return gold_ranks(s, d, located(s, d, 1, 1))


@query
def bm25_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(gold_ranks(s, d, located(s, d, 1, 1)))


@query
def bm25_oracle_ceiling(s: SparkSession, d: str) -> DataFrame:
    return metrics.retrieval_metrics(gold_ranks(s, d, located(s, d, 1, 2), "evidence"))


@query
def bm25_relaxed_ranks(s: SparkSession, d: str) -> DataFrame:
    loc = located(s, d)
    return metrics.ranks_of(lexical.rank_in_document(loc, chunks(s, d), "final_id", "claim"), loc, "final_id")


@query
def bm25_relaxed_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.relaxed_metrics(bm25_relaxed_ranks(s, d))


@query
def bm25_recall_gate(s: SparkSession, d: str) -> DataFrame:
    """How often the gold chunk is among the first 50: what a reranker of those can reach at most."""
    return metrics.retrieval_metrics(gold_ranks(s, d, located(s, d, 1, 1), k=50), ks=(50,))


def _dense_in_article(s: SparkSession, d: str) -> DataFrame:
    vector = lambda df, c: df.withColumn("v", dense.hashed(c))
    q = located(s, d).where(F.size(T.tokens("claim")) > 0).select("final_id", "source", "claim").distinct()
    return dense.rank_in_scope(vector(q, "claim"), vector(chunks(s, d).select("source", "ord", "chunk_id", "text"), "text"), "final_id", "source", "chunk_id", "ord", "v")


@query
def dense_in_article(s: SparkSession, d: str) -> DataFrame:
    """Each claim's 10 nearest chunks of its article by hashed vectors; a trained encoder's come in the same way."""
    return _dense_in_article(s, d).where("rk <= 10").select("final_id", "source", "chunk_id", "score", "rk")


@query
def dense_in_article_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.relaxed_metrics(metrics.ranks_of(_dense_in_article(s, d), located(s, d), "final_id"))


@query
def hybrid_dense_metrics(s: SparkSession, d: str) -> DataFrame:
    """BM25 and dense lists of 50 fused by reciprocal rank, and where the gold chunk stands in the fused list."""
    loc = located(s, d)
    key = lambda x: x.withColumn("qid", F.concat_ws(":", F.col("final_id").cast("string"), F.col("source").cast("string")))
    f = dense.fused([key(lexical.rank_in_document(loc, chunks(s, d), "final_id", "claim", k=50)), key(_dense_in_article(s, d))], "qid", "chunk_id", k=50)
    r = key(loc).select("qid", F.col("gold_chunk_id").alias("chunk_id")).join(f, ["qid", "chunk_id"], "left").withColumnRenamed("rk", "rank")
    return metrics.retrieval_metrics(r)


@query
def metric_breakdown(s: SparkSession, d: str) -> DataFrame:
    return metrics.breakdown(gold_ranks(s, d, located(s, d, 4, 1), also=("judgement", "type", "gold_match_type")))


@query
def bm25_open_topk(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "eval_items").where("coalesce(text, '') <> ''")
    docs = table(s, d, "documents").where("coalesce(text, '') <> ''")
    return lexical.rank_in_collection(items, docs, "item_id", "text", "doc_id", "text")


@query
def hard_negatives(s: SparkSession, d: str) -> DataFrame:
    loc, c = located(s, d), chunks(s, d)
    return lexical.hard_negatives(lexical.rank_in_document(loc, c, "final_id", "claim", k=40), loc, c, "final_id")


@query
def reranker_pairs(s: SparkSession, d: str) -> DataFrame:
    loc, c = located(s, d), chunks(s, d)
    return lexical.reranker_pairs(lexical.rank_in_document(loc, c, "final_id", "claim", k=40), loc, c, "final_id")


@query
def training_triples(s: SparkSession, d: str) -> DataFrame:
    loc, c = located(s, d), chunks(s, d)
    neg = lexical.hard_negatives(lexical.rank_in_document(loc, c, "final_id", "claim", k=40), loc, c, "final_id", n=1)
    t = c.select("source", "chunk_id", "text").distinct()
    pos = loc.select("final_id", "source", "claim", "gold_chunk_id").join(t.select("source", F.col("chunk_id").alias("gold_chunk_id"), F.col("text").alias("positive")), ["source", "gold_chunk_id"])
    return pos.join(neg.select("final_id", "source", "chunk_id"), ["final_id", "source"]).join(t.withColumnRenamed("text", "negative"), ["source", "chunk_id"]).select("final_id", "source", "claim", "positive", "negative")


@query
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").withColumn("v", dense.unit("embedding"))
    return dense.top_by_product(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "v")


@query
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    loc, c = located(s, d), chunks(s, d)
    a = lexical.rank_in_document(loc, c, "final_id", "claim", k=10)
    b = lexical.rank_in_document(loc, c, "final_id", "reasoning", k=10)
    key = lambda x: x.withColumn("qid", F.concat_ws(":", F.col("final_id").cast("string"), F.col("source").cast("string")))
    return dense.fused([key(a), key(b)], "qid", "chunk_id")


@query
def hybrid_metrics(s: SparkSession, d: str) -> DataFrame:
    loc = located(s, d).withColumn("qid", F.concat_ws(":", F.col("final_id").cast("string"), F.col("source").cast("string")))
    f = rrf_fusion(s, d).select("qid", "chunk_id", "rk")
    r = loc.select("qid", "gold_chunk_id").join(f.withColumnRenamed("chunk_id", "gold_chunk_id"), ["qid", "gold_chunk_id"], "left").withColumnRenamed("rk", "rank")
    return metrics.retrieval_metrics(r)


# ---- quality and resolution


@query
def dataset_compare(s: SparkSession, d: str) -> DataFrame:
    """The documents against an edited copy: one title changed in fifty, one record in seventy missing."""
    a = table(s, d, "documents").select("doc_id", "text", "title", "source")
    b = a.where("doc_id % 70 <> 0").withColumn("title", F.when(F.col("doc_id") % 50 == 0, F.lit("changed")).otherwise(F.col("title")))
    return quality.compared(a, b, "doc_id", ["text", "title", "source"])


@query
def content_hash(s: SparkSession, d: str) -> DataFrame:
    return quality.content_hash(table(s, d, "documents"), "doc_id", ["text", "title", "source"])


@query
def json_well_formed(s: SparkSession, d: str) -> DataFrame:
    return quality.well_formed(table(s, d, "events"), "props")


FIXTURE = {
    "missing": ("source bigint", [(1,), (2,), (3,), (4,), (5,), (6,), (7,), (8,)]),
    "live": ("source bigint, title string", [(1, "Alpha")]),
    "redirects": ("source bigint, target bigint, title string", [(2, 22, "Beta")]),
    "snapshots": ("source bigint, variant int, html string", [(3, 1, "<title>Gamma - Wiki</title>"), (3, 2, "<title>Wrong - Wiki</title>"), (4, 1, "<title> Delta - Wiki</title>"), (5, 2, "<TITLE>Epsilon</TITLE>"), (6, 1, "<title>Zeta - W</title>"), (7, 1, "<html>no title</html>")]),
    "titles": ("title string, pageid bigint", [("Gamma", 33), ("Delta two", 44), ("Epsilon two", 55)]),
    "log": ("title string, kind string, target_title string", [("Delta", "move", "Delta two"), ("Epsilon", "merge", "Epsilon two"), ("Zeta", "delete", None)]),
}


@query
def resolution_cascade(s: SparkSession, d: str) -> DataFrame:
    t = {n: s.createDataFrame(rows, schema) for n, (schema, rows) in FIXTURE.items()}
    return resolve.resolution(t["missing"], t["live"], t["redirects"], t["snapshots"], t["titles"], t["log"])


@query
def resume_stream(s: SparkSession, d: str) -> DataFrame:
    """The events run through the resumable stream into a fresh folder: each event once."""
    base = shared_folder(s, "stream")
    folder = f"{base}/in"
    e = table(s, d, "events")
    e.select("event_id", "user_id", "event_type").write.mode("overwrite").parquet(folder)
    for _ in range(2):  # the second call finds nothing new
        run_available(s, folder, "event_id bigint, user_id bigint, event_type string", "event_id", f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out")


# ---- skewed keys (problem 5)


def _per_source(s: SparkSession, d: str) -> DataFrame:
    j = F.lower(F.trim("judgement"))
    return treeagg.tree_aggregate(claims(s, d), "source", [
        treeagg.count_of("records"), treeagg.sum_of("claim_chars", F.length("claim").cast("bigint")), treeagg.max_of("longest_evidence", F.length("evidence")),
        *(treeagg.count_of(n, F.coalesce(j == n, F.lit(False))) for n in ("supported", "refuted", "nei")),
    ])


@query
def p5_found(s: SparkSession, d: str) -> DataFrame:
    counted = treeagg.tree_aggregate(claims(s, d), "source", [treeagg.count_of("records")])
    return treeagg.heavy_keys(counted, "source", "records", 0.03).select("source")


@query
def p5_sources(s: SparkSession, d: str) -> DataFrame:
    return _per_source(s, d)
