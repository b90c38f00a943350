import random

import pytest
from pyspark.sql import functions as F

from evidloom.operators import dense, lexical, match, metrics, profile, quality, relate, resolve, splitting, treeagg, windows
from evidloom.plans.catalog import FIXTURE


def test_window_counts_and_order(spark):
    df = spark.createDataFrame([(1, "A. B. C. D."), (2, ""), (3, None), (4, "One."), (4, "One.")], "source long, text string")
    c = windows.chunks(df).orderBy("source", "ord").collect()
    assert [r.chunk_id for r in c if r.source == 1] == ["1:0-0", "1:1-1", "1:2-2", "1:3-3", "1:0-1", "1:1-2", "1:2-3", "1:0-2", "1:1-3"]
    assert {r.source for r in c} == {1, 4} and sum(r.source == 4 for r in c) == 2
    assert windows.chunks(df, largest=6, smallest=5).count() == 0


def test_crops(spark):
    for n in range(0, 20):
        got = [(r.start, r.end) for r in spark.range(1).select(windows.crops(F.lit(n)).alias("c")).first().c]
        want, i = [], 0
        while n:
            want.append((i, min(i + 6, n)))
            if i + 6 >= n:
                break
            i += 3
        assert got == want, n
    rows = [(a, b, n) for n in (1, 4, 9, 15) for a in range(n) for b in range(a, min(n, a + 8))]
    df = spark.createDataFrame(rows, "a int, b int, n int").select("*", windows.centered_crop(F.col("a"), F.col("b"), F.col("n")).alias("c"))
    for r in df.collect():
        assert 0 <= r.c.start <= r.a and r.b < r.c.end <= r.n and (r.c.end - r.c.start == min(6, r.n) or r.b - r.a >= 6 or r.c.end - r.c.start <= 7), r


def test_offsets_and_ranges(spark):
    s = ["ab", "cde", "f"]
    df = spark.createDataFrame([(s,)], "s array<string>").select(windows.offsets(F.col("s")).alias("o"))
    assert df.first().o == [0, 3, 7, 8]
    got = df.select(windows.char_to_sentences(F.col("o"), F.lit(2), F.lit(4)).alias("r")).first().r
    assert (got.first, got.last) == (0, 1)
    assert df.select(windows.char_to_sentences(F.col("o"), F.lit(50), F.lit(60)).alias("r")).first().r is None
    c = spark.createDataFrame([(s,)], "s array<string>").select(windows.crop_with_gold(F.col("s"), F.lit(0), F.lit(2), F.lit(1), F.lit(1)).alias("g"), windows.crop_with_gold(F.col("s"), F.lit(0), F.lit(2), F.lit(2), F.lit(2)).alias("h")).first()
    assert (c.g.text, c.g.char_start, c.g.char_end) == ("ab cde", 3, 6) and c.h is None


@pytest.mark.parametrize(("chunk", "fan_in"), [(4, 2), (65_536, 8)])
def test_tree_aggregate_equals_group_by(spark, chunk, fan_in):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.05 else 0 if rng.random() < 0.6 else rng.randrange(20), rng.choice([None, 1, 5, 9]), "x") for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, _key string").repartition(7)
    got = treeagg.tree_aggregate(df, "k", [treeagg.count_of("n"), treeagg.sum_of("s", F.col("v")), treeagg.max_of("m", F.col("v")), treeagg.min_of("l", F.col("v")), treeagg.count_of("big", F.coalesce(F.col("v") > 4, F.lit(False)))], chunk=chunk, fan_in=fan_in)
    want = df.groupBy("k").agg(F.count("*"), F.sum("v"), F.max("v"), F.min("v"), F.count_if(F.col("v") > 4))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.collect())
    assert treeagg.tree_aggregate(df.limit(0), "k", [treeagg.count_of("n")]).count() == 0
    heavy = treeagg.heavy_keys(got, "k", "n", 0.3).collect()
    assert [r.k for r in heavy] == [0]


def brute_bm25(query, texts, k1=1.5, b=0.75):
    import math

    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / max(1, len(toks))
    out = []
    for t in toks:
        s = 0.0
        for q in query.split():
            df = sum(q in x for x in toks)
            if t and df:
                f = t.count(q)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avg))
        out.append(round(s, 6))
    return out


def test_bm25_ranks_and_ties(spark):
    texts = ["a b c", "a b c", "d", "", "a a d e", "zz"]
    ch = spark.createDataFrame([(1, i, f"1:{i}-{i}", t) for i, t in enumerate(texts)], "source long, ord int, chunk_id string, text string")
    qs = {1: "a d", 2: "", 3: "nothing", 4: "a a b"}
    q = spark.createDataFrame([(i, 1, t, "1:3-3") for i, t in qs.items()] + [(5, 9, "a", "9:0-0"), (6, 1, None, "1:0-0")], "final_id long, source long, claim string, gold_chunk_id string")
    ranked = lexical.rank_in_document(q, ch, "final_id", "claim")
    for i, t in qs.items():
        own = [(r.ord, r.score) for r in ranked.where(f"final_id = {i}").orderBy("rk").collect()]
        s = brute_bm25(t, texts)
        want = sorted(range(len(texts)), key=lambda j: (-s[j], -j)) if t else []
        assert [o for o, _ in own] == want and [x for _, x in own] == pytest.approx([s[j] for j in want], abs=1e-6)
    ranks = {r.final_id: r.rank for r in lexical.gold_ranks(q, ch, "final_id", "claim").collect()}
    full = {r.final_id: r.rk for r in ranked.where("chunk_id = '1:3-3'").collect()}
    assert ranks == {1: full[1], 2: None, 3: full[3], 4: full[4], 5: None, 6: None}
    r = metrics.ranks_of(ranked, q, "final_id").where("final_id = 1").first()
    assert r["rank"] == r["rank_relaxed"] == full[1]
    m = metrics.retrieval_metrics(lexical.gold_ranks(q, ch, "final_id", "claim")).first()
    assert m.n == 6 and m.recall_at_1 <= m.recall_at_5 <= m.recall_at_10


def test_bm25_over_a_collection(spark):
    texts = ["a b", "b c c", "x y z", "a b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "b c"), (2, None), (3, "")], "item_id long, text string")
    got = [(r.doc_id, r.score) for r in lexical.rank_in_collection(q, d, "item_id", "text", "doc_id", "text").orderBy("rk").collect()]
    s = brute_bm25("b c", texts)
    want = [j for j in sorted(range(4), key=lambda j: (-s[j], -j)) if s[j] > 0]
    assert [x for x, _ in got] == want


def test_relaxed_rank_is_no_minimum(spark):
    r = spark.createDataFrame([(1, 1, "1:0-1", 1), (1, 1, "1:1-1", 2), (2, 1, "1:0-1", 1)], "final_id long, source long, chunk_id string, rk int")
    g = spark.createDataFrame([(1, 1, "1:1-1"), (2, 1, "1:1-1"), (3, 1, "1:9-9")], "final_id long, source long, gold_chunk_id string")
    assert {x.final_id: (x["rank"], x.rank_relaxed) for x in metrics.ranks_of(r, g, "final_id").collect()} == {1: (2, 2), 2: (None, 1), 3: (None, None)}


@pytest.mark.parametrize("n", [1, 4, 5, 7, 13])
def test_quintiles_are_slices(spark, n):
    df = spark.createDataFrame([(i, (i * 7 % n) // 2 / 10, 1 if i % 2 else None) for i in range(n)], "k long, v double, rank int")
    got = {r.quintile: r.n for r in metrics.quintiles(df, "v", "k", "rank").collect()}
    assert got == {q + 1: (q + 1) * n // 5 - q * n // 5 for q in range(5) if (q + 1) * n // 5 > q * n // 5}


def test_bins(spark):
    df = spark.createDataFrame([(x, 1) for x in (0.0, 0.1, 0.3, 0.29999, 0.6, 0.7, 1.0, 0.99)], "v double, rank int")
    assert {r.bin: r.n for r in metrics.overlap_bins(df, "v", "rank").collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 9: 2}


def test_evidence(spark):
    arts = spark.createDataFrame([(1, "The cat sat on the mat. A dog ran far away. Birds fly south. Fish swim deep. The end came soon. Rain fell all day. Winds blew hard. Night was cold.")], "source long, text string")
    ch = windows.chunks(arts)
    cl = spark.createDataFrame(
        [(1, 1, "A dog ran far away."), (2, 1, "A dog run far awoy."), (3, 1, "Nothing like it here"), (4, 1, None), (5, 1, "A dog ran far away. Birds fly south. Fish swim deep. The end came soon. Rain fell all day. Winds blew hard. Night was cold."), (6, 9, "The cat"), (1, 1, "A dog ran far away.")], "final_id long, source long, evidence string"
    )
    got = {r.final_id: (r.chunk_id, r.match_type) for r in match.gold_labels(cl, ch, arts).collect()}
    assert got[1] == ("1:1-1", "exact") and got[2] == ("1:1-1", "fuzzy") and got[4] == (None, "none") and got[6] == (None, "none") and got[5] == ("1:1-7", "exact") and got[3][1] == "none"
    short = {r.final_id: r.match_type for r in match.gold_labels(cl, ch).collect()}
    assert short[5] != "exact" and len(short) == 6
    art = {r.final_id: r.match_type for r in match.located_in_article(cl, arts).collect()}
    assert art[1] == art[5] == "exact" and art[4] == art[6] == "none"


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", '{"k": 1}'), (1, None, '{"k": null, "z": 2}'), (2, " ", "{}"), (None, "bb", "bad")], "k long, t string, j string")
    assert tuple(profile.totals(df, "k").first()) == (4, 2, 1, 2, 1)
    c = {r.field: tuple(r)[1:4] for r in profile.json_completeness(df, "j", ["k"]).collect()}
    assert c == {"k": (1, 1, 2)}
    assert {r.field: r.n for r in profile.unexpected_fields(df, "j", ["k"]).collect()} == {"z": 1}
    assert profile.records_per_key(df, "k").first().median_n == 1.5
    assert {r.value: r.pct for r in profile.histogram(df, "t").collect()}[None] == 25.0
    assert tuple(profile.text_lengths(df, ["t"]).first()) == ("t", 3, 1, 2, 1.33, 4)


def test_relations(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert {tuple(r) for r in relate.upserted(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "c")}
    assert {tuple(r) for r in relate.patched(old, new, "k", ["v"]).collect()} == {(1, "a"), (2, None)}
    assert {tuple(r) for r in relate.differences(old.select("k"), new.select("k")).collect()} == {("left", 1), ("right", 3)}
    corpus = spark.createDataFrame([(1, "1:0-0")], "source long, chunk_id string")
    found = spark.createDataFrame([(1, "1:0-3"), (1, "1:0-3"), (1, "1:0-0"), (7, "7:0-0")], "source long, chunk_id string")
    assert relate.appended_chunks(corpus, found).count() == 2 and relate.appended_chunks(corpus, found, dedupe=False).count() == 3


def test_splits(spark):
    rows = [(s,) for s in range(60) for _ in range(1 + s % 90)]
    df = spark.createDataFrame(rows, "source long")
    out = splitting.stratified(df, "source").collect()
    assert len(out) == 60
    for b in {r.bucket for r in out}:
        own = [r.split for r in out if r.bucket == b]
        if len(own) >= 10:
            assert own.count("val") >= 1 and own.count("test") >= 1 and own.count("train") == round(len(own) * 0.8)
    again = {r.source: r.split for r in splitting.stratified(df.repartition(5), "source").collect()}
    assert again == {r.source: r.split for r in out}
    assert {r.source for r in splitting.stratified(df, "source", replay=True).collect()} == set(range(60))
    assert splitting.sampled(df.distinct(), "source", 7).count() == 7


def test_dense_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8))
    v[3] = v[4]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [1.0])]
    e = spark.createDataFrame(rows, "id long, e array<double>").withColumn("u", dense.unit("e"))
    got = {}
    for r in dense.top_by_product(e.where("id % 10 = 0 and id < 200").select(F.col("id").alias("q"), "u"), e, "q", "id", "u", 5).orderBy("q", "rk").collect():
        got.setdefault(r.q, []).append(r.id)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 120, 10):
        s = np.round(u @ u[q], 6)
        assert got[q] == [j for j in sorted(range(120), key=lambda j: (-s[j], j)) if j != q][:5]


def test_rank_in_scope_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(dense, "SCOPE_BLOCK", 4)
    rng = np.random.default_rng(1)
    vec = lambda: [float(x) for x in rng.integers(-3, 4, 5)]
    q = [(i, i % 2, vec()) for i in range(11)] + [(50, None, vec()), (51, 1, None), (52, 9, vec())]
    it = [(i % 2, i, f"c{i}", vec()) for i in range(23)]
    got = {}
    df = spark.createDataFrame(it, "source long, ord int, chunk_id string, v array<double>")
    for r in dense.rank_in_scope(spark.createDataFrame(q, "id long, source long, v array<double>"), df, "id", "source", "chunk_id", "ord", "v", k=6).orderBy("rk").collect():
        got.setdefault(r.id, []).append((r.ord, r.score))
    want = {i: sorted(((o, float(np.dot(v, w))) for s, o, _, w in it if s == src), key=lambda x: (-x[1], -x[0]))[:6] for i, src, v in q if i < 50}
    assert got == want


def test_hashed_vectors(spark):
    rows = [(1, "one two two"), (2, ""), (3, None), (4, "two one two")]
    v = {r.id: r.v for r in spark.createDataFrame(rows, "id long, t string").select("id", dense.hashed("t").alias("v")).collect()}
    assert v[1] == v[4] and abs(sum(x * x for x in v[1]) - 1) < 1e-12 and not any(v[2]) and not any(v[3])


def test_fusion_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q long, d string, rk int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], "q long, d string, rk int")
    assert [(r.d, r.rk) for r in dense.fused([a, b], "q", "d").orderBy("rk").collect()] == [("x", 1), ("y", 2), ("z", 3)]
    r = dense.reranked(a.withColumn("t", F.col("d")), "q", "d", "t", lambda p, q: q.map({"x": 0.1, "y": 0.9})).orderBy("model_rk").collect()
    assert [x.d for x in r] == ["y", "x"]


def test_quality(spark):
    a = spark.createDataFrame([(0, "x", None), (1, "y", "1"), (2, "z", "2")], "o long, t string, u string")
    b = spark.createDataFrame([(0, "x", None), (1, "y", "9"), (3, "w", "3")], "o long, t string, u string")
    assert {tuple(r) for r in quality.compared(a, b, "o", ["t", "u"]).collect()} == {(1, "differs", "u"), (2, "only_left", None), (3, "only_right", None)}
    h = quality.content_hash(a, "o", ["t", "u"]).first()
    assert tuple(h) == tuple(quality.content_hash(a.repartition(3), "o", ["t", "u"]).first()) and h.hash != quality.content_hash(b, "o", ["t", "u"]).first().hash
    assert quality.content_hash(a.limit(0), "o", ["t"]).first().records == 0
    j1 = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, '{"a": 1}')], "o long, j string")
    j2 = spark.createDataFrame([(1, '{"b": 2, "a": 1}'), (2, '{"a": 2, "c": 0}')], "o long, j string")
    assert {tuple(map(str, r)) for r in quality.json_compared(j1, j2, "o", "j").collect()} == {("1", "True", "[]", "[]"), ("2", "False", "[]", "['c']")}


def test_resolution_and_patch(spark):
    t = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in FIXTURE.items()}
    got = resolve.resolution(t["missing"], t["live"], t["redirects"], t["snapshots"], t["titles"], t["log"])
    ver = spark.createDataFrame([(1, False, None, None, None), (8, False, None, None, None)], "source long, found boolean, title string, resolution_method string, resolved_pageid long")
    out = {r.source: (r.found, r.resolved_pageid) for r in resolve.applied(ver, got).collect()}
    assert out == {1: (True, 1), 8: (False, None)}


def test_long_windows_are_bounded_by_each_claim(spark):
    s = [f"Sentence number {w} tells of the {w} town." for w in ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")]
    articles = spark.createDataFrame([(1, " ".join(s))], "source long, text string")
    chunks = windows.chunks(articles)
    near = " ".join(s[2:5]) + " Sentence number sixth tells of a town elsewhere far away."
    one, long = (1, 1, near), (2, 1, " ".join(s[:8]).replace("town", "towns"))
    schema = "final_id long, source long, evidence string"
    label = lambda rows: next(tuple(r) for r in match.gold_labels(spark.createDataFrame(rows, schema), chunks, articles).collect() if r.final_id == 1)
    alone, beside = label([one]), label([one, long])
    assert alone == beside and alone[3] == "fuzzy"
    start, end = map(int, alone[2].split(":")[1].split("-"))
    assert end - start + 1 <= 4


def test_queries_with_few_hits_are_filled_up(spark):
    chunks = spark.createDataFrame([(1, i, f"1:{i}-{i}", f"word{i} common" if i < 3 else f"other{i}") for i in range(9)], "source long, ord int, chunk_id string, text string")
    q = spark.createDataFrame([(1, 1, "word1 common", "1:1-1"), (2, 1, "nothing here", "1:0-0"), (3, 1, "", "1:2-2"), (4, 7, "word1", "7:0-0")], "final_id long, source long, claim string, gold_chunk_id string")
    got = {}
    for r in lexical.rank_in_document(q, chunks, "final_id", "claim", k=5).orderBy("rk").collect():
        got.setdefault(r.final_id, []).append((r.rk, r.ord))
    assert got == {1: [(1, 1), (2, 2), (3, 0), (4, 8), (5, 7)], 2: [(1, 8), (2, 7), (3, 6), (4, 5), (5, 4)]}
    ranks = {r.final_id: r["rank"] for r in lexical.gold_ranks(q, chunks, "final_id", "claim").collect()}
    assert ranks == {1: 1, 2: 9, 3: None, 4: None}
    neg = lexical.hard_negatives(lexical.rank_in_document(q, chunks, "final_id", "claim", k=2), q, chunks, "final_id", n=3).collect()
    assert sorted((r.final_id, r.place) for r in neg) == [(i, p) for i in (1, 2, 3) for p in (1, 2, 3)]
    assert all(r.chunk_id != f"1:{ {1: 1, 2: 0, 3: 2}[r.final_id] }-{ {1: 1, 2: 0, 3: 2}[r.final_id] }" for r in neg)
