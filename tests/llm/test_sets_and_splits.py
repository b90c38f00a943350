import random
from itertools import combinations

import numpy as np
import pytest

from evidloom.llm import crosssplit, nearset, splits
from evidloom.llm.arrays import combinations_of_rarest, digest, sketches, with_word_sets
from evidloom.llm.textforms import words


def likeness(a, b):
    a, b = set(words(a)), set(words(b))
    return len(a & b) / len(a | b) if a | b else 0.0


def records(seed, n=260, vocabulary=600):
    rng = random.Random(seed)
    out = []
    for _i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(0, 7)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"w{rng.randrange(vocabulary)}"]
            if rng.random() < 0.3:
                rng.shuffle(w)
        else:
            w = [f"w{min(int(rng.expovariate(1 / 90)), vocabulary)}" for _ in range(rng.randrange(3, 40))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = records(seed)
    df = spark.createDataFrame([(i, t[: len(t) // 2], t[len(t) // 2 :], "x") for i, t in enumerate(texts)], "id long, claim string, reasoning string, a string")
    full = [t[: len(t) // 2] + "\n" + t[len(t) // 2 :] for t in texts]
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(full), 2) if likeness(a, b) >= 0.7 - 1e-12}
    got = [tuple(r) for r in nearset.near_duplicates(df, "id", ["claim", "reasoning"], 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "a b c", None), (2, None, "C  b a"), (1, "a b c", None), (3, None, None), (4, "", " . "), (5, long, ""), (6, long + " extra", ""), (None, "a b c", ""), (7, "a b c d", ""), (8, "x", ""), (8, "a b c", "")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "final_id long, claim string, reasoning string, ws string, ws_id int")
    got = {tuple(r) for r in nearset.near_duplicates(df, "final_id", ["claim", "reasoning"], 0.7).collect()}
    assert got == {(1, 2), (1, 7), (2, 7), (1, 8), (2, 8), (7, 8), (5, 6)}
    assert nearset.near_duplicates(df.limit(0), "final_id", ["claim", "reasoning"], 0.7).count() == 0


def test_large_copy_groups_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(nearset, "WHOLE", 5)
    rows = [(i, "one two three four five six seven", "") for i in range(50)] + [(100 + i, "one two three four five six eight", "") for i in range(3)]
    got = {tuple(r) for r in nearset.near_duplicates(spark.createDataFrame(rows, "id long, c string, r string"), "id", ["c", "r"], 0.7).collect()}
    assert {(0, i) for i in range(1, 50)} | {(0, 100), (0, 101), (0, 102), (100, 101), (100, 102), (101, 102)} == got


def test_bands_and_bounds():
    for n in range(1, 200):
        h = nearset.most_different(n, 0.7)
        assert n < 4 or 2 * nearset.segments_for(n, 0.7) > h
        for s in range(int(np.ceil(0.7 * n)), n + 1):
            shared = int(np.ceil(0.7 / 1.7 * (n + s) - 1e-9))
            assert n + s - 2 * shared <= h
    bands = nearset.size_bands({n: 5 for n in range(1, 120)}, 0.7)
    assert bands[0][0] == 0 and bands[-1][1] == 119 and all(a[1] == b[0] for a, b in zip(bands, bands[1:]))
    assert nearset.size_bands({}, 0.7) == []


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 60, 20).astype(np.uint64))
        b = np.unique(rng.integers(0, 60, 20).astype(np.uint64))
        x, y = (int(v) & (2**64 - 1) for v in sketches(np.r_[a, b], np.array([len(a), len(b)])))
        assert bin((x ^ y) >> 16).count("1") <= len(np.setxor1d(a, b))
        assert x & 0xFFFF == len(a)
    assert sketches(np.zeros(0, np.uint64), np.array([0]))[0] == 0


def test_different_sets_have_different_ids(spark):
    df = spark.createDataFrame([(i, f"w{i}x") for i in range(100_000)], "id long, t string")
    ids = with_word_sets(df, ["id"], {"ws": ["t"]})
    assert ids.select("ws_id").distinct().count() == 100_000
    assert len({digest(np.array([i], np.uint64)) for i in range(10_000)}) == 10_000
    near = [(i, f"w{k}x", "") for i, k in enumerate((8, 3703, 26, 11500, 33, 6403))]
    assert nearset.near_duplicates(spark.createDataFrame(near, "id long, c string, r string"), "id", ["c", "r"], 0.7).count() == 0


def test_sets_with_one_index_key_stay_apart(spark, monkeypatch):
    real = nearset.F.xxhash64
    monkeypatch.setattr(nearset.F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else nearset.F.pmod(real(*c), nearset.F.lit(7)))
    texts = records(4, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(texts), 2) if likeness(a, b) >= 0.7 - 1e-12}
    got = [tuple(r) for r in nearset.near_duplicates(df, "id", ["t"], 0.7).collect()]
    assert set(got) <= want and {p for p in want if set(texts[p[0]].split()) == set(texts[p[1]].split())} <= set(got)


def test_pairs_that_merely_meet_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(150)], 40)) for _ in range(900)]
    texts += [t.replace(t.split()[0], "new") for t in texts[:20]]
    seen, real = [], nearset.candidate_pairs
    monkeypatch.setattr(nearset, "candidate_pairs", lambda *x: seen.append(real(*x)) or seen[-1])
    got = nearset.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", ["t"], 0.7).count()
    n = sum(c.count() for c in seen)
    assert got == 20 and n <= 40, n


def test_slices_give_the_same_pairs_and_leave_no_tables(spark, monkeypatch):
    monkeypatch.setattr(nearset, "SLICE", 500, raising=False)
    texts = records(8, 200)
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(texts), 2) if likeness(a, b) >= 0.7 - 1e-12}
    spark.catalog.clearCache()
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    got = [tuple(r) for r in nearset.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", ["t"], 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert len(set(spark.sparkContext._jsc.getPersistentRDDs()) - before) <= 1  # the members of alike sets


def test_signatures_go_by_all_their_words():
    need, rare = 8, np.array([3, 3, 3, 6, 6, 8, 1], np.int64)
    rec, cover = np.repeat([0, 1, 2, 3], [3, 2, 1, 1]), np.zeros(4)
    at = lambda d: nearset._allocated(np.arange(7, dtype=np.uint64), rec, rare, np.ones(4, bool), 1, 100, cover, need, d)
    assert at(False)[0][1].tolist() == [0, 1, 2] and cover.tolist() == [1, 1, 1, 0]
    assert at(True)[0][1].tolist() == []


def test_classes_of_near_duplicates(spark):
    rows = [(1, "a b c d"), (2, "D c b A"), (3, "a b c d"), (4, "a b c d e"), (5, "z"), (6, None)]
    got = {r.id: (r["class"], r.copy_of, r.members, r.links) for r in nearset.near_duplicate_classes(spark.createDataFrame(rows, "id long, t string"), "id", ["t"]).collect()}
    assert got == {1: (1, 1, 3, 1), 2: (1, 2, 3, 1), 3: (1, 1, 3, 1), 4: (4, 4, 1, 1), 5: (5, 5, 1, 0)}


def test_texts_of_a_large_word_set_are_paired_in_full(spark, monkeypatch):
    monkeypatch.setattr(nearset, "WHOLE", 5)
    rows = [(i, "one two three four five six seven") for i in range(20)] + [(30, "seven one two three four five six"), (31, "seven two one three four five six"), (32, "one two three four five six eight")]
    got = {tuple(r) for r in nearset.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", ["t"], 0.7).collect()}
    assert got == {(0, i) for i in range(1, 20)} | {(0, 30), (0, 31), (30, 31), (0, 32), (30, 32), (31, 32)}


def test_cross_split_equals_brute_force(spark):
    rng = random.Random(5)
    texts = records(7, 220, 4000)
    ev = [rng.choice(texts) for _ in range(20)]
    recs, where = [], []
    for i, t in enumerate(texts):
        recs.append((i, t, ev[i % 20] if i % 3 else ev[(i // 3) % 20], 1, "zz"))
        where.append((i, rng.choice(["train", "train", "val", "test", None])))
    recs += [(500, None, ev[0], 1, ""), (501, "", "", 1, ""), (None, "a", "b", 1, "")] + recs[:5]
    where += [(500, "test"), (501, "train"), (None, "val"), (3, "train"), (3, "train")]
    df = spark.createDataFrame(recs, "final_id long, claim string, evidence string, source long, split string")
    lo = spark.createDataFrame([(*w, 1) for w in where], "final_id long, split string, source long")
    sp = {}
    for i, s in where:
        if i is not None and s:
            sp.setdefault(i, set()).add(s)
    want = set()
    for a, b in combinations([r for r in recs if r[0] is not None], 2):
        for x, y in ((a, b), (b, a)):
            if x[0] != y[0] and "train" in sp.get(x[0], ()) and sp.get(y[0], set()) & {"val", "test"} and likeness(x[1] or "", y[1] or "") >= 0.6 and likeness(x[2] or "", y[2] or "") >= 0.6:
                want.add((min(x[0], y[0]), max(x[0], y[0])))
    got = [tuple(r) for r in crosssplit.cross_split_pairs(df, lo, "final_id", "claim", "evidence").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    rep = {(r.split, r.source): (r.records, r.overlapping) for r in crosssplit.overlap_report(df, lo, "final_id", "claim", "evidence", "source").collect()}
    assert all(0 <= (r.share or 0) <= 1 and r.by_chunks <= r.overlapping for r in crosssplit.overlap_report(df, lo, "final_id", "claim", "evidence", "source").collect())
    assert {r.id for r in crosssplit.classes(df, lo, "final_id", "claim", "evidence").collect()} <= set(sp)
    assert sum(v[0] for v in rep.values()) == len({(i, s) for i, ss in sp.items() for s in ss if s != "train"})
    assert crosssplit.cross_split_pairs(df.limit(0), lo, "final_id", "claim", "evidence").count() == 0
    assert crosssplit.cross_split_pairs(df, lo.limit(0), "final_id", "claim", "evidence").count() == 0


def test_chunks_part_records_and_follow_the_content():
    rng = np.random.default_rng(8)
    body = rng.permutation(4000).astype(np.uint64)
    edited = np.r_[np.array([9001, 9002], np.uint64), body[:2000], np.array([9003], np.uint64), body[2000:]]
    v, rec = np.r_[body, edited], np.repeat([0, 1], [len(body), len(edited)])
    starts, d, lens = crosssplit.chunks(v, rec)
    assert lens.sum() == len(v) and (rec[starts][1:] >= rec[starts][:-1]).all() and 1.5 < lens.mean() < 3
    one, two = dict(zip(d[rec[starts] == 0], lens[rec[starts] == 0])), set(d[rec[starts] == 1])
    shared = sum(n for x, n in one.items() if x in two)
    assert 0.99 * len(body) < shared <= len(np.intersect1d(body, edited))


def test_rarest_words_bring_all_alike_records_together():
    rng = np.random.default_rng(4)
    sets = []
    for n in rng.integers(1, 70, 120):
        base = rng.choice(300, n, replace=False).astype(np.uint64)
        sets += [base, np.unique(np.r_[rng.permutation(base)[: max(1, int(0.8 * n))], rng.choice(300, max(1, n // 8)).astype(np.uint64)])]
    n = np.array([len(s) for s in sets])
    v, rec = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    count = np.bincount(v.astype(int), minlength=300)[v.astype(int)]
    d, who = combinations_of_rarest(v, rec, n, count, 0.6)
    of = [set() for _ in sets]
    for x, w in zip(d.tolist(), who.tolist()):
        of[w].add(x)
    alike = 0
    for i, j in combinations(range(len(sets)), 2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        if a != b and len(a & b) >= 0.6 * len(a | b):
            alike += 1
            assert of[i] & of[j]
    assert alike > 30


def test_copies_across_splits_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(crosssplit, "WHOLE", 4)
    recs = [(i, "one two three four five six seven", "some evidence stands here today") for i in range(40)] + [(90, "one two three four five six eight", "some evidence stands here today")]
    where = [(i, "train" if i < 25 else "val") for i in range(40)] + [(90, "test")]
    df = spark.createDataFrame(recs, "final_id long, claim string, evidence string")
    lo = spark.createDataFrame(where, "final_id long, split string")
    got = {tuple(r) for r in crosssplit.cross_split_pairs(df, lo, "final_id", "claim", "evidence").collect()}
    assert {(0, i) for i in range(25, 40)} | {(i, 25) for i in range(25)} | {(i, 90) for i in range(25)} == got


def test_hot_claims_meet_their_edited_versions(spark):
    rng = random.Random(9)
    hot, near = [f"h{i}" for i in range(14)], [f"k{i}" for i in range(14)]
    claims = [(" ".join(hot), "train")] * 250
    claims += [(" ".join([*near, f"own{i}"]), "train") for i in range(250)]
    claims += [(" ".join(f"x{rng.randrange(3000)}" for _ in range(14)), rng.choice(["train", "val"])) for _ in range(250)]
    for base in (hot, near):
        for k in range(6):  # likeness of 0.6 to 0.87 with the hot claim
            w = list(base)
            for i in rng.sample(range(14), 1 + k % 3):
                w[i] = f"new{k}{i}"
            claims.append((" ".join(w), rng.choice(["val", "test"])))
    df = spark.createDataFrame([(i, c, "some evidence stands here today") for i, (c, _) in enumerate(claims)], "final_id long, claim string, evidence string")
    lo = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(claims)], "final_id long, split string")
    want = {(i, j) for (i, (a, x)), (j, (b, y)) in combinations(enumerate(claims), 2) if (x == "train") != (y == "train") and likeness(a, b) >= 0.6}
    got = {tuple(r) for r in crosssplit.cross_split_pairs(df, lo, "final_id", "claim", "evidence").collect()}
    assert got == want and len(want) > 2000


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(7, 7), (None, 3), (3, None), (0, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in splits.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert splits.components(spark.createDataFrame([], "a long, b long")).count() == 0


RECS = [(1, 10, "supported"), (1, 11, "SUPPORTED "), (2, 12, None), (3, 13, "refuted"), (4, 14, ""), (None, 15, "nei"), (None, 16, "nei"), (5, None, "nei"), (5, 12, "nei"), (6, 20, "nei")]
PAGES = [(12, 99), (13, 99), (14, 0), (15, -3), (None, 10), (98, 11), (20, 98), (16, None)]


def test_linked_sources(spark):
    r = spark.createDataFrame(RECS, "final_id long, source long, judgement string")
    p = spark.createDataFrame(PAGES, "source long, resolved_pageid long")
    got = {tuple(x) for x in splits.linked_sources(r, "final_id", "source", p).collect()}
    assert got == {(10, 11), (10, 20), (11, 20), (12, 13)}
    assert splits.linked_sources(r.limit(0), "final_id", "source", p).count() == 0
    assert splits.linked_sources(r, "final_id", "source", p.limit(0)).count() == 1


def test_large_components_come_with_all_pairs(spark):
    r = spark.createDataFrame([(i, i, "nei") for i in range(3100)], "final_id long, source long, judgement string")
    p = spark.createDataFrame([(i, 9999) for i in range(3050)], "source long, resolved_pageid long")
    got = splits.linked_sources(r, "final_id", "source", p)
    assert got.count() == got.distinct().count() == 3050 * 3049 // 2
    assert got.where("source_a >= source_b or source_b >= 3050").count() == 0


def test_splits_hold_together_and_balance(spark):
    rng = random.Random(4)
    rows = []
    for s in range(400):
        for _ in range(400 if s == 0 else rng.randrange(1, 12)):
            rows.append((len(rows), s, rng.choice(["supported", "supported", "refuted", "nei"])))
    rows += [(rows[5][0], 399, "nei"), (9_999_999, None, "nei")]
    r = spark.createDataFrame(rows, "final_id long, source long, judgement string")
    out = splits.stratified_splits(r, "final_id", "source", "judgement", None).collect()
    assert len({x.source for x in out}) == len(out) == 401
    per = {}
    for x in out:
        assert per.setdefault(x.component, x.split) == x.split
    where = {x.source: x.split for x in out}
    n = {s: sum(where[b] == s for _, b, _ in rows) / len(rows) for s in ("train", "val", "test")}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["val"] - 0.1) < 0.02
    for lab in ("supported", "refuted", "nei"):
        own = [b for _, b, j in rows if j == lab]
        assert abs(sum(where[b] == "train" for b in own) / len(own) - 0.8) < 0.04
    again = {x.source: x.split for x in splits.stratified_splits(r.repartition(3), "final_id", "source", "judgement", None).collect()}
    assert again == where
    assert splits.stratified_splits(r.limit(0), "final_id", "source", "judgement", None).count() == 0
