"""Near-duplicate records: all pairs of word sets of a given likeness, without pairwise comparison.

Two sets of the likeness differ in H words at most, by their sizes. The universe of words is partitioned by hash
into segments, as many as the band of set sizes needs. Each set is indexed under each of its segments and under
each segment less one word (the one-deletion neighbourhood), so sets whose segments differ by one word meet. A
signature is selective if, by the frequencies of all its words, no more than a share of the sets should have it; the
allocation leaves out all others. What is left covers a set if its segments that are selective less any one word count
2, those that are only so as a whole count 1, and the sum exceeds H: differences too few to spoil every segment must
leave one that both sets share (pigeonhole). A set that a partition doesn't cover is indexed in the next one too, and
after the last by its rarest words, two by two, so a pair meets in the first partition that covers one of the two. No
pair is lost; candidates are verified exactly. Signatures are joined a slice at a time, and what a slice shuffled goes
before the next; nearly all pairs that merely meet are told apart by two sketches there, before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.arrays import MOST_SIZE, alike, combinations_of_rarest, flat_of, frequent_words, may_be_alike, members, mixed, most_apart, overlap, parities, sketches, with_word_sets, within_groups
from evidloom.session import checkpointed, released

#: A signature is used if no more than this share of the sets (or than LEAST sets) should have it, were its words independent.
FREQUENT, LEAST = 0.005, 200
#: Words are counted if more than this share of the sets have them; of these there are COUNTED at most.
RARE, COUNTED = 1e-4, 300_000
#: Parts of a binary digit that a word's rarity is told in: whole numbers, so that sums don't depend on their order.
PARTS = 256
#: Partitions that a set may be indexed in.
PARTITIONS = 4
#: Slices that signatures are joined in at most, and words of all sets that make another one worth while.
SLICES, SLICE = 4, 1_500_000
#: Copies in groups up to this size are returned as all their pairs, larger groups by their representative.
WHOLE = 1000


def most_different(size: int, likeness: float) -> int:
    """How many words two sets of at most ``size`` words may differ in and still have the likeness."""
    return math.floor((1 - likeness) / (1 + likeness) * 2 * size + 1e-9)


def segments_for(size: int, likeness: float, covers: np.ndarray | None = None) -> int:
    """Segments with which most sets of about ``size`` words are covered; ``covers`` is what a segment of k words counts, 0 to 2.

    The number of words of a segment is about Poisson distributed; the cover wants a margin of an eighth.
    """
    need = (most_different(size, likeness) + 1) * 1.125
    best, cover = 1, 0.0
    for m in range(max(1, math.ceil(need / 2)), size + 1):
        lam = size / m
        if covers is None:  # one word makes a segment selective
            c = m * (2 - 2 * math.exp(-lam) - lam * math.exp(-lam))
        else:
            c = m * float(np.exp(np.arange(len(covers)) * math.log(lam) - lam - _LOG_FACTORIALS) @ covers)
        if c > cover:
            best, cover = m, c
        if c >= need:
            break
    return best


#: Words of a segment, at most, in estimates.
_MOST = 64
_LOG_FACTORIALS = np.cumsum(np.log(np.maximum(1, np.arange(_MOST + 1))))


def covers_of(rarity: np.ndarray, often: np.ndarray, other: int, total: int, need: int) -> np.ndarray:
    """What a segment of 0, 1, 2 ... words counts on average, if its words are drawn from the corpus's ``total``.

    ``often`` says how many sets have each counted word, ``other`` is the rarity of those not counted.
    """
    mass = np.r_[often, max(0, total - int(often.sum()))].astype(float)
    draw = np.random.default_rng(0).choice(np.r_[rarity, other], p=mass / mass.sum(), size=(2000, _MOST)).astype(np.int64)
    whole = draw.cumsum(axis=1)
    return np.r_[0.0, ((whole >= need).astype(int) + (whole - np.maximum.accumulate(draw, axis=1) >= need)).mean(axis=0)]


def rarities(often: np.ndarray, rows: int) -> np.ndarray:
    """How rare words are that so many of the sets have: binary digits, in PARTS; at least 1."""
    return np.maximum(1, np.floor(PARTS * np.log2(rows / np.maximum(1, often)))).astype(np.int64)


def size_bands(sizes: dict[int, int], likeness: float) -> list[tuple[int, int]]:
    """Bands (low, high] of set sizes that cost the fewest signatures, given how many sets have each size.

    A set is indexed in each band that its larger partners can fall into.
    """
    if not sizes:
        return []
    top, best = max(sizes), None
    for ratio in (1.5, 2.0, 3.0):
        for shift in range(8):
            highs = [top]
            step = ratio ** (1 / (1 + shift / 8))
            while highs[-1] > 4:
                highs.append(max(1, min(highs[-1] - 1, int(highs[-1] / step))))
            highs = sorted({*highs, top})
            bands = list(zip([0, *highs[:-1]], highs, strict=True))
            cost = sum(k * (n + segments_for(hi, likeness)) * (1.0 + 0.15 * max(0.0, hi / n - 1.5)) for n, k in sizes.items() for lo, hi in bands if hi >= n and lo < int(n / likeness + 1e-9))
            if best is None or cost < best[0]:
                best = (cost, bands)
    return best[1]


@dataclass
class Index:
    """What the allocation goes by: bands of sizes, the counted words (sorted) and how often and rare they are, the others' rarity."""

    bands: list[tuple[int, int]]
    known: np.ndarray
    often: np.ndarray
    rarity: np.ndarray
    other: int
    need: int
    covers: np.ndarray


def index_of(rows_of: DataFrame, col: str, sizes: dict[int, int], likeness: float) -> Index:
    """The index of the sets in ``col``, of which there are ``sizes`` by their number of words."""
    rows, total = sum(sizes.values()), sum(n * k for n, k in sizes.items())
    line = max(RARE * rows, total / COUNTED, 1.0)
    known, often = frequent_words(rows_of, col, rows, total, 0.0, line)
    rarity, other = rarities(often, rows), int(rarities(np.array([line]), rows)[0])
    need = max(1, math.ceil(PARTS * math.log2(rows / max(FREQUENT * rows, LEAST))))
    return Index(size_bands(sizes, likeness), known, often, rarity, other, need, covers_of(rarity, often, other, total, need))


def signatures(sets: DataFrame, id_col: str, col: str, index: Index, likeness: float, deletions: bool, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(sig, id, sk, par): a signature of each allocated segment of each set, or else of the segment less each of its words.

    sk and par are the set's sketch and the parities of its words in 64 other groups, by which nearly all pairs that
    merely meet are seen to be too far apart. ``part``, (i, of), leaves those signatures out that belong to another
    slice than i.
    """
    segments = [segments_for(hi, likeness, index.covers) for _, hi in index.bands]
    known, often, rarity = index.known, index.often, index.rarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            v, off = flat_of(b.column(1))
            n = np.diff(off)
            rec = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, v), max(0, len(known) - 1))
            is_known = known[at] == v if len(known) else np.zeros(len(v), bool)
            rare = np.where(is_known, rarity[at], index.other) if len(known) else np.full(len(v), index.other, np.int64)
            count = np.where(is_known, often[at], 0) if len(known) else np.zeros(len(v), np.int64)
            sk, par = sketches(v, n), parities(v, n, 64, 79).view(np.int64)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for k, (lo, hi) in enumerate(index.bands):
                active = (n <= hi) & (np.floor(n / likeness + 1e-9) > lo) & (n > 0)
                largest = np.minimum(hi, np.floor(n / likeness + 1e-9))
                differ = np.floor((1 - likeness) / (1 + likeness) * (n + largest) + 1e-9)
                for t in range(PARTITIONS):
                    if not active.any():
                        break
                    cover = np.zeros(len(n))
                    out += _allocated(v, rec, rare, active, segments[k], 100 * (k + 1) + t, cover, index.need, deletions)
                    active = active & (cover <= differ)
                if active.any() and not deletions:
                    own = active[rec]
                    d, who = combinations_of_rarest(v[own], np.cumsum(active)[rec[own]] - 1, n[active], count[own], likeness)
                    out.append((mixed(d, 100 * (k + 1) + 99), np.flatnonzero(active)[who]))
            for sig, who in out:
                if part[1] > 1:
                    own = (sig >> np.uint64(40)) % np.uint64(part[1]) == part[0]
                    sig, who = sig[own], who[own]
                for i in range(0, len(sig), 100_000):
                    s = slice(i, i + 100_000)
                    w = who[s]
                    yield pa.RecordBatch.from_arrays([pa.array(sig[s].view(np.int64)), pa.array(ids[w]), pa.array(sk[w]), pa.array(par[w])], ["sig", "id", "sk", "par"])

    return sets.select(id_col, col).mapInArrow(run, "sig bigint, id bigint, sk bigint, par bigint")


def _allocated(v: np.ndarray, rec: np.ndarray, rare: np.ndarray, active: np.ndarray, m: int, seed: int, cover: np.ndarray, need: int, deletions: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signatures of one partition that are rare enough for ``need``; ``cover`` gets what they cover of each active set."""
    keep = active[rec]
    w, r, ra = v[keep], rec[keep], rare[keep]
    seg = (mixed(w, seed) % np.uint64(m)).astype(np.int64)
    order = np.argsort(r * m + seg, kind="stable")
    w, r, ra, seg = w[order], r[order], ra[order], seg[order]
    key = r * m + seg
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    h = mixed(w, 7)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(w)]))
    rares = np.add.reduceat(ra, starts)
    some = rares >= need
    # a set of words is selective or not by itself, so both sets of a pair see it alike
    np.add.at(cover, r[starts], some.astype(int) + (rares - np.maximum.reduceat(ra, starts) >= need))
    salt = mixed(seg[starts].astype(np.uint64), 50_000 + seed)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(h, starts)
        if deletions:
            some = rares[group] - ra >= need
            return [(mixed(total[group] - h + salt[group], 3)[some], r[some])]
        return [(mixed(total + salt, 3)[some], r[starts][some])]


def candidate_pairs(whole: DataFrame, less: DataFrame, likeness: float) -> DataFrame:
    """Distinct (a, b), a < b, of ids that meet in a whole segment, or in a segment of one and the other's less a word.

    Pairs whose sketches show that they can't have the likeness are dropped where they meet, before anything is
    shuffled again: what remains follows the alike pairs, not the pairs that meet.
    """
    x, y = F.col("x.sk"), F.col("y.sk")
    size = lambda sk: sk.bitwiseAND(MOST_SIZE)
    near = F.bit_count(F.col("x.par").bitwiseXOR(F.col("y.par"))) <= most_apart(size(x), size(y), likeness)
    near = may_be_alike(x, y, likeness) & (near | (F.greatest(size(x), size(y)) == MOST_SIZE))

    def met(one: DataFrame, ids: Column) -> DataFrame:
        both = one.alias("y").join(whole.alias("x").hint("shuffle_hash"), F.col("x.sig") == F.col("y.sig"))
        return both.where(ids & near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    return met(whole, F.col("x.id") < F.col("y.id")).unionByName(met(less, F.col("x.id") != F.col("y.id"))).distinct()


def similar_sets(rows_of: DataFrame, id_col: str, col: str, likeness: float) -> DataFrame:
    """(a, b, shared, likeness) of all pairs of different sets, a < b by digest, of at least that likeness.

    ``rows_of`` has ``id_col``, the digest of the set, and ``col`` array<bigint> of distinct word hashes, in one or
    several rows. It is read several times; persist it: it is let go when the sets are stored. Empty sets pair with
    none, and an empty input gives an empty result. The index holds 64 bits of a digest, which only bring sets
    together: what is paired and verified are the sets that have those bits, each by itself, also if they are several.

    What is on disk at a time is the sets and the signatures of one slice, whose pairs are checkpointed.
    """
    spark = rows_of.sparkSession
    sized = rows_of.select(F.size(col).alias("n")).groupBy("n").count().where("n > 0")
    sizes = {r[0]: r[1] for r in sized.collect()}  # one row per set size
    if not sizes:
        return spark.createDataFrame([], f"a {dict(rows_of.dtypes)[id_col]}, b {dict(rows_of.dtypes)[id_col]}, shared int, likeness double")
    index = index_of(rows_of, col, sizes, likeness)
    sets = checkpointed(rows_of.groupBy(F.xxhash64(id_col).alias("h")).agg(F.collect_set(F.struct(F.col(id_col).alias("set"), F.col(col).alias("ws"))).alias("same")))
    rows_of.unpersist()
    released(spark)
    each = sets.select("h", F.inline("same"))
    cand = sets.where(F.size("same") > 1).select(F.col("h").alias("a"), F.col("h").alias("b"))
    slices = max(1, min(SLICES, sum(n * k for n, k in sizes.items()) // SLICE))
    for i in range(slices):
        cand = cand.unionByName(slice_pairs(each, index, likeness, (i, slices)))
        released(spark)
    return verified(cand.distinct(), sets, likeness)


def slice_pairs(each: DataFrame, index: Index, likeness: float, part: tuple[int, int]) -> DataFrame:
    """The pairs that meet in one slice of the signatures, cut from what they were found by."""
    whole, less = (signatures(each, "h", "ws", index, likeness, deletions=x, part=part) for x in (False, True))
    # partitioned by signature once, for the join with itself and that with the deletions
    whole = whole.repartition(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig").persist()
    pairs = checkpointed(candidate_pairs(whole, less, likeness))
    whole.unpersist()
    return pairs


def verified(cand: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b, shared, likeness) of those candidate pairs that have the likeness, by the sets' digests.

    Both sides read the sets by the same exchange, which is why nothing of it is renamed before the joins.
    """
    x, y = sets.alias("x"), sets.alias("y")
    both = cand.join(x, F.col("a") == F.col("x.h")).join(y, F.col("b") == F.col("y.h")).select("a", "b", F.explode("x.same").alias("p"), F.col("y.same").alias("_q"))
    both = both.select("a", "b", "p", F.explode("_q").alias("q")).where("(a <> b and p.set <> q.set) or p.set < q.set")
    got = both.select(F.least("p.set", "q.set").alias("a"), F.greatest("p.set", "q.set").alias("b"), overlap("p.ws", "q.ws").alias("shared"), F.size("p.ws").alias("na"), F.size("q.ws").alias("nb"))
    n = F.col("na") + F.col("nb") - F.col("shared")
    return got.where(alike(F.col("shared"), F.col("na"), F.col("nb"), likeness)).select("a", "b", "shared", (F.col("shared") / n).alias("likeness"))


def record_sets(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """rec, ws_id, ws_text and ws (the word set) of the rows that have an id and a word; kept for the reads that follow."""
    texts = {f"_t{i}": c for i, c in enumerate(text_cols)}
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rec"), *(F.col(c).alias(t) for t, c in texts.items()))
    r = with_word_sets(src, ["rec"], {"ws": list(texts)})
    return r.where(F.size("ws") > 0).persist()


def near_duplicates(df: DataFrame, id_col: str, text_cols: list[str], likeness: float = 0.7) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of different ids that have rows with texts of that likeness.

    The texts of a row are taken together; null counts as empty, and rows without any word pair with none.
    Repeated rows and several rows of one id count once. Ids whose words are the same are a group: all its
    pairs are returned up to WHOLE ids; beyond that each different text is paired with each other one by its
    smallest id, and copies of one text with that id (``near_duplicate_classes`` has the membership). Other
    columns play no part. An empty table gives no rows.
    """
    recs = record_sets(df, id_col, text_cols)
    ids = checkpointed(recs.select("ws_id", "ws_text", "rec"))
    found = checkpointed(similar_sets(recs, "ws_id", "ws", likeness).select("a", "b"))
    # most sets are of one row and like no other: only the rest need their members
    linked = ids.groupBy("ws_id").agg(F.count("*").alias("n")).where("n > 1").select("ws_id").unionByName(found.select(F.explode(F.array("a", "b")).alias("ws_id"))).distinct()
    m = members(ids.join(linked, "ws_id", "left_semi"), "ws_id", "ws_text", "rec", WHOLE).persist()
    link = m.where("linking")
    across = found.join(link.select(F.col("ws_id").alias("a"), F.col("rec").alias("ra")), "a").join(link.select(F.col("ws_id").alias("b"), F.col("rec").alias("rb")), "b")
    across = across.where("ra <> rb").select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"))
    return across.unionByName(within_groups(m, "ws_id", "rec")).distinct()


def near_duplicate_classes(df: DataFrame, id_col: str, text_cols: list[str], likeness: float = 0.7) -> DataFrame:
    """(id, class, copy_of, members, links): one row for each id and word set that it has.

    class is the smallest id with that word set, members how many ids have it, copy_of the smallest id with the
    very same text, links how many other word sets are alike. Rows without a word have none.
    """
    recs = record_sets(df, id_col, text_cols)
    ids = checkpointed(recs.select("ws_id", "ws_text", "rec"))
    found = similar_sets(recs, "ws_id", "ws", likeness)
    links = found.select(F.explode(F.array("a", "b")).alias("ws_id")).groupBy("ws_id").agg(F.count("*").alias("links"))
    m = members(ids, "ws_id", "ws_text", "rec", WHOLE)
    return m.join(links, "ws_id", "left").groupBy(F.col("rec").alias("id"), F.col("first").alias("class"), "members", F.coalesce("links", F.lit(0)).alias("links")).agg(F.min("copy_of").alias("copy_of"))
