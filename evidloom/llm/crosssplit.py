"""Records that stand, exactly or almost, in two splits, found by content-defined chunks.

A record is normalised to its words in the order of the text, each once. A hash rolls over it, of the last WINDOW
words; where it says so, a chunk ends. So a cut depends on the words beside it alone, and an edit changes the chunks
it touches and leaves the rest as they were. The digests of the chunks are joined across splits and the lengths of
shared chunks summed. As chunks part a record without overlap, the sum is a lower bound of the words that two
records share: where it reaches what the likeness needs, the pair is decided; where it does not, the pair's words
are compared. Dense edits and reordering can leave no chunk as it was; such pairs meet by combinations of two of
their rarest words, which any two records of the likeness share (the argument is in ``combinations_of_rarest``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.arrays import MOST_SIZE, alike, combinations_of_rarest, flat_of, frequent_words, may_be_alike, mixed, overlap, sketches, with_word_sets
from evidloom.session import checkpointed

#: Words that the rolling hash sees; a chunk ends after one in CUT words on average.
WINDOW, CUT = 2, 2
#: Copies of a record are paired in full with up to so many copies of another in each split.
WHOLE = 1000
#: A chunk meets others if it has a word that no more than this share of the different texts have, or no more than LEAST.
FREQUENT, LEAST = 0.01, 200
#: Words in more than this share of the texts, and in more than COUNTED_LEAST, are ordered by how many have them, the rarer ones by hash.
COUNTED, COUNTED_LEAST = 0.0001, 5


def chunk_starts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the chunks of records begin: at their first words, and after each word at which the rolling hash says so.

    ``h`` are the hashes of the words of all records in order, ``first`` says which of them begin a record.
    """
    roll, number = h.copy(), np.cumsum(first)
    for k in range(1, WINDOW):
        inside = number[k:] == number[:-k]
        with np.errstate(over="ignore"):
            roll[k:] += np.where(inside, h[:-k], np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
    ends = (mixed(roll, 101) >> np.uint64(20)) % np.uint64(CUT) == 0
    return np.flatnonzero(np.r_[True, first[1:] | ends[:-1]])


def chunks(v: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, digest, length) of the content-defined chunks of records, given all their words and each word's record."""
    first = np.r_[True, rec[1:] != rec[:-1]]
    h = mixed(v, 100)
    starts = chunk_starts(h, first)
    lens = np.diff(np.r_[starts, len(v)])
    place = (np.arange(len(v)) - np.repeat(starts, lens)).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mixed(h + place * np.uint64(0xD6E8FEB86659FD93), 9), starts)
    return starts, mixed(total, 11), lens


def digests(texts: DataFrame, counted: tuple[np.ndarray, np.ndarray], line: float, likeness: float) -> DataFrame:
    """(digest, h, sk, length, tr, ho) of each text: its chunks, and with length 0 the combinations of its rarest words.

    ``line`` is the number of texts from which on a word is frequent.
    """
    known, often = counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, off = flat_of(b.column(1))
            n = np.diff(off)
            if not len(v):
                continue
            rec = np.repeat(np.arange(len(n)), n)
            count = np.zeros(len(v), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                count = np.where(known[at] == v, often[at], 0)
            sk = sketches(v, n)
            starts, d, lens = chunks(v, rec)
            use = (lens >= 2) & (np.minimum.reduceat(count, starts) <= line)
            d2, r2 = combinations_of_rarest(v, rec, n, count, likeness)
            d, r, ln = np.r_[d[use], d2], np.r_[rec[starts][use], r2], np.r_[lens[use], np.zeros(len(d2), np.int64)]
            for i in range(0, len(d), 100_000):
                s = slice(i, i + 100_000)
                take = pa.array(r[s])
                yield pa.RecordBatch.from_arrays([pa.array(d[s].view(np.int64)), b.column(0).take(take), pa.array(sk[r[s]]), pa.array(ln[s].astype(np.int32)), b.column(2).take(take), b.column(3).take(take)], ["digest", "h", "sk", "length", "tr", "ho"])

    return texts.select("h", "c", "tr", "ho").mapInArrow(run, "digest bigint, h bigint, sk bigint, length int, tr int, ho int")


def split_records(records: DataFrame, splits: DataFrame, key: str, first: str, second: str, split_col: str) -> DataFrame:
    """rec, split and both texts' words (c in the order of the text, e sorted), one row for each different (rec, split, texts)."""
    s = splits.where(F.col(key).isNotNull() & F.col(split_col).isNotNull()).select(F.col(key).alias("rec"), F.col(split_col).alias("split")).distinct()
    r = with_word_sets(records.where(F.col(key).isNotNull()).select(F.col(key).alias("rec"), F.col(first).alias("t1"), F.col(second).alias("t2")), ["rec"], {"c": ["t1"], "e": ["t2"]}, ordered=("c",))
    return r.drop("c_text", "e_text").where((F.size("c") > 0) & (F.size("e") > 0)).join(s, "rec").dropDuplicates(["rec", "split", "c_id", "e_id"]).persist()


def alike_texts(recs: DataFrame, likeness: float, train: str, held_out: tuple[str, ...]) -> DataFrame:
    """(ca, cb, share, proven): different first texts, one in train, one held out, that have the likeness.

    share is the part of the held-out text that shared chunks cover; proven says that their lengths decided.
    """
    held = F.col("split").isin(*held_out)
    tr, ho = F.max((F.col("split") == train).cast("int")).alias("tr"), F.max(held.cast("int")).alias("ho")
    texts = recs.groupBy(F.xxhash64("c_id").alias("h")).agg(F.collect_set(F.struct("c_id", "c")).alias("same"), tr, ho).persist()
    each = texts.select("h", F.inline("same"), "tr", "ho")
    rows, total = each.agg(F.count("*"), F.coalesce(F.sum(F.size("c")), F.lit(0))).first()
    counted = frequent_words(each, "c", rows, total, COUNTED, COUNTED_LEAST) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    index = digests(each.where("tr + ho > 0"), counted, max(FREQUENT * rows, LEAST), likeness)
    a = index.where("tr = 1").select("digest", F.col("h").alias("ha"), F.col("sk").alias("ska"))
    b = index.where("ho = 1").select("digest", F.col("h").alias("hb"), F.col("sk").alias("skb"), "length")
    met = a.join(b.hint("shuffle_hash"), "digest").where((F.col("ha") != F.col("hb")) & may_be_alike(F.col("ska"), F.col("skb"), likeness))
    size = lambda c: F.first(c).bitwiseAND(MOST_SIZE)
    summed = met.groupBy("ha", "hb").agg(F.sum("length").alias("covered"), size("ska").alias("na"), size("skb").alias("nb"))
    summed = summed.unionByName(texts.where("size(same) > 1 and tr = 1 and ho = 1").select(F.col("h").alias("ha"), F.col("h").alias("hb"), *(F.lit(0).alias(c) for c in ("covered", "na", "nb"))))
    # cut from its lineage, which two more joins with the texts would repeat
    summed = checkpointed(summed.select("ha", "hb", "covered", (alike(F.col("covered"), F.col("na"), F.col("nb"), likeness) & (F.greatest("na", "nb") < MOST_SIZE)).alias("proven")))
    x, y = texts.alias("x"), texts.alias("y")
    both = summed.join(x, F.col("ha") == F.col("x.h")).join(y, F.col("hb") == F.col("y.h"))
    both = both.select("covered", (F.col("proven") & (F.size("x.same") == 1) & (F.size("y.same") == 1)).alias("proven"), F.explode("x.same").alias("p"), F.col("y.same").alias("_q"))
    both = both.select("covered", "proven", "p", F.explode("_q").alias("q")).where("p.c_id <> q.c_id")
    shared = F.when(~F.col("proven"), overlap("p.c", "q.c"))
    near = both.where(F.col("proven") | alike(shared, F.size("p.c"), F.size("q.c"), likeness))
    return near.select(F.col("p.c_id").alias("ca"), F.col("q.c_id").alias("cb"), (F.col("covered") / F.size("q.c")).alias("share"), "proven")


def overlapping(recs: DataFrame, likeness: float, train: str = "train", held_out: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(rec_train, rec_held, split, share, proven, kind): pairs across splits alike in both texts, and the held-out record's class.

    Records with the same two texts are a class: classes are compared, and then expanded to their records. Of two
    alike classes of which one has more than WHOLE records in a split, every record is paired with the other
    class's first one.
    """
    held = F.col("split").isin(*held_out)
    is_train, who = F.col("split") == train, F.struct("rec", "split")
    kinds = recs.groupBy("c_id", "e_id").agg(F.first("e").alias("e"), *(f(F.when(w, who)).alias(n + s) for w, s in ((is_train, "a"), (held, "b")) for f, n in ((F.count, "n"), (F.min, "f"))))
    kinds = kinds.persist()
    left = kinds.where("na > 0").select(F.col("c_id").alias("ca"), F.col("e_id").alias("ea_id"), F.col("e").alias("ea"), "na")
    right = kinds.where("nb > 0").select(F.col("c_id").alias("cb"), F.col("e_id").alias("eb_id"), F.col("e").alias("eb"), "nb")
    same = kinds.groupBy("c_id").agg(F.max("na").alias("na"), F.max("nb").alias("nb")).where("na > 0 and nb > 0")
    pairs = alike_texts(recs, likeness, train, held_out).unionByName(same.select(F.col("c_id").alias("ca"), F.col("c_id").alias("cb"), F.lit(1.0).alias("share"), F.lit(True).alias("proven")))
    near = pairs.join(left, "ca").join(right, "cb").where(alike(overlap("ea", "eb"), F.size("ea"), F.size("eb"), likeness))
    return _expanded(checkpointed(near.drop("ea", "eb")), recs, is_train, held)


def _expanded(near: DataFrame, recs: DataFrame, is_train: Column, held: Column) -> DataFrame:
    """Pairs of classes as pairs of their records, linear in the records of a large class.

    Each record plays the part "all", the first of its class and split also the part "first"; of two small
    classes all meet all, else the first of each meets all of the other.
    """

    def side(where: Column, c: str, e: str, rec: str, more: list[str]) -> DataFrame:
        m = recs.where(where).select("c_id", "e_id", "rec", "split").distinct()
        first = m.groupBy("c_id", "e_id").agg(F.min(F.struct("rec", "split")).alias("f")).select("c_id", "e_id", F.lit("first").alias("part"), "f.rec", "f.split")
        m = m.select("c_id", "e_id", F.lit("all").alias("part"), "rec", "split").unionByName(first)
        return m.select(F.col("c_id").alias(c), F.col("e_id").alias(e), F.col("part").alias(f"part_{c}"), F.col("rec").alias(rec), *more)

    small = (F.col("na") <= WHOLE) & (F.col("nb") <= WHOLE)
    part = lambda x, y: F.struct(F.lit(x).alias("part_ca"), F.lit(y).alias("part_cb"))
    parts = F.when(small, F.array(part("all", "all"))).otherwise(F.array(part("first", "all"), part("all", "first")))
    p = near.select("ca", "ea_id", "cb", "eb_id", "share", "proven", F.inline(parts))
    got = p.join(side(is_train, "ca", "ea_id", "rec_train", []), ["ca", "ea_id", "part_ca"]).join(side(held, "cb", "eb_id", "rec_held", ["split"]), ["cb", "eb_id", "part_cb"])
    return got.where("rec_train <> rec_held").select("rec_train", "rec_held", "split", "share", "proven")


def cross_split_pairs(records: DataFrame, splits: DataFrame, key: str, first: str, second: str, split_col: str = "split", likeness: float = 0.6) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one id in train, the other held out, alike in both texts.

    Texts that are null or hold no word are like none. An id that several splits name counts in each; repeated
    rows count once; other columns play no part; empty tables give no rows.
    """
    got = overlapping(split_records(records, splits, key, first, second, split_col), likeness)
    return got.select(F.least("rec_train", "rec_held").alias("id_a"), F.greatest("rec_train", "rec_held").alias("id_b")).distinct()


def overlap_report(records: DataFrame, splits: DataFrame, key: str, first: str, second: str, source: str, split_col: str = "split", likeness: float = 0.6) -> DataFrame:
    """(split, source, records, overlapping, share, by_chunks) of each held-out split and source.

    How many ids it has and how many overlap train; the mean, over those, of the largest part of the first text
    that one train record's chunks cover (1 for the same text); and for how many of them chunk lengths decided.
    """
    recs = split_records(records, splits, key, first, second, split_col)
    hit = overlapping(recs, likeness).groupBy(F.col("rec_held").alias("rec"), "split").agg(F.max("share").alias("_share"), F.max("proven").alias("_proven"))
    s = splits.where(F.col(key).isNotNull() & F.col(split_col).isin("val", "test")).select(F.col(key).alias("rec"), F.col(split_col).alias("split"), F.col(source).alias("source")).distinct()
    out = s.join(hit, ["rec", "split"], "left").groupBy("split", "source")
    return out.agg(F.count("*").alias("records"), F.count("_share").alias("overlapping"), F.round(F.avg("_share"), 4).alias("share"), F.count_if("_proven").alias("by_chunks"))


def classes(records: DataFrame, splits: DataFrame, key: str, first: str, second: str, split_col: str = "split") -> DataFrame:
    """(id, split, class, members): each record with the smallest id that has the same two texts, and how many rows have them."""
    r = split_records(records, splits, key, first, second, split_col).select("rec", "split", "c_id", "e_id")
    n = r.groupBy("c_id", "e_id").agg(F.min("rec").alias("class"), F.count("*").alias("members"))
    return r.join(n, ["c_id", "e_id"]).select(F.col("rec").alias("id"), "split", "class", "members")
