"""Word sets as arrays of 64-bit hashes, and the Arrow plumbing that operators on them share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.textforms import words

#: A worker forgets its word hashes when it holds so many.
_REMEMBERED = 400_000


class Hasher:
    """64-bit hashes of words; the words of a corpus repeat, so a worker remembers them."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def sequence(self, text: str | None) -> list[int]:
        seen = self.seen
        ws = words(text)
        try:
            return [seen[w] for w in ws]
        except KeyError:
            if len(seen) > _REMEMBERED:
                seen.clear()
            for w in ws:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w.encode())
            return [seen[w] for w in ws]

    def distinct(self, text: str | None) -> np.ndarray:
        return np.array(sorted(set(self.sequence(text))), dtype=np.uint64)

    def first_seen(self, text: str | None) -> np.ndarray:
        return np.array(list(dict.fromkeys(self.sequence(text))), dtype=np.uint64)


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.uint64).view(np.int64)))


def flat_of(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values as uint64, offsets) of a list column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.asarray(col.offsets)
    return np.asarray(col.values).view(np.uint64)[off[0] : off[-1]], off - off[0]


#: Groups of words whose parity a sketch tells, and the largest size that its other bits can hold.
PARITIES, MOST_SIZE = 48, 0xFFFF


def parities(flat: np.ndarray, n: np.ndarray, groups: int, seed: int) -> np.ndarray:
    """For sets of n words each, one bit a group of words: whether the set has an odd number of them."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.uint64(1) << (mixed(flat, seed) % np.uint64(groups))
        out[full] = np.bitwise_xor.reduceat(bits, np.r_[0, np.cumsum(n[full])[:-1]])
    return out


def digest(words_of: np.ndarray) -> bytes:
    """The identity of a sequence of word hashes: 128 bits of all of it."""
    return xxhash.xxh3_128_digest(words_of.tobytes())


def sketches(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A bound for how much two sets differ, no identity: the parity of their words in groups, and their size."""
    return ((parities(flat, n, PARITIES, 78) << np.uint64(16)) | np.minimum(n, MOST_SIZE).astype(np.uint64)).view(np.int64)


def differ_at_least(a: Column, b: Column) -> Column:
    """A lower bound of the number of words that only one of two sets has, from their sketches.

    A group of words whose parity differs holds at least one such word.
    """
    return F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), 64 - PARITIES))


def most_apart(na: Column, nb: Column, least: float) -> Column:
    """How many words two sets of these sizes may differ in and still have the likeness."""
    both = (na + nb).cast("double")
    return both - 2 * F.ceil(F.lit(least / (1 + least)) * both - 1e-9)


def may_be_alike(a: Column, b: Column, least: float) -> Column:
    """False only for sets whose sketches show that their sizes or words are too far apart for the likeness."""
    na, nb = a.bitwiseAND(MOST_SIZE), b.bitwiseAND(MOST_SIZE)
    sizes = F.least(na, nb) >= F.lit(float(least)) * F.greatest(na, nb) - 1e-9
    return (sizes & (differ_at_least(a, b) <= most_apart(na, nb, least))) | (F.greatest(na, nb) == MOST_SIZE)


def with_word_sets(df: DataFrame, keys: list[str], texts: dict[str, list[str]], ordered: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` of every row and, for each name in ``texts``, the words of its columns taken together, each once.

    ``name`` is the array of word hashes, sorted, or for the names in ``ordered`` as the text first has them;
    ``name_id`` the 128-bit digest of that array and ``name_text`` that of the texts; null texts count as empty.
    """
    src = df.select(*keys, *{c for cs in texts.values() for c in cs})
    kinds = dict(src.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{n}` array<bigint>, `{n}_id` binary, `{n}_text` binary" for n in texts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for b in batches:
            cols = [b.column(k) for k in keys]
            for name, cs in texts.items():
                values = [b.column(c).to_pylist() for c in cs]
                rows = ["\n".join(x for x in row if x) for row in zip(*values, strict=True)]
                of = h.first_seen if name in ordered else h.distinct
                sets = [of(t) for t in rows]
                cols += [list_array(sets), pa.array([digest(s) for s in sets], pa.binary()), pa.array([xxhash.xxh3_128_digest(t.encode()) for t in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*keys, *(x for n in texts for x in (n, f"{n}_id", f"{n}_text"))])

    return src.mapInArrow(run, schema)


def word_counts(df: DataFrame, col: str) -> DataFrame:
    """(word hash, number of rows whose set has it), combined within each partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for b in batches:
            v, _ = flat_of(b.column(0))
            held.append(v)
            size += len(v)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return df.select(col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(sets: DataFrame, col: str, rows: int, words_total: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, n): the words in more than ``share`` of the ``rows`` sets (and in more than ``least``), sorted, and how many have each.

    The list is bounded: each set has ``words_total / rows`` words on average, so at most that number
    divided by ``share`` can be so frequent. The bound is checked before anything reaches the driver.
    """
    line = max(share * rows, least)
    bound = int(words_total / line) + 1
    got = word_counts(sets, col).where(F.col("n") > line).limit(bound + 1).toPandas()
    if len(got) > bound:
        raise RuntimeError("more frequent words than the bound allows")
    w, n = got["word"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(w)
    return w[order], n[order]


def overlap(a: str | Column, b: str | Column) -> Column:
    return F.size(F.array_intersect(a, b))


def alike(shared: Column, na: Column, nb: Column, least: float) -> Column:
    """Whether the likeness shared / (na + nb - shared) is ``least`` or more; two empty sets have none."""
    return (shared > 0) & (shared.cast("double") + 1e-9 >= F.lit(float(least)) * (na + nb - shared).cast("double"))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Records of up to so many words are indexed by combinations of two rare words, longer ones by single words.
LONG = 40


def combinations_of_rarest(v: np.ndarray, rec: np.ndarray, n: np.ndarray, count: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """(digest, record): the rarest words of each record, two by two, and one by one for long records.

    Two sets that share o words or more share two of those that come first in any common order of the words, if
    n - o + 2 of each are taken (one, if n - o + 1 are). Of a set of n words, alike ones share at least likeness * n.
    So every two alike sets of two words or more have a digest in common. All words of a record must be given.
    """
    order = np.lexsort((v, count, rec))
    w, r = v[order], rec[order]
    first = np.r_[0, np.cumsum(n)[:-1]]
    prefix = n - np.ceil(likeness * n - 1e-9).astype(np.int64)
    out, who = [], []
    two = np.minimum(n, prefix + 2)
    for k in np.unique(two[(n >= 2) & (n <= LONG)]):
        own = np.flatnonzero((two == k) & (n >= 2) & (n <= LONG))
        x = w[first[own][:, None] + np.arange(k)]
        i, j = np.triu_indices(int(k), 1)
        a, b = np.minimum(x[:, i], x[:, j]), np.maximum(x[:, i], x[:, j])
        with np.errstate(over="ignore"):
            out.append(mixed(mixed(a, 21) + b * np.uint64(0x9E3779B97F4A7C15), 22).ravel())
        who.append(np.repeat(own, len(i)))
    use = (np.arange(len(r)) - first[r] < prefix[r] + 1) & (n[r] >= likeness * LONG)
    return np.concatenate([*out, mixed(w[use], 23)]), np.concatenate([*who, r[use]]).astype(np.int64)


#: The members of a group are paired in blocks of about so many.
PAIRED = 1000


def all_pairs(df: DataFrame, group: str, key: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of members of one group.

    A large group is divided into blocks of about PAIRED members; each two of its blocks are joined by
    themselves, so no task holds more than two blocks' pairs for a key.
    """
    d = df.select(group, key).distinct()
    n = d.groupBy(group).agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("_n"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    m = d.join(n, group).withColumn("_k", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = m.select(group, F.col(key).alias("id_a"), F.col("_k").alias("_x"), every.alias("_y"))
    right = m.select(group, F.col(key).alias("id_b"), every.alias("_x"), F.col("_k").alias("_y"))
    return left.join(right, [group, "_x", "_y"]).where("id_a < id_b").select("id_a", "id_b")


def members(df: DataFrame, group: str, text: str, key: str, whole: int) -> DataFrame:
    """Distinct (group, text, key) with ``first``, the group's smallest key, ``copy_of``, that of the text, and ``linking``.

    In a group of more than ``whole`` keys a text's first key stands for its copies: it alone links to other
    texts, in the group and outside. In all others every key does.
    """
    d = df.select(group, text, key).distinct()
    t = d.groupBy(group, text).agg(F.count("*").alias("_n"), F.min(key).alias("copy_of"))
    n = t.groupBy(group).agg(F.sum("_n").alias("members"), F.min("copy_of").alias("first"))
    return d.join(t.drop("_n"), [group, text]).join(n, group).withColumn("linking", (F.col("members") <= whole) | (F.col(key) == F.col("copy_of")))


def within_groups(m: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs of members of one group: all of those that link, and each other member with the first key of its text."""
    star = m.where(~F.col("linking")).select(F.col("copy_of").alias("id_a"), F.col(key).alias("id_b"))
    return all_pairs(m.where((F.col("members") > 1) & F.col("linking")), group, key).unionByName(star)
