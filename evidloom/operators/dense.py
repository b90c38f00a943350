"""Dense retrieval and rank fusion: blocked products in Arrow batches, reciprocal ranks, pluggable scorers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from evidloom.functions.text import tokens

#: Queries of a block: the only matrix that a task holds besides a batch of vectors.
BLOCK = 1024


def unit(v: Column | str) -> Column:
    """A vector of length 1, as doubles; a zero vector stays."""
    a = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a, lambda x: F.when(n == 0, x).otherwise(x / n))


def top_by_product(queries: DataFrame, vectors: DataFrame, query: str, vector_id: str, embedding: str, k: int = 10) -> DataFrame:
    """(query, id, score, rk): each query's k vectors of the largest inner product, rounded to 6 places, ties by id.

    The queries come in blocks; every block meets every batch of vectors as one matrix product, and only k
    candidates a query leave a batch. Null vectors and vectors of another length than a block's are left out; a
    query's own id is no result.
    """
    blocks = queries.where(F.col(embedding).isNotNull()).select(F.col(query).alias("q"), F.col(embedding).alias("e"), F.pmod(F.xxhash64(query), F.lit(2**31)).alias("h"))
    n = queries.count()
    blocks = blocks.withColumn("b", (F.col("h") % max(1, -(-n // BLOCK))).cast("int")).groupBy("b").agg(F.collect_list(F.struct("q", "e")).alias("qs"))
    out: list[DataFrame] = []
    for row in blocks.toLocalIterator():  # one block at a time on the driver; each is one pass over the vectors
        ids = np.array([x["q"] for x in row["qs"]], dtype=np.int64)
        mat = np.array([x["e"] for x in row["qs"]], dtype=np.float64)
        out.append(_pass(vectors, vector_id, embedding, ids, mat, k))
    if not out:
        return vectors.sparkSession.createDataFrame([], "q bigint, id bigint, score double, rk int").select(F.col("q").alias(query), "id", "score", "rk")
    got = out[0]
    for x in out[1:]:
        got = got.unionByName(x)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return got.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select(F.col("q").alias(query), "id", "score", "rk")


def _pass(vectors: DataFrame, vector_id: str, embedding: str, ids: np.ndarray, mat: np.ndarray, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, mat))  # BLOCK rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, m = shared.value
        for b in batches:
            e = b.column(1)
            off = np.asarray(e.offsets)
            ok = np.flatnonzero((np.diff(off) == m.shape[1]) & ~np.asarray(e.is_null()))
            if not len(ok):
                continue
            flat = np.asarray(e.values, dtype=np.float64)
            v = flat[off[ok][:, None] + np.arange(m.shape[1])]
            vid = np.asarray(b.column(0))[ok]
            s = np.round(v @ m.T, 6)
            s[vid[:, None] == q[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(vid[:, None], s.shape), -s), axis=0)[:k]
            got = np.take_along_axis(s, order, axis=0)
            keep = np.isfinite(got)
            qq = np.broadcast_to(q[None, :], got.shape)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(qq), pa.array(vid[order][keep]), pa.array(got[keep])], ["q", "id", "score"])

    return vectors.select(vector_id, embedding).mapInArrow(run, "q bigint, id bigint, score double")


#: Dimensions of hashed vectors, and vectors or queries of one block of a scope.
DIMENSIONS, SCOPE_BLOCK = 64, 256


def hashed(t: Column | str) -> Column:
    """A text as a unit vector without a trained encoder: each token adds 1 or -1 to one of DIMENSIONS by its MD5.

    A text without tokens has the zero vector.
    """
    return _hashed(tokens(t))


@F.pandas_udf(ArrayType(DoubleType()))
def _hashed(lists: pd.Series) -> pd.Series:
    known: dict[str, tuple[int, int]] = {}
    out = []
    for own in lists:
        v = np.zeros(DIMENSIONS)
        for t in own if own is not None else ():
            if t not in known:
                h = hashlib.md5(t.encode()).hexdigest()
                known[t] = int(h[:2], 16) % DIMENSIONS, 1 if h[2] < "8" else -1
            d, sign = known[t]
            v[d] += sign
        n = np.sqrt((v * v).sum())
        out.append(v / n if n else v)
    return pd.Series(out)


def rank_in_scope(queries: DataFrame, items: DataFrame, query: str, scope: str, item: str, tie: str, vector: str, k: int = 50) -> DataFrame:
    """(query, scope, item, tie, score, rk): each query's k items of its own scope by inner product, ties by the larger ``tie``.

    ``queries`` has query (bigint), scope and vector, ``items`` scope, item, tie (int) and vector. Queries and
    items of a scope come in blocks of about SCOPE_BLOCK, so a scope of any size is spread over many tasks; two
    blocks meet as one matrix product, of which only k items a query leave. Null vectors and scopes are left out.
    """

    def blocks(df: DataFrame, by: str, cols: list[str], name: str) -> DataFrame:
        d = df.where(F.col(vector).isNotNull() & F.col(scope).isNotNull())
        n = d.groupBy(scope).agg(F.ceil(F.count("*") / SCOPE_BLOCK).cast("int").alias("_n"))
        d = d.join(n, scope).withColumn("_b", F.pmod(F.xxhash64(by), F.col("_n")))
        return d.groupBy(scope, "_b").agg(*(F.collect_list(c).alias(f"{name}_{c}") for c in cols)).drop("_b")

    q = blocks(queries.select(F.col(query).alias("query"), scope, vector), "query", ["query", vector], "q")
    i = blocks(items.select(F.col(item).alias("item"), F.col(tie).alias("tie"), scope, vector), "item", ["item", "tie", vector], "i")
    kinds = dict(items.dtypes)
    met = q.join(i, scope).select(scope, "q_query", f"q_{vector}", "i_item", "i_tie", f"i_{vector}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                own, qs, qv, it, ti, iv = (b.column(c)[r].as_py() for c in range(6))
                s = np.round(np.array(qv) @ np.array(iv).T, 6) + 0.0
                tie_ = np.broadcast_to(np.array(ti), s.shape)
                best = np.lexsort((-tie_, -s), axis=1)[:, :k]
                who, at = np.repeat(np.arange(len(qs)), best.shape[1]), best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([qs[w] for w in who], pa.int64()), pa.array([own] * len(at), pa.int64()), pa.array([it[a] for a in at], pa.string()), pa.array([ti[a] for a in at], pa.int32()), pa.array(s[who, at])], ["query", "scope", "item", "tie", "score"])

    if kinds[item] != "string":
        raise ValueError("items are told by strings")
    got = met.mapInArrow(run, "query bigint, scope bigint, item string, tie int, score double")
    w = Window.partitionBy("query", "scope").orderBy(F.desc("score"), F.desc("tie"))
    got = got.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return got.select(F.col("query").alias(query), F.col("scope").alias(scope), F.col("item").alias(item), F.col("tie").alias(tie), "score", "rk")


def fused(lists: list[DataFrame], query: str, item: str, rank: str = "rk", k: int = 10, c: int = 60) -> DataFrame:
    """(query, item, score, rk): reciprocal rank fusion, the sum of 1 / (c + rank) over the lists.

    Of equal scores the item that the earlier list has comes first, then the better rank in it.
    """
    all_ = [x.select(query, item, F.col(rank).alias("_r"), F.lit(i).alias("_l")) for i, x in enumerate(lists)]
    u = all_[0]
    for x in all_[1:]:
        u = u.unionByName(x)
    s = u.groupBy(query, item).agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(c)) + F.col("_r"))), 9).alias("score"), F.min(F.struct("_l", "_r")).alias("_first"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), "_first")
    return s.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select(query, item, "score", "rk")


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def reranked(candidates: DataFrame, query: str, query_text: str, item_text: str, scorer: Scorer, rank: str = "rk") -> DataFrame:
    """``candidates`` with ``model_score`` and ``model_rk``: ordered by a scorer of text pairs, ties by the old rank.

    ``scorer`` takes two series of texts and gives one of doubles; it runs in Arrow batches on the executors.
    """
    score = F.pandas_udf(lambda a, b: scorer(a, b).astype("float64"), "double")  # type: ignore[call-overload]
    x = candidates.withColumn("model_score", F.round(score(query_text, item_text), 6))
    w = Window.partitionBy(query).orderBy(F.desc("model_score"), rank)
    return x.withColumn("model_rk", F.row_number().over(w))
