"""Held-out passages inside a corpus: windows of n consecutive words found by a hash set of the items' windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidloom.llm.textforms import words

#: Held-out windows that a hash set of every worker may hold; beyond it the windows are joined, with the same result.
MOST_WINDOWS = 300_000


def windows(ws: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]


def _digest(x: str) -> bytes:
    return xxhash.xxh3_128_digest(x.encode())


def _item_windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_id, out_w = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {" ".join(x) for x in windows(words(t), n)}:
                    out_id.append(i)
                    out_w.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_w, pa.string())], ["item", "gram"])

    src = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), F.col(text).alias("t"))
    return src.mapInArrow(run, "item bigint, gram string").distinct()


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, n: int = 10) -> DataFrame:
    """(doc, item, first_word, last_word): each span of a document that holds n consecutive words of an item.

    A span is the run of the document's words, counted from 0, that windows of the item cover without a gap.
    Words are compared folded, whatever stands between them. Documents or items of fewer than n words (null
    and empty ones too) give no rows; items with one text give a row each, repeated rows of a document one.
    """
    grams = _item_windows(items, item_id, item_text, n)
    held = grams.limit(MOST_WINDOWS + 1).collect()
    if len(held) > MOST_WINDOWS:
        return _joined(docs, doc_id, text, grams, n)
    of: dict[str, list[int]] = {}
    for r in held:
        of.setdefault(r.gram, []).append(r.item)
    known = {w for g in of for w in g.split(" ")}
    shared = docs.sparkSession.sparkContext.broadcast((of, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, vocabulary = shared.value
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                ws = words(t)
                if len(ws) < n:
                    continue
                run_len, spans = 0, {}
                for i, w in enumerate(ws):
                    if w not in vocabulary:
                        run_len = 0
                        continue
                    run_len += 1
                    if run_len >= n and (hit := grams_of.get(" ".join(ws[i - n + 1 : i + 1]))):
                        for item in hit:
                            own = spans.setdefault(item, [])
                            if own and own[-1][1] >= i - n:
                                own[-1][1] = i
                            else:
                                own.append([i - n + 1, i])
                rows += [(d, item, *x) for item, own in spans.items() for x in own]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "item", "first_word", "last_word"])

    src = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    return src.mapInArrow(run, "doc bigint, item bigint, first_word bigint, last_word bigint").distinct()


def _joined(docs: DataFrame, doc_id: str, text: str, grams: DataFrame, n: int) -> DataFrame:
    """The same with a join on the windows' digests, for item sets that no worker should hold.

    Windows that meet are runs: one that begins no later than a word after another's end goes on with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if g := [" ".join(x) for x in windows(words(t), n)]:
                    own = _digest(t)
                    for i in range(0, len(g), 50_000):
                        part = g[i : i + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([d] * len(part), pa.int64()), pa.array([own] * len(part), pa.binary()), pa.array(range(i, i + len(part)), pa.int64()), pa.array([_digest(x) for x in part], pa.binary())], ["doc", "t", "at", "gram"])

    src = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    key = F.udf(_digest, "binary")
    hits = src.mapInArrow(run, "doc bigint, t binary, at bigint, gram binary").join(grams.select("item", key("gram").alias("gram")), "gram")
    hits = hits.select("doc", "t", "item", "at").distinct()
    w = Window.partitionBy("doc", "t", "item").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) > n).cast("int"), F.lit(1))
    runs = hits.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    spans = runs.groupBy("doc", "t", "item", "_run").agg(F.min("at").alias("first_word"), (F.max("at") + n - 1).alias("last_word"))
    return spans.select("doc", "item", "first_word", "last_word").distinct()


def item_report(found: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """(item_id, documents): for every item in how many documents it leaked, 0 included."""
    k = found.groupBy("item").agg(F.countDistinct("doc").alias("documents"))
    i = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item")).distinct()
    return i.join(k, "item", "left").select(F.col("item").alias("item_id"), F.coalesce("documents", F.lit(0)).alias("documents"))


def without_leaks(docs: DataFrame, doc_id: str, text: str, found: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with ``clean_text``: the text without the words of leaked windows, null where nothing remains.

    Documents without a leak keep their text as it is; all other columns stay.
    """
    spans = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("first_word", "last_word")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, all_spans, strict=True):
            if spans_ is None or t is None:
                out.append(t)
                continue
            gone = {i for s in spans_ for i in range(s["first_word"], s["last_word"] + 1)}
            kept, k = [], 0
            for piece in t.split():
                m = len(words(piece))
                if not (m and any(k + j in gone for j in range(m))):
                    kept.append(piece)
                k += m
            out.append(" ".join(kept) or None)
        return pd.Series(out, dtype=object)

    return docs.join(spans, docs[doc_id] == F.col("_doc"), "left").withColumn("clean_text", cut(F.col(text), F.col("_spans"))).drop("_doc", "_spans")
