"""Texts longer than a limit as pieces within it, cut at natural boundaries, with whole sentences as overlap.

Everything happens in SQL array functions over the sentences of a text. A fold over them consumes as many as fit
and keeps where the last one began: that lookback offset is where the next piece starts if the sentence after
it fits too. A sentence beyond the limit is consumed by a regular expression of bounded quantifiers whose
alternatives are ordered by the strength of the boundary: up to a white space or the end, else the limit itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.sentences import Model, spans

_SPACE = r"[\s\x1c-\x1f]"
_INK = r"[^\s\x1c-\x1f]"


def long_pattern(limit: int) -> str:
    """Group 1: white space before a piece; group 2: the piece."""
    inner = f"(?:.{{0,{limit - 2}}}{_INK})?" if limit > 1 else ""
    return f"(?sU)({_SPACE}*)({_INK}{inner}(?={_SPACE}|\\z)|{_INK}{{{limit}}})"


def packed(sents: Column, limit: int) -> Column:
    """Pieces (s, e, long) of an array of sentences (s, e) in order: whole sentences, and each over-long one by itself."""
    piece = "struct<s:bigint,e:bigint,long:boolean>"
    start = F.struct(
        F.array().cast(f"array<{piece}>").alias("done"), F.lit(False).alias("open"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("back"), F.lit(0).cast("bigint").alias("e")
    )

    def made(s: Column, e: Column, long: bool) -> Column:
        return F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(long).alias("long")))

    def step(acc: Column, x: Column) -> Column:
        a, b, lim = x["s"], x["e"], F.lit(limit)
        closed = F.when(acc["open"], F.concat(acc["done"], made(acc["s"], acc["e"], False))).otherwise(acc["done"])
        state = lambda done, is_open, s, back, e: F.struct(done.alias("done"), is_open.alias("open"), s.alias("s"), back.alias("back"), e.alias("e"))
        return (
            F.when(b - a > lim, state(F.concat(closed, made(a, b, True)), F.lit(False), a, a, b))
            .when(~acc["open"], state(acc["done"], F.lit(True), a, a, b))
            .when(b - acc["s"] <= lim, state(acc["done"], F.lit(True), acc["s"], a, b))
            .otherwise(state(closed, F.lit(True), F.when(b - acc["back"] <= lim, acc["back"]).otherwise(a), a, b))
        )

    return F.aggregate(sents, start, step, lambda acc: F.when(acc["open"], F.concat(acc["done"], made(acc["s"], acc["e"], False))).otherwise(acc["done"]))


def split_long(text: Column, at: Column, end: Column, limit: int) -> Column:
    """The pieces (s, e) of the over-long sentence that lies from ``at`` to ``end`` of the text."""
    part = F.substring(text, (at + 1).cast("int"), (end - at).cast("int"))
    pat = F.lit(long_pattern(limit))
    whole, ink = F.regexp_extract_all(part, pat, F.lit(0)), F.regexp_extract_all(part, pat, F.lit(2))
    both = F.zip_with(whole, ink, lambda w, i: F.struct(F.length(w).cast("bigint").alias("w"), F.length(i).cast("bigint").alias("i")))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    first = F.struct(at.cast("bigint").alias("at"), none.alias("got"))
    nxt = lambda acc, x: F.struct((acc["at"] + x["w"]).alias("at"), F.concat(acc["got"], F.array(F.struct((acc["at"] + x["w"] - x["i"]).alias("s"), (acc["at"] + x["w"]).alias("e")))).alias("got"))
    return F.aggregate(both, first, nxt, lambda acc: acc["got"])


def pieces(df: DataFrame, key: str, text: str, model: Model, limit: int = 480) -> DataFrame:
    """(key, start_pos, end_pos), distinct: the pieces of every text of more than ``limit`` characters.

    Shorter texts, null and blank ones have no rows. Repeated rows count once; other columns play no part; an
    empty table gives no rows. Positions count characters from 0, ends are exclusive.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    src = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t")).where((F.length("t") > limit) & F.col("key").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in batches:
            found = [[{"s": s, "e": e} for s, e in spans(t, model)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], ["key", "t", "sents"])

    s = src.dropDuplicates(["key", "t"]).mapInArrow(run, "key string, t string, sents array<struct<s:bigint,e:bigint>>")
    p = s.select("key", "t", F.explode(packed(F.col("sents"), limit)).alias("p"))
    cut = F.when(F.col("p.long"), split_long(F.col("t"), F.col("p.s"), F.col("p.e"), limit)).otherwise(F.array(F.struct(F.col("p.s").alias("s"), F.col("p.e").alias("e"))))
    return p.select("key", F.explode(cut).alias("x")).select("key", F.col("x.s").alias("start_pos"), F.col("x.e").alias("end_pos")).distinct()
