"""Texts in one form, so that texts that look the same are the same.

What cannot be seen and what is another print of the same sign is unified without a corpus (``base_form``).
Letters of another alphabet that look like those of a token's own are replaced script by script: only in tokens
whose scripts are mixed (or foreign to the text), and only if the corpus has the resulting word in a text of one
script. The vocabulary of such words and the accepted repairs are tables; nothing of them goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.arrays import members
from evidloom.llm.textforms import base_form, latin_words, replace_tokens, suspicious
from evidloom.session import checkpointed

_FORM = "field string, source bigint, key string, raw binary, form binary, base string, tokens array<struct<token:string,repaired:string,rank:int>>, words array<string>"


def _digest(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode())


def _listed(found: list[tuple[str, list[str]]]) -> list[dict]:
    return [{"token": t, "repaired": r, "rank": k} for t, rs in found for k, r in enumerate(rs)]


def base_forms(texts: DataFrame) -> DataFrame:
    """``texts`` (field, source, key, t) with digests of the text as it is and of its base form.

    base and tokens (with what each might be repaired to) are there only if the text has a suspicious token;
    words are the text's words of one alphabet. Null and blank texts are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("token", pa.string()), ("repaired", pa.string()), ("rank", pa.int32())]))
        for b in batches:
            keep, raw, form, base, toks, words = [], [], [], [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                f = base_form(t)
                if not f:
                    continue
                s = suspicious(f)
                keep.append(i)
                raw.append(_digest(t))
                form.append(_digest(f))
                base.append(f if s else None)
                toks.append(_listed(s) if s else None)
                words.append(latin_words(f))
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(3)), pa.array(raw, pa.binary()), pa.array(form, pa.binary()), pa.array(base, pa.string()), pa.array(toks, kind), pa.array(words, pa.list_(pa.string()))], ["field", "source", "key", "raw", "form", "base", "tokens", "words"])

    return texts.select("field", "source", "key", "t").where("t is not null").mapInArrow(run, _FORM)


def repaired_forms(texts: DataFrame) -> DataFrame:
    """(field, source, key, raw, form): digests of each non-blank text and of its one form, repairs included.

    The result is checkpointed: it is a few digests a text, and what reads it reads it several times.
    """
    x = base_forms(texts).persist()
    mixed = x.where("base is not null")
    toks = mixed.dropDuplicates(["form"]).select("form", F.inline("tokens"))
    asked = toks.select("repaired").distinct()
    vocabulary = x.select(F.explode("words").alias("repaired")).distinct()
    accepted = toks.join(asked.join(vocabulary, "repaired", "left_semi"), "repaired").groupBy("form", "token").agg(F.min_by("repaired", "rank").alias("repaired"))
    to = accepted.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("token", "repaired"))).alias("to"))
    per_form = to.join(mixed.dropDuplicates(["form"]).select("form", "base"), "form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [_digest(replace_tokens(t, dict(m))) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.binary())], ["form", "new"])

    fixed = per_form.select("form", "base", "to").mapInArrow(run, "form binary, new binary")
    plain = x.where("base is null").select("field", "source", "key", "raw", "form")
    turned = mixed.join(fixed, "form", "left").select("field", "source", "key", "raw", F.coalesce("new", "form").alias("form"))
    out = checkpointed(plain.unionByName(turned).distinct())
    x.unpersist()
    return out


def one_form(df: DataFrame, text: str, out: str = "one_form") -> DataFrame:
    """``df`` with its text in one form in the column ``out``; null stays null, blank becomes empty.

    Repairs are accepted by the vocabulary of the column itself. All other columns stay; rows stay as often as
    they are there.
    """
    t = df.select(F.col(text).alias("t")).where("t is not null").distinct()
    x = t.mapInArrow(_suspects, "t string, base string, tokens array<struct<token:string,repaired:string,rank:int>>, words array<string>").persist()
    toks = x.select("t", F.inline("tokens"))
    ok = toks.select("repaired").distinct().join(x.select(F.explode("words").alias("repaired")).distinct(), "repaired", "left_semi")
    own = toks.join(ok, "repaired").groupBy("t", "token").agg(F.min_by("repaired", "rank").alias("repaired"))
    to = own.groupBy("t").agg(F.map_from_entries(F.collect_set(F.struct("token", "repaired"))).alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [replace_tokens(f, dict(m or [])) for f, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], ["_t", "_form"])

    forms = x.join(to, "t", "left").select("t", "base", "to").mapInArrow(run, "_t string, _form string")
    return df.join(forms, df[text] == forms["_t"], "left").withColumn(out, F.col("_form")).drop("_t", "_form")


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("token", pa.string()), ("repaired", pa.string()), ("rank", pa.int32())]))
    for b in batches:
        forms = [base_form(t) for t in b.column(0).to_pylist()]
        toks = [_listed(suspicious(f)) for f in forms]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms), pa.array(toks, kind), pa.array([latin_words(f) for f in forms], pa.list_(pa.string()))], ["t", "base", "tokens", "words"])


#: Pairs of a form are returned in full up to so many keys; beyond it each key pairs with the first one of each other text.
WHOLE = 2000


def same_looking(forms: DataFrame) -> DataFrame:
    """(key_a, key_b): pairs of different keys (bigint) whose texts differ but have one form, the smaller key first.

    Keys with the very same text are no pair. A form with more than WHOLE keys gives each key's pairs with the
    first key of each other text, so exact copies alone are shortened and each two texts are paired.
    """
    f = forms.select("form", "raw", F.col("key").cast("bigint").alias("key")).distinct()
    # forms of one text only, most of them, leave before anything is joined
    n = f.groupBy("form").agg(F.min("raw").alias("r0"), F.max("raw").alias("r1"), F.count_distinct("key").alias("keys")).where("r0 <> r1 and keys > 1").select("form", "keys")
    x = checkpointed(f.join(n, "form"))
    small = x.where(F.col("keys") <= WHOLE).select("form", "raw", "key")
    a, b = small.select("form", F.col("raw").alias("ra"), F.col("key").alias("key_a")), small.select("form", F.col("raw").alias("rb"), F.col("key").alias("key_b"))
    pairs = a.join(b, "form").where("key_a < key_b and ra <> rb").select("key_a", "key_b")
    large = x.where(F.col("keys") > WHOLE)
    firsts = large.groupBy("form", "raw").agg(F.min("key").alias("to")).withColumnRenamed("raw", "other")
    star = large.join(firsts, "form").where((F.col("raw") != F.col("other")) & (F.col("key") != F.col("to")))
    star = star.select(F.least("key", "to").alias("key_a"), F.greatest("key", "to").alias("key_b"))
    return pairs.unionByName(star).distinct()


def found_again(forms: DataFrame, evidence: str, chunk: str) -> DataFrame:
    """(key_a, key_b): evidence key and chunk key of one source whose texts differ but have one form."""
    e = forms.where(F.col("field") == evidence).select("source", "form", F.col("raw").alias("ra"), F.col("key").alias("key_a")).distinct()
    c = forms.where(F.col("field") == chunk).select("source", "form", F.col("raw").alias("rb"), F.col("key").alias("key_b")).distinct()
    return e.join(c, ["source", "form"]).where("ra <> rb").select("key_a", "key_b").distinct()


def looks_classes(forms: DataFrame) -> DataFrame:
    """(key, class, members): each key with the first key of its form and how many keys have it: membership without pairs."""
    m = members(forms.select(F.hex("form").alias("form"), "raw", "key"), "form", "raw", "key", 1)
    return m.select("key", F.col("first").alias("class"), "members").distinct()
