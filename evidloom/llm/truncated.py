"""Texts that were cut off: by a final token that is only the beginning of words, by their length, by how lines end.

One pass over the texts gives each text's last line, the corpus vocabulary and how the lines inside texts end. The
vocabulary becomes a trie, kept as a table of its nodes; a final token that is no word, or one that is hardly ever
seen beside the words that it begins, was cut within a word. What the trie cannot decide, because the last word is
whole, other evidence does. Lengths, in characters and in bytes, at which open endings pile up are limits that
texts were cut at. Lines that are followed by others were not cut, so they tell which lines of a corpus end without
a closing sign: an unclosed last line of a kind that is closed elsewhere stops within a sentence, one of a kind that
isn't (headings, entries of lists) doesn't. Entries "name: value" have names whose lines end without a sign, and a
value that is but the beginning of what follows that name nearly always was cut.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.textforms import INVISIBLE, base_form, words

#: Words and lines that a partition counts before it hands on its counts.
HELD = 300_000
#: A token that is seen is still a fragment if the words that it begins are seen so many times as often.
FRAGMENT = 100
#: Lines of a kind that must be seen before it tells anything, and how much rarer a shortened value is than the whole one.
SEEN, SHORTENED = 20, 20
#: Words of the name and of the value of an entry.
NAME, VALUE = 3, 8

_CLOSED = regex.compile(r"[.!?؟۔।॥。！？｡．=][\"'»”’」』)）\]]*$")
_MARK = regex.compile(r"(?:…|\.{3}|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\))$")
_NOTE = regex.compile(r"[\p{P}\p{L}\p{N}\p{M}]\s*(?:\[\d+\])+$")
_ESCAPE = regex.compile(r"(?:�|\\(?:u[0-9a-fA-F]{0,3})?)$")
_ENTITY = regex.compile(r"#?[0-9A-Za-z]*")
_ENTRY = regex.compile(r"(\[\[)?\s*([^:：\[\]]+?)\s*[:：]\s*(.*?)\s*(\]\])?")
_ITEM = regex.compile(r"\s*(?:[-*•#–]|\p{Nd}+[.)])\s")
_LAST_LETTER = regex.compile(r"\p{L}", regex.REVERSE)
_THAI = regex.compile(r"\p{Thai}")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def unfinished(line: str) -> bool:
    """Whether the line stops within a tag, a template, a link, an entity, an escape or a character."""
    if _ESCAPE.search(line[-8:]):
        return True
    i = line.rfind("<")
    if i >= 0 and ">" not in line[i:] and (line[i + 1 : i + 2] in ("", "/", "!") or line[i + 1].isalpha()):
        return True
    if line.rfind("{{") > line.rfind("}}") or line.rfind("[[") > line.rfind("]]"):
        return True
    i = line.rfind("[")
    if i >= 0 and "]" not in line[i:] and not any(c.isspace() for c in line[i:]):
        return True
    i = line.rfind("&")
    return i >= 0 and _ENTITY.fullmatch(line, i + 1) is not None


def last_line(text: str | None) -> str:
    """The last line of a text, without white space of any kind and what can't be seen, in any order, at its end."""
    t, before = text or "", None
    while t != before:
        before = t
        t = t.rstrip().rstrip(INVISIBLE)
    return t.rsplit("\n", 1)[-1]


def ending(text: str | None) -> str:
    """How a text ends.

    blank, thai (never cut), mark (of having been cut: an ellipsis), sign (an unfinished entity, escape, tag, link or
    character), whole (a closing sign or note number, a heading's or an entry's), open.
    """
    line = last_line(text)
    if not line:
        return "blank"
    if (m := _LAST_LETTER.search(line)) and _THAI.match(m[0]):
        return "thai"
    if _MARK.search(line):
        return "mark"
    if unfinished(line):
        return "sign"
    if _CLOSED.search(line) or _NOTE.search(line) or (line.startswith("[[") and line.endswith("]]")):
        return "whole"
    return "open"


def line_kind(line: str) -> str:
    """What lines are compared by: an item of a list or not, spaced or not, and the length, each step longer by half."""
    m = _LAST_LETTER.search(line)
    step = int(math.log(max(1, len(line)), 1.5))
    return f"{'item' if _ITEM.match(line) else 'line'} {'unspaced' if m and _UNSPACED.match(m[0]) else 'spaced'} {step}"


def entry(line: str) -> tuple[str, str] | None:
    """(name, value) of a line that is an entry of a name and a value of a few words, or None."""
    m = _ENTRY.fullmatch(base_form(line)) if ":" in line or "：" in line else None
    if m is None or bool(m[1]) != bool(m[4]) or len(m[2].split()) > NAME or len(m[3].split()) > VALUE:
        return None
    return m[2], m[3]


_COLUMNS = {"doc": pa.int64(), "source": pa.string(), "chars": pa.int32(), "bytes": pa.int32(), "kind": pa.string(), "token": pa.string(), "line": pa.string(), "name": pa.string(), "value": pa.string(), "n": pa.int64()}


def endings(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """One row per text, and partial counts: of kind ``word`` (token), ``closed`` and ``bare`` (lines by line or by name and value).

    token is the final word, folded, of a text that doesn't end whole, and the word of a count. Lines with another
    one after them are counted by their kind; lines of entries, last ones too, by name and value.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(source).cast("string").alias("source"), F.col(text).alias("t"))

    def batch(cols: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in _COLUMNS.items()], list(_COLUMNS))

    def counts(vocabulary: Counter, lines: Counter) -> Iterator[pa.RecordBatch]:
        yield batch({"kind": ["word"] * len(vocabulary), "token": list(vocabulary), "n": list(vocabulary.values())}, len(vocabulary))
        kind, line, name, value = zip(*lines, strict=True) if lines else ((), (), (), ())
        yield batch({"kind": list(kind), "line": list(line), "name": list(name), "value": list(value), "n": list(lines.values())}, len(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, lines = Counter(), Counter()
        for b in batches:
            kinds, tokens, at, names, values = [], [], [], [], []
            for t in b.column(2).to_pylist():
                k = ending(t)
                ws = words(t)
                token = line = name = value = None
                if k in ("open", "sign", "mark") and ws:
                    token = ws.pop()  # it may be cut, so it tells nothing of the vocabulary
                vocabulary.update(ws)
                if k not in ("blank", "thai"):
                    own = last_line(t)
                    if e := entry(own):
                        lines["closed" if k == "whole" and own[-1] != "]" else "bare", None, *e] += 1
                        name, value = e if k == "open" else (None, None)
                    line = line_kind(own)
                    if "\n" in t:
                        for x in t[: t.rindex(own)].split("\n"):
                            if (x := x.strip()) and (kx := ending(x)) not in ("blank", "thai"):
                                closed = "closed" if kx == "whole" else "bare"
                                if e := entry(x):
                                    lines[closed if x[-1] != "]" else "bare", None, *e] += 1
                                else:
                                    lines[closed, line_kind(x), None, None] += 1
                kinds.append(k)
                tokens.append(token)
                at.append(line)
                names.append(name)
                values.append(value)
            texts = b.column(2).to_pylist()
            yield batch({"doc": b.column(0).to_pylist(), "source": b.column(1).to_pylist(), "chars": [None if t is None else len(t) for t in texts], "bytes": [None if t is None else len(t.encode()) for t in texts], "kind": kinds, "token": tokens, "line": at, "name": names, "value": values}, len(kinds))
            if len(vocabulary) + len(lines) > HELD:
                yield from counts(vocabulary, lines)
                vocabulary.clear()
                lines.clear()
        yield from counts(vocabulary, lines)

    return src.mapInArrow(run, "doc bigint, source string, chars int, bytes int, kind string, token string, line string, name string, value string, n bigint")


def trie(vocabulary: DataFrame) -> DataFrame:
    """(prefix, n_below, below, own): the nodes of the trie of a table of distinct words (token, n).

    n_below are the longer words of a node, below how often they are seen, own how often the node itself is.
    """
    nodes = vocabulary.select("token", "n", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("k"))
    own = F.col("k") == F.length("token")
    nodes = nodes.select(F.expr("substring(token, 1, k)").alias("prefix"), own.cast("bigint").alias("word"), "n")
    return nodes.groupBy("prefix").agg(F.sum(1 - F.col("word")).alias("n_below"), F.sum((1 - F.col("word")) * F.col("n")).alias("below"), F.sum(F.col("word") * F.col("n")).alias("own"))


def _piled(texts: DataFrame, length: str) -> DataFrame:
    """The lengths at which more texts end open than twice those that end whole, and at least three."""
    is_open = F.col("kind").isin("open", "sign", "mark").cast("int")
    n = texts.where("kind <> 'thai' and kind <> 'blank'").groupBy(length).agg(F.sum(is_open).alias("o"), F.count("*").alias("all"))
    return n.where("o >= 3 and o > 2 * (all - o)").select(length, F.lit(True).alias(f"at_limit_{length}"))


def running(lines: DataFrame) -> tuple[DataFrame, DataFrame, bool | None]:
    """Whether lines mostly end with a closing sign: (line, of_kind), (sort, of_sort) and for all; null where few are seen.

    There are some 80 kinds of lines and 4 sorts at any size.
    """
    n, closed = F.sum("n"), F.sum(F.when(F.col("kind") == "closed", F.col("n")).otherwise(0))
    mostly = F.when(n >= SEEN, 2 * closed > n)
    sorts = lines.withColumn("sort", F.substring_index("line", " ", 2))
    return lines.groupBy("line").agg(mostly.alias("of_kind")), sorts.groupBy("sort").agg(mostly.alias("of_sort")), lines.agg(mostly.alias("all")).first()["all"]


def entries(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, shortened) of the counted lines of entries.

    names: those whose lines mostly end without a closing sign. shortened (name, value): values that are so much
    rarer than those of the same name that go on after them, by their words or by their shape, that they were cut.
    """
    bare = F.sum(F.when(F.col("kind") == "bare", F.col("n")).otherwise(0))
    names = counted.groupBy("name").agg(F.sum("n").alias("all"), bare.alias("bare")).where((F.col("all") >= SEEN) & (2 * F.col("bare") > F.col("all"))).select("name")
    per = counted.groupBy("name", "value").agg(F.sum("n").alias("n"))
    per = per.join(names, "name", "left_semi")
    by_shape = lambda v: F.regexp_replace(F.regexp_replace(v, r"\p{L}[\p{L}\p{M}]*", "w"), r"\p{Nd}", "9")

    def beginnings(df: DataFrame, col: str) -> DataFrame:
        """name, col: values of which longer ones are SHORTENED times as frequent."""
        x = df.groupBy("name", col).agg(F.sum("n").alias("n"))
        below = x.select("name", "n", F.explode(F.sequence(F.lit(0), F.length(col) - 1)).alias("k"), col).where(F.length(col) > 0).select("name", F.expr(f"substring(`{col}`, 1, k)").alias(col), "n").groupBy("name", col).agg(F.sum("n").alias("below"))
        return x.join(below, ["name", col]).where(F.col("below") >= SHORTENED * F.col("n")).select("name", col)

    by_value = beginnings(per, "value")
    shaped = per.withColumn("shape", by_shape("value"))  # words as w, digits as 9
    rare = beginnings(shaped, "shape")
    return names, by_value.unionByName(shaped.join(rare, ["name", "shape"], "left_semi").select("name", "value")).distinct()


def truncated(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc, source, kind, cut and the evidence (within_word, at_limit) of every row with an id.

    cut: the text stops within a word, sentence, entry or sign, or bears a mark of having been cut. A text that
    closes is never cut, whatever its length; nor is a Thai text, a blank one or null. An open text is cut if its
    final token is a fragment; else an entry is if its value is a shortened one, a line of a kind that ends open
    elsewhere (or of which too few are seen) if the text has a length at which open endings pile up, and any other
    line is. A repeated row comes out as often as it is there. Other columns play no part; an empty table gives no rows.
    """
    e = endings(docs, doc_id, text, source).persist()
    texts = e.where("kind not in ('word', 'closed', 'bare') and doc is not null").drop("n")
    vocabulary = e.where("kind = 'word'").groupBy("token").agg(F.sum("n").alias("n"))
    asked = texts.where("token is not null").select(F.col("token").alias("prefix")).distinct()
    nodes = trie(vocabulary).join(asked, "prefix", "left_semi")
    lines = e.where("kind in ('closed', 'bare')")
    of_kind, of_sort, of_all = running(lines.where("line is not null"))
    names, short = entries(lines.where("name is not null").select("kind", "name", "value", "n"))
    x = texts.join(nodes, texts["token"] == nodes["prefix"], "left").drop("prefix")
    x = x.join(of_kind, "line", "left").withColumn("sort", F.substring_index("line", " ", 2)).join(of_sort, "sort", "left")
    x = x.join(names.withColumn("is_entry", F.lit(True)), "name", "left").join(short.withColumn("is_short", F.lit(True)), ["name", "value"], "left")
    x = x.join(_piled(texts, "chars"), "chars", "left").join(_piled(texts, "bytes"), "bytes", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    within = F.col("token").isNotNull() & (~F.col("token").rlike(r"\d$")) & yes((F.col("n_below") > 0) & (F.col("below") >= FRAGMENT * F.col("own")))
    limit = yes("at_limit_chars") | yes("at_limit_bytes")
    rest = F.when(yes("is_entry"), yes("is_short")).otherwise(yes(F.coalesce("of_kind", "of_sort", F.lit(of_all))) | limit)
    is_cut: Column = F.col("kind").isin("mark", "sign") | ((F.col("kind") == "open") & (within | rest))
    return x.select("doc", "source", "kind", is_cut.alias("cut"), within.alias("within_word"), limit.alias("at_limit"), "chars")


def truncation_report(found: DataFrame) -> DataFrame:
    """(source, texts, cut, share, within_word, at_limit): how often each source's texts are cut; a null source is one of them."""
    c = lambda x: F.sum((F.col("cut") & F.col(x)).cast("bigint"))
    return found.groupBy("source").agg(
        F.count("*").alias("texts"), F.sum(F.col("cut").cast("bigint")).alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"), c("within_word").alias("within_word"), c("at_limit").alias("at_limit")
    )
