import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidloom.functions import fuzzy
from evidloom.functions import text as T

SPACES = ["\x0b", "\x1c", "\x1f", "\x85", " ", " ", " ", " ", " ", "　", "\t", "\n", " "]


def py_segment(t):
    t, out, at = t or "", [], 0
    for m in re.finditer(r"[.!?؟]+(?=\s|$)", t):
        out.append(t[at : m.end()].strip())
        at = m.end()
    out.append(t[at:].strip())
    return [x for x in out if x]


def py_normalize(t):
    return re.sub(r"\s+", " ", re.sub("[ً-ْٰـ]", "", t or "")).strip()


TEXTS = [None, "", "   ", *(f"a{s}b" for s in SPACES), "مُحَمَّد ـــ نص؟ آخر", "3.5 is kept. Yes?! no", "What?!...", "no mark", "mark.Without space", " lead. trail. ", "؟", ". .", "x" * 50_000, "a.\x1cb", "a​b﻿c"]


def run(spark, *cols, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.select(*cols, "i").orderBy("i").collect()]


def test_normalize_and_segment_equal_the_rule(spark):
    assert run(spark, T.normalize("t")) == [py_normalize(t) for t in TEXTS]
    assert run(spark, T.segment("t")) == [py_segment(t) for t in TEXTS]
    assert run(spark, T.is_blank("t")) == [t is None or not t.strip() for t in TEXTS]
    assert run(spark, T.tokens("t")) == [[x for x in py_normalize(t).split(" ") if x] for t in TEXTS]


@pytest.mark.parametrize(("p", "g", "f1"), [("", "", 1.0), (None, None, 1.0), ("a", "", 0.0), ("a a b", "a b b", 2 / 3), ("x", "y", 0.0), ("a b", "a b", 1.0)])
def test_token_f1(spark, p, g, f1):
    df = spark.createDataFrame([(p, g)], "p string, g string")
    assert df.select(T.token_f1("p", "g")).first()[0] == pytest.approx(f1)


def test_exact_and_containment(spark):
    df = spark.createDataFrame([("a  b", "a b"), ("", ""), ("a b c d", "d c x"), (None, "a")], "p string, g string")
    assert [tuple(r) for r in df.select(T.exact_match("p", "g"), T.containment("p", "g")).collect()] == [(True, 1.0), (False, 0.0), (False, 0.5), (False, 0.0)]


def test_chunk_ids_and_iou(spark):
    ids = ["5:0-2", "a:b:3-4", "5", "5:0", "5:-1-2", "5:x-1", None]
    df = spark.createDataFrame([(x,) for x in ids], "c string")
    assert [tuple(r) for r in df.select(T.span_start("c"), T.span_end("c")).collect()] == [(0, 2), (3, 4), (None, None), (None, None), (None, None), (None, None), (None, None)]
    spans = [(0, 1, 1, 2, 1 / 3), (0, 1, 2, 3, 0.0), (0, 3, 1, 2, 0.5), (0, 0, 0, 0, 1.0), (None, 1, 0, 1, 0.0)]
    df = spark.createDataFrame([s[:4] for s in spans], "a int, b int, c int, d int")
    assert [r[0] for r in df.select(T.span_iou("a", "b", "c", "d")).collect()] == pytest.approx([s[4] for s in spans])


def test_titles_and_small_ones(spark):
    df = spark.createDataFrame([("<TITLE>\n A b - Site</title>",), ("<p>none</p>",), (None,)], "h string")
    assert [r[0] for r in df.select(T.html_title("h")).collect()] == ["A b", None, None]
    one = spark.createDataFrame([("a  b c d",)], "t string")
    r = one.select(T.clipped("t", 2), T.preview("t", 3), T.prefixed("t", "my-E5", "query"), T.prefixed("t", "bert", "query"), T.seeded("t", 1), T.notes(F.array(F.lit("x"), F.lit("y")))).first()
    assert r[0] == "a b" and r[1] == "a  " and r[2] == "query: a  b c d" and r[3] == "a  b c d" and len(r[4]) == 32 and r[5] == "x; y"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcد😀", max_size=40), st.text(alphabet="abcد😀", max_size=40))
def test_lcs_equals_the_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert fuzzy.lcs_length(a, b) == row[-1]


def test_best_window(spark):
    assert fuzzy.best_window_ratio("", "abc") == 0.0
    assert fuzzy.best_window_ratio("abcd", "ab") == pytest.approx(2 * 2 / 6)
    assert fuzzy.best_window_ratio("abcdefgh", "xxabcdefgh") == 1.0  # a stride of 2 meets it
    assert fuzzy.best_window_ratio("abcd", "xabcdy") == 1.0
    rng = random.Random(3)
    hay = "".join(rng.choice("abcdef") for _ in range(300))
    near = hay[:100] + "zz" + hay[102:200]
    assert fuzzy.best_window_ratio(near, hay) > fuzzy.ENOUGH
    df = spark.createDataFrame([("ab", "ab"), (None, "a"), ("", "a")], "a string, b string")
    assert [tuple(r) for r in df.select(fuzzy.best_fuzzy_ratio("a", "b"), fuzzy.indel_ratio("a", "b")).collect()] == [(1.0, 1.0), (0.0, None), (0.0, 0.0)]
