import base64
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from evidloom.llm import encode, leakage, truncated
from evidloom.llm.textforms import words

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
BPE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC = encode.Encoder(P.path("byte_bpe_50k.tiktoken"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab  's'\n\tدж人😀12.,é", max_size=80), st.data())
def test_joins_repair_to_the_whole_encoding(t, data):
    k = data.draw(st.integers(0, len(t)))
    got = ENC.joined(ENC.packed(t[:k]), ENC.packed(t[k:]))
    assert np.frombuffer(got, np.uint16).tolist() == BPE.encode_ordinary(t)


def test_cuts_depend_on_the_content():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh عربي ") for _ in range(20_000))
    a, b = encode.cuts(body), encode.cuts("some other beginning " + body)
    assert a[-1] == len(body) and all(x < y for x, y in zip(a, a[1:]))
    own = {body[x:y] for x, y in zip([0, *a], a)}
    other = "some other beginning " + body
    assert len(own & {other[x:y] for x, y in zip([0, *b], b)}) > 0.8 * len(own)
    assert encode.cuts("") == [0] and encode.cuts("x" * 20_000)[-1] == 20_000


def test_encoded_equals_the_library(spark):
    rng = random.Random(2)
    same = "".join(rng.choice("abc def عربي 人口。 ") for _ in range(3000))
    texts = [None, "", " ", "Hello world", "<|endoftext|>", same, "x" + same, same, "人" * 5000, " " * 3000, "a" * 9000, "हिन्दी " * 400, "it's we'll\n\n\n  x" * 90]
    df = spark.createDataFrame([(i, t, -1, "d") for i, t in enumerate(texts)] + [(3, "Hello world", -1, "d")], "doc_id long, text string, seq int, digest string")
    got = {r.doc_id: list(r.ids) for r in encode.encoded(df, "doc_id", "text").collect()}
    assert got == {i: BPE.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_an_id_with_two_texts_has_both(spark):
    df = spark.createDataFrame([(1, "one text"), (1, "another " * 400), (1, "one text")], "doc_id long, text string")
    got = sorted(list(r.ids) for r in encode.encoded(df, "doc_id", "text").collect())
    assert got == sorted([BPE.encode_ordinary("one text"), BPE.encode_ordinary("another " * 400)])


def test_joins_of_unspaced_text_stay_near_linear():
    rng = random.Random(6)
    took = []
    for n in (20_000, 80_000):
        t = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
        parts = [ENC.packed(t[a:b]) for a, b in zip([0, *encode.cuts(t)], encode.cuts(t))]
        began = time.perf_counter()
        got = ENC.merged(parts)
        took.append(time.perf_counter() - began)
        assert np.frombuffer(got, np.uint16).tolist() == BPE.encode_ordinary(t)
    assert took[1] < 10 * took[0] + 0.2, took


def items_and_docs(spark):
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[:12])), (3, "too short here"), (4, None), (5, ""), (6, " ".join(w[20:40]))]
    docs = [
        (1, "x " + "; ".join(w[2:12]).upper() + " y"), (2, " ".join(w[3:12])), (3, "a\n".join(["", *w[20:30]]).replace("a\n", "\n\n") + " gap " + " ".join(w[30:40])), (4, None), (5, ""), (6, " ".join(w[20:40]) + " z " + " ".join(w[0:10]).replace("w1", "w​1")), (6, " ".join(w[20:40])), (None, " ".join(w)),
        (7, "pad " * 50_000 + " ".join(w[20:31])),
    ]
    return spark.createDataFrame([(a, b, "c") for a, b in items], "item_id long, text string, doc string"), spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item int")


@pytest.mark.parametrize("most", [300_000, 3])
def test_leaks(spark, monkeypatch, most):
    monkeypatch.setattr(leakage, "MOST_WINDOWS", most)
    items, docs = items_and_docs(spark)
    found = leakage.leaked(docs, "doc_id", "text", items, "item_id", "text")
    want = {(1, 1), (1, 2), (3, 6), (6, 6), (6, 1), (6, 2), (7, 6)}
    assert {(r.doc, r.item) for r in found.select("doc", "item").distinct().collect()} == want
    spans = {(1, 1, 1, 10), (1, 2, 1, 10), (3, 6, 0, 9), (3, 6, 11, 20), (6, 6, 0, 19), (6, 1, 21, 30), (6, 2, 21, 30), (7, 6, 50_000, 50_010)}
    assert {tuple(r) for r in found.collect()} == spans
    assert {(r.item_id, r.documents) for r in leakage.item_report(found, items, "item_id").collect()} == {(1, 2), (2, 2), (3, 0), (4, 0), (5, 0), (6, 3)}
    assert leakage.leaked(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.leaked(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leaked_words_can_be_removed(spark):
    items, docs = items_and_docs(spark)
    d = docs.where("doc_id in (1, 2, 7)")
    clean = {r.doc_id: r.clean_text for r in leakage.without_leaks(d, "doc_id", "text", leakage.leaked(d, "doc_id", "text", items, "item_id", "text")).collect()}
    assert clean[1] == "x y" and len(words(clean[2])) == 9 and set(clean[7].split()) == {"pad"}


ENDINGS = [
    ("Whole sentence.", "whole"), ("Whole!”", "whole"), ("نص كامل؟\n", "whole"), ("Noted. [22]", "whole"), ("x.\n[[تصنيف:كلمة]]", "whole"), ("x.\n== Heading ==", "whole"),
    ("x.\nتصنيف: كلمة", "open"), ("x.\n[[تصنيف:كل", "sign"), ("mid wor", "open"), ("mid word,", "open"), ("more [...]", "mark"), ("more…", "mark"), ("more ...", "mark"), ("more... ", "mark"), ("more.…", "mark"), ("bad �", "sign"), ("esc \\u06", "sign"), ("ent&am", "sign"), ("tag <br", "sign"), ("tag <ref name=" + "x" * 500, "sign"),
    ("3 < 4 is less", "open"), ("tag <br> of it", "open"), ("tpl {{cite", "sign"), ("see [http", "sign"), ("entity &" + "a" * 90, "sign"),
    ("ภาษาไทย", "thai"), ("ภาษาไทย [...]", "thai"), ("", "blank"), (None, "blank"), (" ​\n", "blank"), ("\u00a0", "blank"), ("\u2003\ufeff\u00a0", "blank"), ("Whole.\u00a0\u200b ", "whole"), ("( open", "open"),
]


@pytest.mark.parametrize(("text", "kind"), ENDINGS)
def test_endings(text, kind):
    assert truncated.ending(text) == kind


PROSE = "the old keeper of the harbour wrote a complete report about every ship that came in"


def corpus():
    """Articles of closed lines, with bare headings, and entries of two names."""
    d = [(i, f"Early years\n{PROSE} {i} of them.\nThe report was complete.\nVerdict: {'not enough information' if i % 2 else 'supported'}", "s1") for i in range(60)]
    return d + [(60 + i, f"{PROSE} {i} of them.\nTopic: sea{i} ships{i}", "s1") for i in range(60)]


def test_truncated(spark):
    base = [(1000 + i, t, "s1" if i % 2 else None) for i, (t, _) in enumerate(ENDINGS)]
    more = [
        (2000, f"{PROSE}.\nVerdict: supp", "s2"), (2001, f"{PROSE}.\nVerdict: not enough", "s2"), (2002, f"{PROSE}.\nTopic: comple", "s2"), (2003, f"{PROSE}.\nTopic: sea1", "s2"), (2004, f"{PROSE}.\nVerdict: supported", "s2"), (2005, f"{PROSE}.\nLater years", "s2"), (2006, f"{PROSE}.\nLater harb", "s2"),
        (2007, PROSE, "s2"), (2008, PROSE[:-1], "s2"), (2009, "y" * 200_000, "s2"), (2009, "y" * 200_000, "s2"), (None, "no id", "s2"),
    ]
    df = spark.createDataFrame([(*r, "k", 1, "c") for r in corpus() + base + more], "doc_id long, text string, source string, kind string, cut int, name string")
    rows = truncated.truncated(df, "doc_id", "text", "source").collect()
    cut = {r.doc for r in rows if r.cut}
    assert {x for x in cut if x >= 2000} == {2000, 2001, 2002, 2003, 2006, 2007, 2008, 2009}
    assert {1000 + i for i, (_, k) in enumerate(ENDINGS) if k in ("sign", "mark")} <= cut
    assert not cut & ({1000 + i for i, (_, k) in enumerate(ENDINGS) if k in ("whole", "thai", "blank")} | set(range(120)))
    within = {r.doc for r in rows if r.within_word}
    assert {2002, 2006} <= within and not within & {2001, 2003, 2004, 2005}
    rep = {r.source: (r.texts, r.cut) for r in truncated.truncation_report(truncated.truncated(df, "doc_id", "text", "source")).collect()}
    assert rep["s2"] == (11, 9)
    assert truncated.truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_where_lines_tell_nothing_the_trie_and_lengths_decide(spark):
    few = [(1, "complete words stand here", "s"), (2, "she read it:", "s"), (3, "it is comp", "s"), (4, "complete again.", "s")]
    got = {r.doc for r in truncated.truncated(spark.createDataFrame(few, "doc_id long, text string, source string"), "doc_id", "text", "source").where("cut").collect()}
    assert got == {3}
    limited = [(10 + i, f"{i} words up to the lim"[:20], "s") for i in range(4)]
    got = {r.doc for r in truncated.truncated(spark.createDataFrame(few + limited, "doc_id long, text string, source string"), "doc_id", "text", "source").where("cut").collect()}
    assert got == {3, 10, 11, 12, 13}


def test_trie(spark):
    t = {r.prefix: (r.n_below, r.below, r.own) for r in truncated.trie(spark.createDataFrame([("car", 2), ("cart", 3), ("dog", 5)], "token string, n long")).collect()}
    assert t["car"] == (1, 3, 2) and t["ca"] == (2, 5, 0) and t["cart"] == (0, 0, 3) and t["d"] == (1, 5, 0)
