import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidloom.llm import lookalikes, pieces, sentences
from evidloom.llm.sentences import Model, boundaries, posteriors, spans
from evidloom.llm.textforms import base_form, fold, repairs, suspicious, words



def learnt(texts):
    """The model of the texts, counted as ``sentences.train`` does in a partition."""
    c, lengths, seen = Counter(), Counter(), {}
    for t in texts:
        sentences.observe(t, c, lengths)
    for (kind, w), n in c.items():
        for k, cell in enumerate(sentences.cells(w)):
            own = seen.setdefault(kind, Counter())
            own[str(cell + k * sentences.CELLS)] += n
    for (kind, w), n in lengths.items():
        seen.setdefault(kind, {})[w] = n
    return sentences.estimated(seen)


CORPUS = [
    "Yesterday Dr. Brown and Mr. Green went to St. Paul by the river. They saw many houses there. He slept.",
    "“Was it far to the town?” asked the old woman. Nobody knew anything of the road. Then he left the house.",
    "The U.N. met in the afternoon. The house stood there. There was an answer and the houses were old.",
    "قال د. خالد في ص. 12 إن المدينة قديمة. كانت المدينة كبيرة جدا. ثم ذهب الرجل إلى البيت. هذا كتاب إلخ. وفيه صور كثيرة.",
    "«أين الطريق إلى المدينة؟» سأل الرجل العجوز. هذا طريق طويل جدا؟ نعم كان طويلا. ثم رجع إلى البيت.",
    "वह डॉ. राम के साथ ई. 19 में आया। क्या यह घर था? वह गाँव गया। अंत में वह घर गया।",
    "یہ شہر ہے۔ وہ گاؤں تھا۔ یہ کتاب پرانی ہے؟ وہ آیا۔",
    "人口多。学生来了。他说：“森林很大！”学生去了。当地的森林很大。他说：“来了！”人口多。森林来了。他说：“很大？”当地来了。学生多。他说：“多。”森林去了。人口很大。当地多。",
    "先生は「どこへ行く？」と聞いた。学生は来た。南部は広い。",
    "ภาษาไทย ประโยคที่สอง จบแล้ว",
]
SHORT = {"Dr.", "Mr.", "St.", "U.N.", "د.", "ص.", "إلخ.", "डॉ.", "ई."}
WORDS_ONLY = [" ".join(w.strip('.؟?«»“”"।۔') for w in t.split() if w not in SHORT and w not in ("asked", "سأل")) + "?" for t in CORPUS[:7]]
M = learnt((CORPUS + WORDS_ONLY * 2) * 40)


def test_unseen_differences_fold_away():
    assert fold("Ｗｉｄｅ​ ﻻ a b c") == "wide لا a b c"
    assert fold("е́tude") == unicodedata.normalize("NFC", "étude")
    assert base_form("روایة مکتبة") == "رواية مكتبة"
    assert base_form("در ی") == "در ى"  # at the end of a word it is drawn without dots
    assert base_form("A b") != base_form("a b")
    assert base_form("شدّة") != base_form("شدة")
    assert base_form(None) == base_form(" ​\t") == ""
    assert words("foo_bar, Ünï 3.5") == ["foo", "bar", "ünï", "3", "5"]
    assert words("हिन्दी में") == ["हिन्दी", "में"]


def test_only_mixed_tokens_are_repaired():
    assert repairs("Lіаrgа") == ["Liarga"]
    assert repairs("сор", "cyrillic") == [] and repairs("сор", "latin") == ["cop"]
    assert repairs("cор", "cyrillic") == ["сор", "cop"]  # most of its letters are Cyrillic
    assert repairs("аrе", "latin") == ["are"] and repairs("plain") == []
    assert suspicious("слово и дело") == []
    assert dict(suspicious("the nаme of а rose")) == {"nаme": ["name"], "а": ["a"]}
    assert dict(suspicious("жить в лесу cор дядя")) == {"cор": ["сор", "cop"]}


def test_words_are_compared_in_the_script_of_their_text():
    assert words("сор из избы дядя") != words("cop") and words("cор из избы дядя")[0] == words("сор из избы дядя")[0]
    assert words("the сор said") == ["the", "cop", "said"] and words("قال Сор هنا") == words("قال Cop هنا")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aбяοХé́​  ﻻکی٣۳.１Ａ", max_size=30))
def test_forms_are_stable(t):
    assert base_form(base_form(t)) == base_form(t)
    assert fold(fold(t)) == fold(t)


CASES = [
    ("One. Two? Three!", ["One.", "Two?", "Three!"]),
    ("Dr. Smith paid 3.50 on 04.01.1980 to St. Mary. He left.", ["Dr. Smith paid 3.50 on 04.01.1980 to St. Mary.", "He left."]),
    ("The U.N. and i.e. that were ... after noon.", ["The U.N. and i.e. that were ... after noon."]),
    ("He waited... Then left", ["He waited...", "Then left"]),
    ("“Come here!” asked the man of it. Next.", ["“Come here!” asked the man of it.", "Next."]),
    ('He wrote, "All is well." Then he slept.', ['He wrote, "All is well."', "Then he slept."]),
    ("كتب د. أحمد (انظر ص. 56) ثم قرأ. هذا نص إلخ. ضمن شيء؟ نعم", ["كتب د. أحمد (انظر ص. 56) ثم قرأ.", "هذا نص إلخ. ضمن شيء؟", "نعم"]),
    ("طول الطريق. «هل وصلت؟» سأل الرجل. ثم ذهب.", ["طول الطريق.", "«هل وصلت؟» سأل الرجل.", "ثم ذهب."]),
    ("نهاية الجملة.\n10. بداية البند هنا.", ["نهاية الجملة.", "10. بداية البند هنا."]),
    ("كلمات كثيرة هنا.بداية أخرى هنا.", ["كلمات كثيرة هنا.", "بداية أخرى هنا."]),
    ("नमक था? डॉ. कवि ई. 24 में। अंत", ["नमक था?", "डॉ. कवि ई. 24 में।", "अंत"]),
    ("یہ شہر ہے۔ وہ گاؤں تھا۔", ["یہ شہر ہے۔", "وہ گاؤں تھا۔"]),
    ("人口16.3森林。他说：“当地的人口！”学生来。", ["人口16.3森林。", "他说：“当地的人口！”", "学生来。"]),
    ("学生は「古い村？」と聞いた。南部。", ["学生は「古い村？」と聞いた。", "南部。"]),
    ("ภาษาไทย ประโยคที่สอง จบ", ["ภาษาไทย", "ประโยคที่สอง", "จบ"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in spans(text, M)] == want


@pytest.mark.parametrize("text", [None, "", "  \n\t", " "])
def test_blank_texts_have_none(text):
    assert boundaries(text, M) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ 1.?!…\"'»«()\n\tد؟ไ 。「」​", max_size=60))
def test_spans_cover_the_text(t):
    got = spans(t, M)
    seen = "".join(t[a:b] for a, b in got)
    assert all(a < b and not t[a].isspace() for a, b in got)
    assert [c for c in seen if not c.isspace()] == [c for c in t[: got[-1][1] if got else 0] if not c.isspace()]
    if t.strip() and not t.strip("​ \n\t") == "":
        assert got


def test_forward_backward_equals_enumeration():
    from itertools import product
    from math import exp

    u, t = [1.0, -0.5, 2.0, 0.3], [0.0, -3.0, 1.5, -2.0]
    # the chain normalises each place given the one before it, then weighs by what follows: compare with the sum over all paths
    total, hit = 0.0, [0.0] * 4
    for path in product((0, 1), repeat=4):
        w, before = 1.0, 1
        for i, x in enumerate(path):
            if x:
                w *= exp(u[i] + (t[i] if before else 0.0))
            before = x
        total += w
        for i, x in enumerate(path):
            hit[i] += w * x
    assert posteriors(u, t) == pytest.approx([h / total for h in hit], abs=1e-9)


LANGUAGES = {
    "en": ["the river runs through old towns", "nobody knew where his brother lived", "every summer they walked to market", "she wrote long letters about birds", "children played beside broken walls", "our captain sold seven white horses"],
    "ar": ["كتب الرجل رسالة طويلة إلى أخيه", "ذهبت القوافل نحو الجبال البعيدة", "يعيش الناس قرب النهر الكبير", "وصف الرحالة أسواق المدينة القديمة", "زرع الفلاح القطن في أرضه", "تعلم الأطفال القراءة عند المعلم"],
    "zh": ["学生去了北方的大学读书", "老师写过三本关于河流历史", "昨天我们参观这座古城", "商人从南边带来很多盐", "村里没有人见过海洋", "工程师设计新桥梁图纸"],
    "ja": ["学生は北の大学へ行った", "先生が川についての本を書いた", "昨日みんなで古い城を見た", "商人たちは南から塩を運んだ", "村には海を知る人がいない", "技師の橋は来年できあがる"],
    "th": ["นักเรียนไปมหาวิทยาลัยทางเหนือ", "ครูเขียนหนังสือเกี่ยวกับแม่น้ำ", "เมื่อวานพวกเราเยี่ยมชมปราสาท", "พ่อค้านำเกลือมาจากทางใต้", "ไม่มีใครในหมู่บ้านเคยเห็นทะเล", "วิศวกรออกแบบสะพานใหม่"],
}
MARKS = {"en": (". ", " "), "ar": (". ", " "), "zh": ("。", ""), "ja": ("。", ""), "th": (" ", "")}


@pytest.mark.parametrize("lang", LANGUAGES)
def test_texts_without_marks_are_cut(lang):
    rng = random.Random(lang)
    own, (mark, gap) = LANGUAGES[lang], MARKS[lang]
    m = learnt([mark.join(rng.sample(own, 6)) + mark.strip() for _ in range(300)])
    want = [rng.choice(own) for _ in range(30)]
    text = gap.join(want)
    got = [text[a:b] for a, b in spans(text, m)]
    right = len(set(spans(text, m)) & {(len(gap.join(want[:i]) + (gap if i else "")), len(gap.join(want[: i + 1]))) for i in range(30)})
    assert right >= 27 and len(got) <= 33, got
    marked = (gap or ("" if lang != "th" else " ")).join(w + ("" if lang == "th" else "?") for w in want)
    assert len(boundaries(marked, m)) == 30  # with marks, nothing but those


@pytest.mark.parametrize("lang", LANGUAGES)
def test_short_stretches_without_marks_are_cut(lang):
    rng = random.Random(lang)
    own, (mark, gap) = LANGUAGES[lang], MARKS[lang]
    other = " ".join if gap and lang != "th" else "".join
    long = [other(f"w{rng.randrange(90)}" if gap and lang != "th" else chr((0x0E01 if lang == "th" else 0x5400) + rng.randrange(40)) for _ in range(300)) + mark.strip() for _ in range(8)]
    m = learnt([mark.join(rng.sample(own, 6)) + mark.strip() for _ in range(300)] + long)  # some sentences are very long
    text, ends = gap.join(own[:4]), [len(gap.join(own[: i + 1])) for i in range(4)]
    assert boundaries(text, m) == ends
    marked = own[4] + (mark if lang != "th" else " ")
    assert boundaries(marked + text, m)[-4:] == [len(marked) + e for e in ends]  # beside a sentence that kept its mark


def test_gaps_are_bounded_by_their_words():
    m = learnt(["the river runs. Nobody knew where he lived. See no. 4 of it.\n11. They walked to market."] * 30)
    ws = ["the", "river", "runs", "Nobody", "knew", "no", "4", "11", "They", "unseen"]
    for x in ws:
        for y in ws:
            assert m.gap(x, y) <= m.bounds(x)[0] + m.bounds(y)[1] + 1e-9
    assert m.gap("runs", "Nobody") > 0 > m.gap("the", "river")
    assert m.possible(["the", "river", "runs", "Nobody"]) and not m.possible(["the", "river"])


def test_model_learns_abbreviations_and_reports(spark):
    texts = [("The qxv. Zed came to town and saw a house that stood on the hill near the house. It was large? Then he left. “Is it far?” zorbed the man. A man slept and the man left?",)] * 20 + [(None,), ("",)]
    m = sentences.train(spark.createDataFrame(texts, "t string"), "t")
    t = "He met qxv. Zed at the house. It rained. “Was it large?” zorbed the man. “It was!” Then he left."
    want = ["He met qxv. Zed at the house.", "It rained.", "“Was it large?” zorbed the man.", "“It was!”", "Then he left."]
    assert [t[a:b] for a, b in spans(t, m)] == want
    assert m.counts.keys() == set(sentences.KINDS) and all(x.shape == (sentences.DEPTH, sentences.CELLS) for x in m.counts.values())
    assert [t[a:b] for a, b in spans(t, learnt([x for (x,) in texts if x]))] == want
    empty = sentences.train(spark.createDataFrame([], "t string"), "t")
    assert len(spans("One here. Two there.", empty)) == 2


def test_counts_hold_every_word():
    c = Counter()
    for i in range(50_000):
        c["bare", f"w{i}"] += 1
    m = Model(counts={"bare": np.zeros((sentences.DEPTH, sentences.CELLS), np.float32)})
    for _, w in c:
        for k, x in enumerate(sentences.cells(w)):
            m.counts["bare"][k, x] += 1
    assert all(m.count("bare", f"w{i}") >= 1 for i in range(0, 50_000, 97))


def test_sentences_table(spark):
    rows = [("a", "One. Two.", 1), ("a", "One. Two.", 1), ("b", None, 2), ("c", "   ", 3), (None, "Lost.", 4), ("d", "x" * 100_000 + ". End", 5)]
    df = spark.createDataFrame(rows, "key string, text string, end_pos int")
    got = {tuple(r) for r in sentences.sentences(df, "key", "text", M).collect()}
    assert got == {("a", 4), ("a", 9), ("d", 100_001), ("d", 100_005)}
    assert sentences.sentences(df.limit(0), "key", "text", M).count() == 0


def brute(t, lim):
    sp, out, i = spans(t, M), [], 0
    while i < len(sp):
        a, b = sp[i]
        if b - a > lim:
            while a < b:
                while a < b and t[a].isspace():
                    a += 1
                if b - a <= lim:
                    if a < b:
                        out.append((a, b))
                    break
                k = next((p for p in range(a + lim, a, -1) if t[p].isspace()), None)
                e = k if k is not None else a + lim
                while t[e - 1].isspace():
                    e -= 1
                out.append((a, e))
                a = k if k is not None else a + lim
            i += 1
            continue
        j = i
        while j + 1 < len(sp) and sp[j + 1][1] - a <= lim:
            j += 1
        out.append((a, sp[j][1]))
        if j + 1 >= len(sp):
            break
        i = j if j > i and sp[j + 1][1] - sp[j][0] <= lim else j + 1
    return out


def test_pieces(spark):
    texts = [
        "One two three. Four five. Six seven eight nine. Ten.", "a" * 57, "word " * 30, "x" * 19 + " " + "y" * 45 + ". Short.", "short", None, "", "   ", "قال " * 20 + ".", "tab\x1cfile " * 9, "Aa. Bb. Cc. Dd. Ee. Ff. Gg. Hh. Ii. Jj.", "😀" * 50,
    ]
    df = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)] * 2, "key string, text string, s string")
    got = {}
    for r in pieces.pieces(df, "key", "text", M, limit=20).collect():
        got.setdefault(r.key, []).append((r.start_pos, r.end_pos))
    for i, t in enumerate(texts):
        want = brute(t, 20) if t and len(t) > 20 else []
        assert sorted(got.get(str(i), [])) == sorted(set(want)), t
    assert pieces.pieces(df.limit(0), "key", "text", M).count() == 0


def forms(spark, rows):
    return lookalikes.repaired_forms(spark.createDataFrame(rows, "field string, source bigint, key string, t string"))


def test_same_looking(spark):
    rows = [("claim", 1, "1", "the name"), ("claim", 1, "2", "the nаme"), ("claim", 1, "3", "the  name"), ("claim", 1, "4", "the Name"), ("claim", 1, "5", None), ("claim", 1, "6", " "), ("claim", 1, "7", "the name"), ("claim", 1, "8", "zzqж")]
    f = forms(spark, rows + rows)
    got = {tuple(r) for r in lookalikes.same_looking(f).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 7), (3, 7)}
    assert {(r.key, r["class"]) for r in lookalikes.looks_classes(f).collect()} == {("1", "1"), ("2", "1"), ("3", "1"), ("7", "1"), ("4", "4"), ("8", "8")}


def test_repairs_need_the_vocabulary(spark):
    f = forms(spark, [("claim", 1, "1", "qwxzа here"), ("claim", 1, "2", "other words")])
    assert lookalikes.same_looking(f).count() == 0
    out = lookalikes.one_form(spark.createDataFrame([("nаme", 1), ("name", 2), (None, 3), ("", 4), ("name", 5)], "text string, base int"), "text")
    assert sorted((r.base, r.one_form) for r in out.collect()) == [(1, "name"), (2, "name"), (3, None), (4, ""), (5, "name")]


def test_evidence_is_found_again(spark):
    f = forms(spark, [("evidence", 1, "9", "ａｂｃ."), ("chunk", 1, "1:0-0", "abc."), ("chunk", 2, "2:0-0", "abc."), ("chunk", 1, "1:1-1", "ａｂｃ.")])
    assert [tuple(r) for r in lookalikes.found_again(f, "evidence", "chunk").collect()] == [("9", "1:0-0")]


def test_large_forms_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "WHOLE", 3)
    rows = [("claim", 1, str(i), "same" if i % 2 else "sаme") for i in range(10)]
    got = {tuple(r) for r in lookalikes.same_looking(forms(spark, rows)).collect()}
    assert all((a + b) % 2 for a, b in got) and {x for p in got for x in p} == set(range(10))
    assert len(got) < 10


def test_large_forms_pair_all_their_texts(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "WHOLE", 3)
    texts = ["same", "s\u200bame", "sa\u200bme", "sam\u200be"]
    rows = [("claim", 1, str(i), "same") for i in range(20)] + [("claim", 1, str(20 + i), texts[1 + i % 3]) for i in range(6)]
    text = {int(k): t for _, _, k, t in rows}
    got = [tuple(r) for r in lookalikes.same_looking(forms(spark, rows)).collect()]
    assert len(got) == len(set(got)) and all(a < b and text[a] != text[b] for a, b in got)
    first = {t: min(k for k in text if text[k] == t) for t in texts}
    assert {(min(k, f), max(k, f)) for k in text for t, f in first.items() if t != text[k]} == set(got)


def test_empty_tables(spark):
    f = forms(spark, [])
    assert lookalikes.same_looking(f).count() == lookalikes.found_again(f, "a", "b").count() == 0
