"""Sentence boundaries by a hidden-event language model.

Between any two words an event is hidden: a sentence boundary or none. The model is n-gram counts of the corpus
itself (``train``), no list of words: how often a word stands before a full stop and without one (of words of its
shape some share are abbreviations, estimated by expectation maximisation), what follows boundaries and what
follows closed quotations (a mixture of reports of speech and new sentences, parted the same way), which class of
letter follows either event, which words follow each other, and how long sentences are. Unseen words back off to
their shape, unseen pairs to their words. Counts live in tables of a fixed number of cells (count-min): all words
are in them, whatever the corpus, and the model has one size.

A text's places get the log odds of their n-grams, neighbours are tied by what only the event before explains (a
list's number, a quotation that opens a sentence), and forward-backward posteriors decide. Between the marks every gap
between words (characters, in scripts that write no spaces) is a place too, in every text: the n-grams decide, and how
likely a mark is lost there, by the text's own boundaries with marks and without.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.textforms import INVISIBLE
from evidloom.session import spread

_T = ".!?؟۔।॥。！？｡．…‼⁇⁈⁉"
_STRONG = frozenset("!?؟۔।॥。！？｡‼⁇⁈⁉")
_Q = "\"'»”’」』›"
_C = _Q + ")）]】"
_OPEN = {"»": "«", "”": "“„", "’": "‘", "」": "「", "』": "『", "›": "‹", '"': '"', "'": "'"}
_INV = "[" + "".join(f"\\U{ord(c):08x}" for c in INVISIBLE) + "]"
_SLOT = re.compile(f"[{_T}](?:{_INV}*[{_T}])*(?:{_INV}*[{re.escape(_C)}])*|(?<=[ก-๛])(?:{_INV}*)[^\\S\n]+(?={_INV}*[ก-๛])")
_HIDDEN = re.compile(_INV)
_HIDDEN_SET = frozenset(INVISIBLE)
_BREAKS = frozenset("\"'«»“”„‘’「」『』()（）[]،,;؛:：")
_AHEAD = re.compile(f"(?:{_INV})*([\\s]*)(?:{_INV})*[\"'«“„‘「『(（\\[]*(?:{_INV})*(\\w?)")
_WORD_AHEAD = re.compile(r"[\s]*([^\s.,!?؟۔।。！？，،;:؛«»“”\"「」()]+)")
_NUMBER = re.compile(r"[\d٠-٩۰-۹]+$")
_FIGURE = re.compile(r"[\d٠-٩۰-۹][\d٠-٩۰-۹.,٫٬/%٪-]*$")
#: Characters of scripts that write no spaces between words: kana, Han, Thai.
_DENSE_CLASS = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaffก-๛"
_DENSE = re.compile(f"[{_DENSE_CLASS}]")
_WORD = re.compile(r"\S+")
_DENSE_RUN = re.compile(f"[{_DENSE_CLASS}]+")
_SENTENCE_MARKS = re.compile(f"[{_T}]+[{re.escape(_C)}]*(?=\\s|$|[{_DENSE_CLASS}])|(?<=[ก-๛])[^\\S\n]+(?=[ก-๛])|\n+")
_SAID = re.compile(r"(?:^|[.!?؟۔।][\"»”]?\s+)[«“\"][^«“»”\"\n]+?[.!?؟۔।،,][»”\"]\s+(\w+)")
_SAID_DENSE = re.compile(f"[。！？!?][」』”\"]([{_DENSE_CLASS}]{{1,2}})")
_DOT_AHEAD = re.compile(r"\w\.\s+[\"'«“(]?(\w)")
_BARE_MARK = re.compile(r"\w[\s]+[\"'«“(]?(\w)")
#: Log odds beyond which an event is as good as certain.
SURE = 12.0
#: Rows and cells of a count table: what two words share in all rows is counted for both.
DEPTH, CELLS = 2, 1 << 17
#: Kinds of counts: before a full stop, not before one, after a boundary, after a quotation, before any boundary, pairs, pairs of a first word.
KINDS = ("dot", "bare", "began", "said", "ended", "pair", "types")
#: Shapes of words: number, with a dot inside, and by length.
SHAPES = 8
#: Log odds against a word's being a verb of saying, before it is seen after quotations.
VERB = 3.5


def shape(w: str) -> int:
    if _FIGURE.match(w):
        return 0
    if "." in w:
        return 1
    n = len(w)
    return 2 if n < 2 else 3 if n < 3 else 4 if n < 4 else 5 if n < 6 else 6 if n < 9 else 7


#: Log odds that a word of a shape is an ordinary one, before a corpus is seen.
_ORDINARY = (4.0, -6.0, -2.0, 4.0, 4.0, 7.0, 10.0, 10.0)


def cells(w: str) -> list[int]:
    """The word's cell in each row; the words of one shape share a part of the table."""
    part = CELLS // SHAPES
    base = shape(w) * part
    h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return [base + (h >> (20 * k)) % part for k in range(DEPTH)]


def report_odds(said: float, expected: float) -> float:
    """Log odds that a word seen ``said`` times after quotations begins a sentence there, if new ones alone would bring ``expected``."""
    evidence = said * math.log(said / expected) - said + expected
    if said <= expected or evidence < VERB:
        return SURE
    share = expected / said
    return max(-SURE, min(SURE, math.log(share / (1 - share))))


@dataclass
class Model:
    """Count tables (DEPTH x CELLS) by kind, and what was estimated from them."""

    counts: dict[str, np.ndarray] = field(default_factory=dict)
    totals: dict[str, float] = field(default_factory=dict)
    ordinary: tuple[float, ...] = _ORDINARY
    follows: dict[str, float] = field(default_factory=lambda: {"lower": -4.0, "upper": 2.5, "other": 0.0, "digit": 0.0})
    stop_rate: float = 0.06
    quoted: dict[bool, tuple[float, float]] = field(default_factory=lambda: {False: (0.0, 0.0), True: (0.0, 0.0)})
    alone: float = -2 * SURE
    ellipsis: tuple[float, float] = (3.0, -8.0)

    def __post_init__(self) -> None:
        self.seen: dict[tuple[str, str], float] = {}
        self.sides: dict[str, tuple[float, float]] = {}

    def count(self, kind: str, w: str) -> float:
        """How often the word was seen in that place, or a little more."""
        key = (kind, w)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            t = self.counts.get(kind)
            got = self.seen[key] = 0.0 if t is None else float(min(t[k, c] for k, c in enumerate(cells(w))))
        return got

    def before(self, w: str) -> float:
        """Log odds of a boundary at a full stop after the word: that it is no abbreviation."""
        s = shape(w)
        if not w:
            return 3.0
        if s < 2:
            return self.ordinary[s]
        odds = self.ordinary[s] + self.count("dot", w) * math.log(self.stop_rate / 0.97) + self.count("bare", w) * math.log((1 - self.stop_rate) / 0.03)
        return max(-SURE, min(SURE, odds))

    def after_quotation(self, w: str) -> float:
        """Log odds of a boundary between a closed quotation and the word, against its being a report of it.

        ``quoted`` has, for scripts with and without spaces, how many new sentences follow quotations, and how
        many follow other boundaries: a word that is far more frequent after quotations than these explain is a report.
        """
        said = self.count("said", w)
        new, other = self.quoted[_DENSE.match(w) is not None]
        return report_odds(said, new * (self.count("began", w) + 0.5) / (other + 1.0)) if said and new else SURE

    def ends(self, w: str) -> float:
        """P(boundary after the word), stops of abbreviations left out; a number's are a list's or a date's as well, so its shape decides."""
        c = self.count("dot", w) + self.count("bare", w)
        if shape(w) < 2:
            return min(0.95, self.stop_rate)
        ended = self.count("ended", w)
        if ended and self.count("dot", w):
            ended /= 1 + math.exp(-self.before(w))
        return min(0.95, (ended + 2 * self.stop_rate) / (c + 2))

    def gap(self, left: str, right: str) -> float:
        """Log odds of a boundary between two words without any mark."""
        n = self.totals.get("words", 0.0) + 1.0
        c = lambda w: self.count("dot", w) + self.count("bare", w)
        p_right = (c(right) + 0.1) / n
        end = self.ends(left)
        begin = (self.count("began", right) + 2 * p_right) / (self.totals.get("began", 0.0) + 2)
        types = self.count("types", left) + 1  # as many new pairs are to be expected as there were (Witten-Bell)
        inside = (self.count("pair", f"{left} {right}") + types * p_right) / (c(left) + types)
        return math.log(end * begin) - math.log((1 - end) * inside)


    def bounds(self, w: str) -> tuple[float, float]:
        """The word's parts, as the left and as the right one, of the most that ``gap`` can be: its odds had the pair not been seen."""
        got = self.sides.get(w)
        if got is None:
            if len(self.sides) > 200_000:
                self.sides.clear()
            c, types = self.count("dot", w) + self.count("bare", w), self.count("types", w) + 1
            end = self.ends(w)
            p = (c + 0.1) / (self.totals.get("words", 0.0) + 1.0)
            begin = (self.count("began", w) + 2 * p) / (self.totals.get("began", 0.0) + 2)
            got = self.sides[w] = (math.log(end / (1 - end) * (c + types) / types), math.log(begin / p))
        return got

    def possible(self, ws: list[str]) -> bool:
        """Whether the gap between any two neighbours may have odds above 0, by their bounds."""
        get, bounds = self.sides.get, self.bounds
        b = [get(w) or bounds(w) for w in ws]
        return any(x[0] + y[1] > -1e-6 for x, y in zip(b, b[1:]))

    def likely(self, pairs: list[tuple[str, str]]) -> int:
        """How many of the gaps between two words have odds above 0; few are computed, by their bounds."""
        b, gap = self.bounds, self.gap
        return sum(1 for x, y in pairs if b(x)[0] + b(y)[1] > -1e-6 and gap(x, y) > 0)


def _class(ch: str) -> str:
    return "digit" if ch.isdigit() else "lower" if ch.islower() else "upper" if ch.isupper() else "other"


def posteriors(unary: list[float], tied: list[float]) -> list[float]:
    """P(boundary) at each place of a two-state chain.

    unary: log odds of a boundary; tied: what is added if the place before it is a boundary too (for the
    first place: as the text's beginning is one).
    """
    n = len(unary)
    fwd, norm = [], []
    b = 1.0
    for u, t in zip(unary, tied, strict=True):
        with_b = math.exp(max(-60.0, min(60.0, u + t)))
        without = math.exp(max(-60.0, min(60.0, u)))
        p1, p0 = b * with_b + (1 - b) * without, 1.0
        z = p1 + p0
        b = p1 / z
        fwd.append(b)
        norm.append(z)
    out = [0.0] * n
    beta1 = beta0 = 1.0
    for i in range(n - 1, -1, -1):
        a1, a0 = fwd[i] * beta1, (1 - fwd[i]) * beta0
        out[i] = a1 / (a1 + a0)
        if i:
            w1 = math.exp(max(-60.0, min(60.0, unary[i] + tied[i])))
            w0 = math.exp(max(-60.0, min(60.0, unary[i])))
            n1, n0 = w1 * beta1 + beta0, w0 * beta1 + beta0
            z = n1 + n0
            beta1, beta0 = n1 / z, n0 / z
    return out


def _left(text: str, a: int, at: int) -> str:
    """The word that ends at ``a``."""
    i = a
    while i > at and not text[i - 1].isspace() and text[i - 1] not in _BREAKS:
        i -= 1
    w = text[i:a]
    if i == at > 0 and not text[i - 1].isspace() and text[i - 1] not in _BREAKS and i < a:
        return "." + w  # a word with a dot inside
    return w if w.isascii() else _HIDDEN.sub("", w)


def _after(text: str, e: int) -> str:
    """The word ahead, in scripts without spaces the next two characters, by which reports of speech are known."""
    m = _WORD_AHEAD.match(text, e)
    w = _HIDDEN.sub("", m[1]) if m else ""
    return w[:2] if w and _DENSE.match(w) else w


def _places(text: str, model: Model, stop: int) -> tuple[list[int], list[float], list[float]]:
    """The places of a text where marks allow a boundary: ends, log odds, and what is added if the one before is one."""
    ends, unary, tied, last = [], [], [], 0
    for m in _SLOT.finditer(text, 0, stop):
        a, e = m.span()
        if e >= stop:
            break
        run = m[0]
        first = run[0]
        if first not in _T:  # a space of a script without spaces between words
            ends.append(a)
            unary.append(6.0)
            tied.append(0.0)
            last = e
            continue
        if len(run) > 1 and not run.isascii():
            run = _HIDDEN.sub("", run)
        body = run.rstrip(_C) if len(run) > 1 else run
        closers = run[len(body) :]
        ahead = _AHEAD.match(text, e)
        gap, nxt = ahead[1], ahead[2]
        tie = 0.0
        cls = _class(nxt) if nxt else "other"
        if any(ch in _STRONG for ch in body):
            score = 8.0 + (max(-3.0, model.follows["lower"]) if cls == "lower" and gap else 0.0)
            if not gap and not closers and first in "!?" and cls == "lower" and text[e : e + 1].isascii():
                score = -4.0
        elif len(body) > 1 or body in "…‼⁇⁈⁉":
            spaced = a == 0 or text[a - 1].isspace()
            score = model.ellipsis[1] if spaced else model.ellipsis[0] + (2 * min(0.0, model.follows["lower"]) if cls == "lower" else 0.0)
        else:
            left = _left(text, a, last)
            if not gap and not closers:
                beside = text[e : e + 1]
                if beside.isdigit() or not (nxt and (beside.isalpha() or beside in _HIDDEN_SET or beside in "«“\"「(")):
                    score = -SURE
                elif len(left) < 2 or "." in left or left[-1:].isdigit():
                    score = -SURE
                else:
                    word = _WORD_AHEAD.match(text, e)
                    short = word is None or len(word[1]) < 2
                    score = -SURE if cls == "lower" or short else 4.0
            else:
                score = model.before(left) + model.follows[cls] + (2.0 if "\n" in gap else 0.0)
                if _NUMBER.match(left) and not closers and not text[last : a - len(left)].strip(" \t\r\n\"'«“(" + INVISIBLE):
                    score, tie = 2.0, model.alone  # a sentence of one word, if one begins with it: a list's number
        if closers and any(c in _Q for c in closers):
            w = _after(text, e)
            dense = bool(w) and not gap and _DENSE.match(w) is not None
            if cls == "lower" and gap:
                score = min(score, 0.0) - 4.0
            elif w and (report := model.after_quotation(w)) < 0:
                if dense:
                    score = min(score, report)
                else:
                    q = closers[0] if closers[0] in _Q else next(c for c in closers if c in _Q)
                    at = max(text.rfind(o, last, a) for o in _OPEN[q])
                    if at >= 0 and not text[last:at].strip(" \t\r\n" + INVISIBLE):
                        score, tie = 0.0, min(report, -2.0) - SURE  # such a word is no likely beginning of a sentence
        ends.append(e)
        unary.append(max(-SURE, min(SURE, score)))
        tied.append(tie)
        last = e
    return ends, unary, tied


def units(text: str, a: int, e: int) -> tuple[bool, list[tuple[int, int]]]:
    """(dense, spans) of the words of a part of a text; of its characters, if most of it is in a script without spaces."""
    dense = sum(m.end() - m.start() for m in _DENSE_RUN.finditer(text, a, e)) > (e - a) // 2
    if not dense:
        return False, [m.span() for m in _WORD.finditer(text, a, e)]
    return True, [(i, i + 1) for i in range(a, e) if not text[i].isspace()]


def _unmarked(text: str, a: int, e: int) -> tuple[list[int], list[tuple[str, str]]]:
    """The places of a stretch between marks, every gap: ends, and the words (pairs of characters) around each."""
    dense, own = units(text, a, e)
    ends, pairs = [], []
    if dense:
        for k in range(2, len(own) - 1):
            i = own[k][0]
            left, right = text[own[k - 2][0] : i], text[i : own[k + 1][1]]
            if len(left) == 2 and len(right) == 2 and _DENSE.match(left[1]) and _DENSE.match(right[0]):
                ends.append(i)
                pairs.append((left, right))
    else:
        bare = [text[x:y] for x, y in own]
        if _HIDDEN.search(text, a, e):
            bare = [_HIDDEN.sub("", w) for w in bare]
        for k in range(len(own) - 1):
            if bare[k][-1:].isalnum() and bare[k + 1][:1].isalnum():
                ends.append(own[k][1])
                pairs.append((bare[k], bare[k + 1]))
    return ends, pairs


def _lost(text: str, model: Model, keep: list[int], marked: int) -> list[int]:
    """Boundaries whose marks are lost, of a text with ``marked`` others; ``keep`` are the ends of its stretches.

    No tie raises a place's odds, so a stretch of which no gap has odds above 0 has none.
    """
    found, missing, at = [], 0, 0
    for e in keep:
        a, at, part = at, e, text[at:e]
        if not _DENSE.search(part) and not model.possible((part if part.isascii() else _HIDDEN.sub("", part)).split()):
            continue
        ends, pairs = _unmarked(text, a, e)
        if n := model.likely(pairs):
            found.append((a, e, ends, pairs))
            missing += n
    out, lost = [], math.log((missing - 0.5) / (marked + missing)) if missing else 0.0  # by the other boundaries, and half a one of either kind
    for a, e, ends, pairs in found:
        unary = [max(-SURE, min(SURE, model.gap(x, y) + lost)) for x, y in pairs]
        tied = [model.alone / 4 if y - x <= 2 or " " not in text[x + (x > a) : y].strip() else 0.0 for x, y in zip([a, *ends], [*ends, e])]
        unary[-1] += tied.pop()  # a boundary ends the stretch, as one begins it
        out += [x for x, p in zip(ends, posteriors(unary, tied), strict=True) if p > 0.5]
    return out


def boundaries(text: str | None, model: Model) -> list[int]:
    """The ends of the sentences of a text, in characters from 0, exclusive; none if it is null or blank."""
    if not text:
        return []
    stop = len(text.rstrip())
    while stop and text[stop - 1] in INVISIBLE:  # what can't be seen after the last space is no sentence
        inner = len(text[: stop - 1].rstrip())
        if inner == stop - 1:
            break
        stop = inner
    if all(c.isspace() or c in _HIDDEN_SET for c in text[:stop]):
        return []
    ends, unary, tied = _places(text, model, stop)
    keep = [e for e, p in zip(ends, posteriors(unary, tied), strict=True) if p > 0.5]
    marked = len(keep)
    if not keep or keep[-1] != stop:
        keep.append(stop)
    if model.totals and (lost := _lost(text, model, keep, marked)):
        keep = sorted(keep + lost)
    return keep


def spans(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences, without the white space around them."""
    out, at = [], 0
    for e in boundaries(text, model):
        s = at
        while s < e and text[s].isspace():
            s += 1
        if s < e:
            out.append((s, e))
        at = e
    return out


def observe(text: str, c: Counter, lengths: Counter) -> None:
    """Count the n-grams of one text that the model is made of, and the lengths of its sentences."""
    if _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    before, ended, quoted = "", True, False
    for tok in text.split():
        w = tok.lstrip("\"'«“„‘「『(（[")
        stopped = w.endswith(".") and not w.endswith("..")
        if stopped:
            w = w[:-1]
            c["dot", w] += 1
        else:
            w = w.rstrip("،,;؛:!?؟۔।\"'»”’)）]")
            c["bare", w] += 1
        if not ended:
            pair = f"{before} {w}"
            if ("pair", pair) not in c:
                c["types", before] += 1
            c["pair", pair] += 1
        elif not quoted:  # what follows a quotation may be a report of it
            c["began", w] += 1
            lengths["began_n", "spaced"] += 1
        ended, quoted = stopped or _SENTENCE_MARKS.search(tok) is not None, tok[-1] in _Q
        if ended:
            c["ended", w] += 1
        before = w
    for m in _DENSE_RUN.finditer(text):
        r = m[0]
        for i in range(len(r) - 1):
            c["bare", r[i : i + 2]] += 1
            if i + 4 <= len(r):
                pair = f"{r[i : i + 2]} {r[i + 2 : i + 4]}"
                if ("pair", pair) not in c:
                    c["types", r[i : i + 2]] += 1
                c["pair", pair] += 1
        c["ended", r[-2:]] += text[m.end() : m.end() + 1] in (*_STRONG, " ", "")
        if m.start() == 0 or text[m.start() - 1] in _STRONG or text[m.start() - 1].isspace():
            c["began", r[:2]] += 1
            lengths["began_n", "dense"] += 1
    for m in _SAID_DENSE.finditer(text):
        c["said", m[1]] += 1
        lengths["said_n", "dense"] += 1
    for m in _SAID.finditer(text):
        c["said", m[1]] += 1
        lengths["said_n", "spaced"] += 1
    for m in _DOT_AHEAD.finditer(text):
        lengths["stopped", _class(m[1])] += 1
    for m in re.finditer(r"[!?؟۔।][\"'»”’]?\s+[\"'«“(]?(\w)", text):
        lengths["after", _class(m[1])] += 1
    for m in _BARE_MARK.finditer(text):
        lengths["within", _class(m[1])] += 1
    for m in re.finditer(r"(\s?)(?:\.\.+|…)\s+[\"'«“(]?(\w)", text):
        lengths["spaced" if m[1] else "glued", _class(m[2])] += 1
    at = 0
    for m in [*_SENTENCE_MARKS.finditer(text), None]:
        e = m.start() if m else len(text)
        if e > at:
            dense, own = units(text, at, e)
            if own and not dense:
                lengths["spaced_words", str(len(own))] += 1
        at = m.end() if m else e


def train(texts: DataFrame, col: str) -> Model:
    """The model of a table of texts, all of which are read; null texts tell nothing.

    Counts are combined within partitions, by cell. At most DEPTH * CELLS of each kind reach the driver, at any
    size of the corpus, and as many lengths as sentences have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, lengths = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for kind in KINDS:
                own = [(w, n) for (k, w), n in c.items() if k == kind]
                if own:
                    at = np.array([cells(w) for w, _ in own], dtype=np.int64) + np.arange(DEPTH) * CELLS
                    cell, where = np.unique(at.ravel(), return_inverse=True)
                    n = np.bincount(where, weights=np.repeat([x for _, x in own], DEPTH)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(cell)), pa.array(cell.astype(str)), pa.array(n)], ["kind", "w", "n"])
            if lengths:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in lengths]), pa.array([k[1] for k in lengths]), pa.array(list(lengths.values()), pa.int64())], ["kind", "w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    observe(t, c, lengths)
            if len(c) > 300_000:
                yield from out()
                c.clear()
                lengths.clear()
        yield from out()

    n = spread(texts.select(F.col(col).alias("t"))).mapInArrow(run, "kind string, w string, n bigint").groupBy("kind", "w").agg(F.sum("n").alias("n"))
    got = n.toPandas()
    return estimated({k: dict(zip(g["w"], g["n"], strict=True)) for k, g in got.groupby("kind")})


def estimated(seen: dict[str, dict[str, int]]) -> Model:
    """The model from counts by cell, by class of letter and of lengths."""
    m = Model()
    for kind in KINDS:
        t = np.zeros(DEPTH * CELLS, np.float32)
        if own := seen.get(kind):
            t[np.array([int(w) for w in own])] = np.array(list(own.values()), np.float32)
        m.counts[kind] = t.reshape(DEPTH, CELLS)
    first = {k: m.counts[k][0].astype(float) for k in KINDS}
    m.totals = {k: float(first[k].sum()) for k in KINDS}
    m.totals["words"] = m.totals["dot"] + m.totals["bare"]
    stops, all_ = first["dot"][CELLS // SHAPES * 5 :].sum(), (first["dot"] + first["bare"])[CELLS // SHAPES * 5 :].sum()
    m.stop_rate = float((stops + 6) / (all_ + 100))
    # of the words of a shape, what share are abbreviations: expectation maximisation from the shape's prior
    used = np.flatnonzero((first["dot"] > 0) | (first["bare"] > 0))
    shapes = used // (CELLS // SHAPES)
    evidence = first["dot"][used] * math.log(m.stop_rate / 0.97) + first["bare"][used] * math.log((1 - m.stop_rate) / 0.03)
    ordinary = np.array(_ORDINARY)
    for _ in range(5):
        p = 1 / (1 + np.exp(np.clip(evidence + ordinary[shapes], -60, 60)))  # of being an abbreviation
        for s in range(2, SHAPES):
            own = p[shapes == s]
            share = (own.sum() + 4 / (1 + math.exp(_ORDINARY[s]))) / (len(own) + 4)
            ordinary[s] = math.log((1 - share) / share)
    m.ordinary = tuple(float(x) for x in ordinary)
    p = 1 / (1 + np.exp(np.clip(evidence + ordinary[shapes], -60, 60)))
    short = float((first["dot"][used] * p)[shapes > 1].sum() / max(1.0, first["dot"][used][shapes > 1].sum()))  # share of stops that are abbreviations'
    cls = {k: {x: seen.get(x, {}).get(k, 0) for x in ("after", "within", "stopped", "glued", "spaced")} for k in m.follows}
    prior = {"lower": (1, 80), "upper": (30, 5)}  # cased scripts only: the other classes tell nothing of where a sentence begins
    cased = {x: sum(cls[k][x] + prior[k][x == "within"] for k in prior) for x in ("after", "within")}
    share = {k: {x: (cls[k][x] + p[x == "within"]) / cased[x] for x in cased} for k, p in prior.items()}
    for k in prior:
        m.follows[k] = max(-6.0, min(4.0, math.log(share[k]["after"]) - math.log(share[k]["within"])))
    # numbers follow abbreviations more often than they begin sentences
    n_after, n_stopped = sum(c["after"] for c in cls.values()), sum(c["stopped"] for c in cls.values())
    begins = (cls["digit"]["after"] + 1) / (n_after + 20)
    follows = ((cls["digit"]["stopped"] + 1) / (n_stopped + 20) - (1 - short) * begins) / max(0.01, short)
    m.follows["digit"] = max(-4.0, min(0.0, math.log(begins / min(1.0, max(1e-3, follows)))))
    # an ellipsis ends a sentence as often as what follows it looks like the beginning of one
    odds = []
    for kind, p0 in (("glued", 0.95), ("spaced", 0.0003)):
        up, low = cls["upper"][kind], cls["lower"][kind]
        u = up / (up + low) if up + low else share["upper"]["within"]
        p = (u - share["upper"]["within"]) / max(1e-6, share["upper"]["after"] - share["upper"]["within"])
        p = (min(1.0, max(0.0, p)) * (up + low) + p0 * 50) / (up + low + 50)
        odds.append(math.log(p / (1 - p)))
    m.ellipsis = (odds[0], odds[1])
    for dense, group in ((False, "spaced"), (True, "dense")):
        m.quoted[dense] = (float(seen.get("said_n", {}).get(group, 0)), float(seen.get("began_n", {}).get(group, 0)))
    new, other = m.quoted[False]
    at = np.flatnonzero(first["said"])
    for _ in range(5):  # of what follows quotations, take what is a report off the new sentences
        rate = (first["began"][at] + 0.5) / (other + 1.0)
        excess = [x - new * r for x, r in zip(first["said"][at], rate, strict=True) if new and report_odds(x, new * r) < 0]
        new = max(1.0, m.quoted[False][0] - sum(excess))
    if m.quoted[False][0]:
        m.quoted[False] = (new, other)
    lens = seen.get("spaced_words", {})
    if len(lens) and sum(lens.values()) >= 100:
        one = (lens.get("1", 0) + 0.5) / (sum(lens.values()) + 1)
        m.alone = max(-2 * SURE, min(-SURE, math.log(one)))
    return m


def sentence_ends(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, ends): the ends of the sentences of every row's text; key as string; null and blank texts have no row."""
    src = spread(df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null and k is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [boundaries(t, model) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.list_(pa.int64()))], ["key", "ends"])

    return src.mapInArrow(run, "key string, ends array<bigint>").where(F.size("ends") > 0)


def sentences(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, end_pos), distinct: one row per sentence. A key with several texts has the sentences of all of them.

    Repeated rows count once; other columns play no part; an empty table gives no rows.
    """
    per_key = sentence_ends(df, key, text, model).groupBy("key").agg(F.collect_set("ends").alias("all"))
    return per_key.select("key", F.explode(F.array_distinct(F.flatten("all"))).alias("end_pos"))
