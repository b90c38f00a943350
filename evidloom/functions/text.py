"""Text functions of the retrieval pipeline as native column expressions.

White space is Unicode's throughout (the class below holds exactly what Python's ``\\s`` does); lengths and
positions count code points. A null text counts as empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character, for Java's and RE2's regular expressions alike.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
#: Arabic short vowels and the elongation sign, which comparison ignores.
MARKS = "[ً-ْٰـ]"
#: A run of closing marks.
STOPS = "[.!?؟]+"

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(t: ColumnLike) -> Column:
    return F.regexp_replace(_c(t), f"^{WS}+|{WS}+$", "")


def normalize(t: ColumnLike) -> Column:
    """Without short vowels and elongation, white space collapsed and trimmed; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(_c(t), F.lit("")), MARKS, "")
    return F.trim(F.regexp_replace(bare, f"{WS}+", " "))


def is_blank(t: ColumnLike) -> Column:
    """Null, or nothing but white space."""
    t = _c(t)
    return t.isNull() | t.rlike(f"^{WS}*$")


def segment(t: ColumnLike) -> Column:
    """Sentences: a run of stops before white space or the end closes one; pieces are trimmed, empty ones dropped."""
    marked = F.regexp_replace(F.coalesce(_c(t), F.lit("")), f"({STOPS})(?={WS}|\\z)", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def tokens(t: ColumnLike) -> Column:
    """The normalised text split at spaces: case and punctuation stay."""
    return F.filter(F.split(normalize(t), " "), lambda x: x != "")


def token_set(t: ColumnLike) -> Column:
    return F.array_distinct(tokens(t))


def containment(claim: ColumnLike, evidence: ColumnLike) -> Column:
    """Share of the claim's different tokens that the evidence has; 0 for a claim without tokens."""
    a, b = token_set(claim), token_set(evidence)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def overlap_of(needed: ColumnLike, others: ColumnLike) -> Column:
    """Share of the first token set that is in the second (both arrays without repeats)."""
    n = F.size(_c(needed))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(needed, others)).cast("double") / n)


def holds(hay: ColumnLike, needle: ColumnLike) -> Column:
    """Whether a normalised text holds a non-empty normalised needle."""
    return F.contains(_c(hay), _c(needle)) & (_c(needle) != "")


def token_f1(predicted: ColumnLike, gold: ColumnLike) -> Column:
    """F1 over the multisets of tokens; 1 if both are empty, 0 if they share none.

    The tokens are bound to a lambda's variable: as plain expressions they would be made anew for every comparison.
    """

    def f1(x: Column) -> Column:
        p, g = x["p"], x["g"]
        times = lambda arr, t: F.size(F.filter(arr, lambda y: y == t))
        k = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda acc, t: acc + F.least(times(p, t), times(g, t))).cast("double")
        np_, ng = F.size(p).cast("double"), F.size(g).cast("double")
        return F.when((np_ == 0) & (ng == 0), F.lit(1.0)).when(k == 0, F.lit(0.0)).otherwise(2 * (k / np_) * (k / ng) / (k / np_ + k / ng))

    return F.transform(F.array(F.struct(tokens(predicted).alias("p"), tokens(gold).alias("g"))), f1)[0]


def exact_match(predicted: ColumnLike, gold: ColumnLike) -> Column:
    return (normalize(gold) != "") & (normalize(predicted) == normalize(gold))


def span_start(chunk_id: ColumnLike) -> Column:
    """First sentence of an id ``source:start-end``; null if it isn't one (last colon, then first dash)."""
    return F.regexp_extract(_c(chunk_id), r"^.*:(\d+)-(\d+)$", 1).try_cast("bigint")


def span_end(chunk_id: ColumnLike) -> Column:
    return F.regexp_extract(_c(chunk_id), r"^.*:(\d+)-(\d+)$", 2).try_cast("bigint")


def span_iou(a_start: ColumnLike, a_end: ColumnLike, b_start: ColumnLike, b_end: ColumnLike) -> Column:
    """Intersection over union of two inclusive sentence spans; 0 if any bound is null."""
    a0, a1, b0, b1 = (_c(x) for x in (a_start, a_end, b_start, b_end))
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1).cast("double")
    union = (a1 - a0 + 1) + (b1 - b0 + 1) - inter
    missing = a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull()
    return F.when(missing | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def html_title(html: ColumnLike, suffix: str = " - ") -> Column:
    """The trimmed text of the title element before ``suffix``; null if there is none."""
    got = F.regexp_extract(_c(html), r"(?is)<title>(.*?)</title>", 1)
    return F.nullif(strip(F.substring_index(got, suffix, 1)), F.lit(""))


def preview(t: ColumnLike, n: int = 80) -> Column:
    return F.substring(_c(t), 1, n)


def prefixed(t: ColumnLike, model: str, role: str) -> Column:
    """The text with the role before it where the model's name asks for that (``query: ``, ``passage: ``)."""
    return F.concat(F.lit(f"{role}: "), _c(t)) if "e5" in model.lower() else _c(t)


def chunk_id(source: ColumnLike, start: ColumnLike, end: ColumnLike) -> Column:
    return F.concat_ws("", _c(source).cast("string"), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))


def clipped(claim: ColumnLike, budget: int) -> Column:
    """The first ``budget`` tokens of a claim, joined by spaces."""
    return F.array_join(F.slice(tokens(claim), 1, budget), " ")


def notes(parts: ColumnLike) -> Column:
    return F.array_join(_c(parts), "; ")


def seeded(key: ColumnLike, seed: int) -> Column:
    """A sort key that is the same in every engine: the MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def digest(t: ColumnLike) -> Column:
    return F.sha2(_c(t), 256)
