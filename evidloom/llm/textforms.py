"""One form for texts that look the same, and the words that comparisons use.

``base_form`` removes what cannot be seen and unifies what is drawn alike without any corpus;
``fold`` also writes tokens in one script and drops letter case, for comparing words.
``suspicious`` lists the tokens whose scripts are mixed with their script-aware ``repairs``, of which
``lookalikes.py`` accepts the first that the corpus has as a word.

Null counts as the empty text here; callers that must tell the two apart test for null first.
"""

from __future__ import annotations

import re
import unicodedata as ud

import regex

# Letters of Cyrillic and Greek that are drawn like a Latin letter.
CYRILLIC_LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdhqw", strict=True))
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj", strict=True))
# Persian digits drawn like the Arabic ones.
DIGIT_LOOKS = dict(zip("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩", strict=True))
LOOKS = {**CYRILLIC_LOOKS, **GREEK_LOOKS}
LATIN_LOOKS = frozenset(LOOKS.values())

#: Kinds of compatibility characters that are another print of the same sign.
_SAME_SIGN = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2}
_EXTRA_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
_SPACES = {*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0x2028, 0x2029}


def _signs() -> dict[int, str]:
    out: dict[int, str] = {}
    for cp in [*range(0x10000), *range(0xE0000, 0xE01F0)]:
        c = chr(cp)
        kind = ud.category(c)
        if (kind == "Cf" and cp not in _VISIBLE_FORMAT) or cp in _EXTRA_INVISIBLE or cp >= 0xE0000:
            out[cp] = ""
        elif kind == "Zs" or cp in _SPACES:
            if cp != 0x20:
                out[cp] = " "
        elif (d := ud.decomposition(c)).startswith("<"):
            to = ud.normalize("NFKC", c)
            if d.startswith(_SAME_SIGN) and not to.startswith(" "):
                out[cp] = to
            elif d.startswith("<compat>") and to.isalpha():  # ligatures, Roman numerals
                out[cp] = to
    return out | {ord(a): b for a, b in DIGIT_LOOKS.items()}


SIGNS = _signs()
INVISIBLE = "".join(chr(c) for c, to in SIGNS.items() if to == "" and c < 0x10000)


def _cls(cps: list[int]) -> str:
    """A character class of the code points, as ranges: ``re`` tests those by one table look-up."""
    out, cps = [], sorted(set(cps))
    i = 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\U{cps[i]:08x}" + (f"-\\U{cps[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


_MARKS = [c for c in range(0x11000) if ud.category(chr(c))[0] == "M" and c not in SIGNS]
_SIGN = re.compile(f"[{_cls([*SIGNS])}]")
_GAPS = regex.compile(" {2,}")
_JOINED = regex.compile(r"[یک](?=\p{M}*[ؠآ-ؿف-يٮ-ۓ])")
#: ``re`` has no marks in its words; the class below is letters, digits and marks.
WORD = re.compile(f"[\\w{_cls(_MARKS)}]+")
_ALPHABETS = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}]\p{M}*(?:[\p{Latin}\p{Cyrillic}\p{Greek}]\p{M}*)*")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}]")


def _shape(m: regex.Match) -> str:
    return "ي" if m[0] == "ی" else "ك"


def _unify(text: str, signs: dict[int, str], odd: re.Pattern) -> str:
    t = odd.sub(lambda m: signs[ord(m[0])], text)
    if "  " in t:
        t = _GAPS.sub(" ", t)
    t = t.strip(" ")
    if "ی" in t or "ک" in t:  # within a word both are drawn as the Arabic letters
        t = _JOINED.sub(_shape, t).replace("ی", "ى")
    return t if ud.is_normalized("NFC", t) else ud.normalize("NFC", t)


def base_form(text: str | None) -> str:
    """The text without invisible characters, with one kind of space and one print of each sign.

    Letter case, marks, digits and punctuation stay: they can be seen.
    """
    if not text:
        return ""
    return _unify(text, SIGNS, _SIGN)


def fold(text: str | None) -> str:
    """The form in which words are compared: base form, tokens of one script where look-alikes allow it, lower case.

    A token with letters of a foreign alphabet is turned to the text's own one if each of them has a look-alike
    there, else to the one that it has most letters of. Tokens of a text's own alphabet stay.
    """
    if not text:
        return ""
    t = _unify(text, SIGNS, _SIGN)
    if _FOREIGN.search(t):
        main, to = main_script(t), {}
        for tok in set(_ALPHABETS.findall(t)):
            if r := turned(tok, main) or next(iter(repairs(tok, main)), None):
                to[tok] = r
        t = replace_tokens(t, to)
    t = t.casefold()
    return t if ud.is_normalized("NFC", t) else ud.normalize("NFC", t)


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared: runs of letters, digits and vowel marks, folded."""
    return WORD.findall(fold(text).replace("_", " "))


def script_of(ch: str) -> str:
    n = ud.name(ch, "")
    return "cyrillic" if n.startswith("CYRILLIC") else "greek" if n.startswith("GREEK") else "latin" if n.startswith("LATIN") else "other"


def main_script(form: str) -> str:
    """The alphabet of the letters of a text that no other alphabet has a look-alike of; Latin if there are none."""
    n = {"latin": 0, "cyrillic": 0, "greek": 0}
    for tok in _ALPHABETS.findall(form):
        for ch in tok:
            s = script_of(ch)
            if s in n and ch not in LOOKS and ch not in LATIN_LOOKS:
                n[s] += 1
    return max(n, key=lambda s: n[s])


def turned(token: str, to: str) -> str | None:
    """The token in one script, or None if a letter of it has no look-alike there, or none needs one."""
    other = {b: a for a, b in (CYRILLIC_LOOKS if to == "cyrillic" else GREEK_LOOKS).items()} if to != "latin" else {}
    out = "".join(ch if script_of(ch) in (to, "other") else other.get(LOOKS.get(ch, ch), ch) if other else LOOKS.get(ch, ch) for ch in token)
    return out if out != token and all(script_of(ch) in (to, "other") for ch in out) else None


def repairs(token: str, text_script: str = "latin") -> list[str]:
    """What ``token`` may be in one script, the likeliest first: that of most of its letters, that of the text, Latin.

    A token of one script is only turned to the script of the text, if it is foreign to it. Of equal numbers of
    letters the text's script comes first.
    """
    n = {"latin": 0, "cyrillic": 0, "greek": 0}
    for ch in token:
        s = script_of(ch)
        if s in n:
            n[s] += 1
    have = [s for s, k in n.items() if k]
    if not have or have == [text_script]:
        return []
    order = [text_script] if len(have) == 1 else [max(have, key=lambda s: (n[s], s == text_script)), text_script, "latin"]
    return list(dict.fromkeys(r for s in order if (r := turned(token, s)) is not None))


def suspicious(form: str) -> list[tuple[str, list[str]]]:
    """(token, repairs) for the tokens of a base form whose letters come from the wrong script."""
    if not _FOREIGN.search(form):
        return []
    main = main_script(form)
    return [(t, r) for t in dict.fromkeys(_ALPHABETS.findall(form)) if _FOREIGN.search(t) and (r := repairs(t, main))]


def replace_tokens(form: str, to: dict[str, str]) -> str:
    return _ALPHABETS.sub(lambda m: to.get(m[0], m[0]), form) if to else form


def latin_words(form: str) -> list[str]:
    """Words written in one of the three alphabets without mixture: the vocabulary of repairs."""
    return list({t for t in _ALPHABETS.findall(form) if len({script_of(c) for c in t} - {"other"}) == 1})
