"""Text analysis: tokens, word boundaries, folded accents, English stems, snippets and passages."""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case. Null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def fold(text: str) -> str:
    """Accented letters without their accents."""
    if text.isascii():
        return text
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return plain.replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("ø", "o").replace("đ", "d").replace("ł", "l")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short_end(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


# The suffix tables of Porter's algorithm (1980).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + table[end] if _measure(stem) >= least else w
    return w


@functools.lru_cache(100_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of other letters stay."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 1), _STEP3, 1)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """An array of tokens, folded and stemmed."""
    return words.map(lambda ws: None if ws is None else [stem(fold(w)) for w in ws])


def english(text: Column) -> Column:
    """Tokens, folded and stemmed: for indexes that should find inflected words."""
    return stemmed(tokens(text))


def snippets(size: int = 200):
    """A function of (body, array of query tokens): the first fragment of at most size code points around a match, HTML-escaped, matches in <mark>; without one the beginning. For final hits only."""

    @F.pandas_udf(StringType())
    def snippet(bodies: pd.Series, queries: pd.Series) -> pd.Series:
        def one(body, words):
            body, words = body or "", {stem(fold(w)) for w in (words if words is not None else [])}
            hits = [m for m in re.finditer(r"[^\W_]+", body) if stem(fold(m[0].lower())) in words]
            start = 0 if not hits or hits[0].end() <= size else max(0, hits[0].start() - size // 4)
            out, at, end = [], start, min(len(body), start + size)
            for m in hits:
                if m.start() >= at and m.end() <= end:
                    out += [html.escape(body[at : m.start()]), "<mark>", html.escape(m[0]), "</mark>"]
                    at = m.end()
            return "".join([*out, html.escape(body[at:end])])

        return pd.Series([one(b, q) for b, q in zip(bodies, queries, strict=True)])

    return snippet


# Word boundaries by the Unicode text segmentation rules (UAX #29): don't, 3.14 and foo_bar stay whole.

#: Classes of the Word_Break property, in the order of their numbers here; Other is 0.
BREAKS = ["Other", "CR", "LF", "Newline", "Extend", "ZWJ", "Format", "Katakana", "Hebrew_Letter", "ALetter", "Single_Quote", "Double_Quote", "MidNumLet", "MidLetter", "MidNum", "Numeric", "ExtendNumLet", "Regional_Indicator", "WSegSpace"]
_N = {name: i for i, name in enumerate(BREAKS)}


@functools.cache
def _break_classes() -> np.ndarray:
    """The class of each code point, and whether it is a picture: from the Unicode tables of the regex module."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for name in BREAKS[1:]:
        for m in regex.finditer(rf"\p{{Word_Break={name}}}+", every):
            out[[ord(c) for c in m[0]]] = _N[name]
    pictures = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{Extended_Pictographic}+", every):
        pictures[[ord(c) for c in m[0]]] = True
    return np.where(pictures, out | 128, out)


def boundaries(classes: np.ndarray, pictures: np.ndarray) -> np.ndarray:
    """Whether there is a boundary before each of a text's code points (the first one too), from their classes: all places at once."""
    n = len(classes)
    if not n:
        return np.zeros(0, bool)
    of = lambda *names: np.isin(np.arange(len(BREAKS)), [_N[x] for x in names])
    line, skipped = of("CR", "LF", "Newline"), of("Extend", "Format", "ZWJ")
    letter, middle, number_middle = of("ALetter", "Hebrew_Letter"), of("MidLetter", "MidNumLet", "Single_Quote"), of("MidNum", "MidNumLet", "Single_Quote")
    # Marks belong to what they follow, so rules look at the others: the last kept one at or before each place, and the next.
    kept = ~skipped[classes] | np.r_[True, line[classes[:-1]]]
    places = np.flatnonzero(kept)
    at = np.cumsum(kept) - 1
    pad = np.r_[_N["CR"], _N["CR"], classes[places], _N["CR"], _N["CR"]]  # lines' ends join with nothing
    before = np.r_[0, at[:-1]]
    left, left2 = pad[before + 2], pad[before + 1]
    right, right2 = classes, pad[at + 3]
    joined = skipped[right]  # WB4
    joined |= letter[left] & letter[right]  # WB5
    joined |= letter[left] & middle[right] & letter[right2]  # WB6
    joined |= letter[left2] & middle[left] & letter[right]  # WB7
    hebrew = of("Hebrew_Letter")
    joined |= hebrew[left] & (right == _N["Single_Quote"])  # WB7a
    joined |= hebrew[left] & (right == _N["Double_Quote"]) & hebrew[right2]  # WB7b
    joined |= hebrew[left2] & (left == _N["Double_Quote"]) & hebrew[right]  # WB7c
    digit = of("Numeric")
    joined |= (digit[left] | letter[left]) & digit[right] | digit[left] & letter[right]  # WB8 to WB10
    joined |= digit[left2] & number_middle[left] & digit[right] | digit[left] & number_middle[right] & digit[right2]  # WB11, WB12
    kana, extends = of("Katakana"), of("ExtendNumLet")
    joined |= kana[left] & kana[right]  # WB13
    word = letter | digit | kana | extends
    joined |= word[left] & extends[right] | extends[left] & word[right] & ~extends[right]  # WB13a, WB13b
    # Flags: pairs from the beginning of a run (WB15, WB16).
    flag = pad[2:-2] == _N["Regional_Indicator"]
    run = np.arange(len(flag)) - np.maximum.accumulate(np.where(flag, -1, np.arange(len(flag))))
    odd = np.r_[False, flag & (run % 2 == 1)] if len(flag) else np.zeros(1, bool)
    joined |= odd[before + 1] & (right == _N["Regional_Indicator"]) & kept
    # What stands directly before counts here, marks included.
    prev = np.r_[_N["CR"], classes[:-1]]
    joined |= (prev == _N["ZWJ"]) & pictures  # WB3c
    joined |= (prev == _N["WSegSpace"]) & (right == _N["WSegSpace"])  # WB3d
    joined &= ~line[prev] & ~line[right]  # WB3a, WB3b
    joined |= (prev == _N["CR"]) & (right == _N["LF"])  # WB3
    joined[0] = False
    return ~joined


def _standard(text: str) -> list[str]:
    if not text:
        return []
    c = _break_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    start = np.flatnonzero(boundaries(c & 127, c > 127))
    word = np.isin(c & 127, [_N[x] for x in ("ALetter", "Hebrew_Letter", "Numeric", "Katakana")]) | np.fromiter(map(str.isalnum, text), bool, len(text))
    some = np.add.reduceat(word, start) > 0
    return [text[a:b] for a, b, ok in zip(start.tolist(), [*start[1:].tolist(), len(text)], some, strict=True) if ok]


@F.udf(ArrayType(StringType()), useArrow=False)
def standard(text: str | None) -> list[str]:
    """Words between Unicode boundaries that hold a letter or digit, lower case. Null: none. Row by row: an Arrow batch would hold the words of ten thousand texts at once."""
    return _standard(text.lower()) if text else []


def standard_english(text: Column) -> Column:
    """Words between Unicode boundaries, folded and stemmed."""
    return stemmed(standard(text))


# Passages.

#: Constants of the usual scoring of passages.
K1, B, PIVOT = 1.2, 0.75, 87
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n|[.!?]+|$)\s*")


def passages_of(body: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of the passages of a text: whole sentences as long as they fit into size code points; longer sentences are cut, at spaces if there are any."""
    out: list[tuple[int, int]] = []
    for m in _SENTENCE.finditer(body):
        a, b = m.span()
        while a < b:
            if out and b - out[-1][0] <= size:
                out[-1] = (out[-1][0], b)
                break
            to = b if b - a <= size else a + size
            if to < b:
                space = body.rfind(" ", a + 1, to)
                to = space + 1 if space > 0 else to
            out.append((a, to))
            a = to
    return out


def passage_scores(body: str, spans: list[tuple[int, int]], words: set[str]) -> list[float]:
    """Of each passage: for each of words (stems) its weight in this text times its frequency in the passage, damped by the passage's length; early passages count a little more."""
    hits = [(m.start(), s) for m in re.finditer(r"[^\W_]+", body) if (s := stem(fold(m[0].lower()))) in words]
    often = Counter(s for _, s in hits)
    texts = 1 + len(body) / PIVOT
    weight = {s: math.log(1 + (texts + 0.5) / (n + 0.5)) for s, n in often.items()}
    starts = [a for a, _ in spans]
    inside: list[Counter] = [Counter() for _ in spans]
    for at, s in hits:
        inside[bisect.bisect_right(starts, at) - 1][s] += 1
    return [(1 + 1 / math.log(PIVOT + a)) * sum(weight[s] * n / (n + K1 * (1 - B + B * (b - a) / PIVOT)) for s, n in c.items()) for (a, b), c in zip(spans, inside, strict=True)]


def best_passage(body: str | None, query: list[str] | None, size: int = 200) -> str:
    body, words = body or "", {stem(fold(w)) for w in (query if query is not None else [])}
    spans = passages_of(body, size)
    scores = passage_scores(body, spans, words)
    if not any(scores):
        return html.escape(body[:size])
    a, b = spans[max(range(len(spans)), key=lambda i: (scores[i], -i))]
    out, at = [], a
    for m in re.finditer(r"[^\W_]+", body[a:b]):
        if stem(fold(m[0].lower())) in words:
            out += [html.escape(body[at : a + m.start()]), "<mark>", html.escape(m[0]), "</mark>"]
            at = a + m.end()
    return "".join([*out, html.escape(body[at:b])]).strip()


def passages(size: int = 200):
    """A function of (body, array of query tokens): the passage that scores best for the query, the first of equals, HTML-escaped, matches in <mark>; without one the beginning. For final hits only."""

    @F.pandas_udf(StringType())
    def passage(bodies: pd.Series, queries: pd.Series) -> pd.Series:
        return pd.Series([best_passage(b, q, size) for b, q in zip(bodies, queries, strict=True)])

    return passage
