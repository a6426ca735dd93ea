"""Word boundaries against the plain rules, passages against all of them."""

import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import analysis as an

AHL, MNLQ = {"ALetter", "Hebrew_Letter"}, {"MidNumLet", "Single_Quote"}
LINES, MARKS = {"CR", "LF", "Newline"}, {"Extend", "Format", "ZWJ"}


def plain(names, pictures):
    """Whether there is a boundary before each place, rule by rule."""
    out = [True]
    for i in range(1, len(names)):
        a, b = names[i - 1], names[i]
        if a == "CR" and b == "LF":
            out.append(False)
        elif a in LINES or b in LINES:
            out.append(True)
        elif a == "ZWJ" and pictures[i] or a == b == "WSegSpace" or b in MARKS:
            out.append(False)
        else:
            # Marks are passed over, but not those at the beginning or after a line's end.
            left = [j for j in range(i) if not (names[j] in MARKS and j and names[j - 1] not in LINES)]
            right = [j for j in range(i, len(names)) if not (names[j] in MARKS and j and names[j - 1] not in LINES)]
            p, p2 = names[left[-1]], names[left[-2]] if len(left) > 1 else ""
            n2 = names[right[1]] if len(right) > 1 else ""
            flags = sum(1 for _ in itertools.takewhile(lambda j: names[j] == "Regional_Indicator", reversed(left)))
            word = AHL | {"Numeric", "Katakana", "ExtendNumLet"}
            joined = (
                p in AHL and b in AHL
                or p in AHL and b in MNLQ | {"MidLetter"} and n2 in AHL
                or p2 in AHL and p in MNLQ | {"MidLetter"} and b in AHL
                or p == "Hebrew_Letter" and b == "Single_Quote"
                or p == "Hebrew_Letter" and b == "Double_Quote" and n2 == "Hebrew_Letter"
                or p2 == "Hebrew_Letter" and p == "Double_Quote" and b == "Hebrew_Letter"
                or p in AHL | {"Numeric"} and b == "Numeric"
                or p == "Numeric" and b in AHL
                or p2 == "Numeric" and p in MNLQ | {"MidNum"} and b == "Numeric"
                or p == "Numeric" and b in MNLQ | {"MidNum"} and n2 == "Numeric"
                or p == b == "Katakana"
                or p in word and b == "ExtendNumLet"
                or p == "ExtendNumLet" and b in word - {"ExtendNumLet"}
                or p == b == "Regional_Indicator" and flags % 2 == 1
            )
            out.append(not joined)
    return out


def check(names, pictures=None):
    pictures = pictures or [False] * len(names)
    got = an.boundaries(np.array([an.BREAKS.index(x) for x in names], np.uint8), np.array(pictures)).tolist()
    assert got == plain(names, pictures), (names, pictures)


def test_all_pairs_and_triples():
    for k in (1, 2, 3):
        for names in itertools.product(an.BREAKS, repeat=k):
            check(list(names))
    for a, b in itertools.product(an.BREAKS, repeat=2):
        check([a, "ZWJ", b], [False, False, True])


def test_random_texts():
    rng = random.Random(1)
    for _ in range(3000):
        k = rng.randrange(4, 14)
        check([rng.choice(an.BREAKS) for _ in range(k)], [rng.random() < 0.2 for _ in range(k)])


@pytest.mark.parametrize(("text", "want"), [("Don't panic: 3.14, foo_bar!", ["don't", "panic", "3.14", "foo_bar"]), ("été 1,000.5", ["été", "1,000.5"]), ("a.b. c:d", ["a.b", "c:d"]), ("", []), ("-- ..", []), ("x\r\ny", ["x", "y"])])
def test_words(text, want):
    assert an._standard(text.lower()) == want


def test_standard_column(spark):
    df = spark.createDataFrame([("It isn't 5.5 km",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(an.standard(F.col("t"))).collect()] == [["it", "isn't", "5.5", "km"], [], []]


def test_best_of_all_passages():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice(["deploy", "deployed", "failed", "search", "index", "the", "a", "x" * 60]) for _ in range(rng.randrange(1, 120))]
        body = "".join(w + rng.choice([" ", " ", ". ", "\n", "! ", ", "]) for w in words)
        spans = an.passages_of(body, 80)
        assert "".join(body[a:b] for a, b in spans) == body and all(0 < b - a <= 80 for a, b in spans)
        query = rng.sample(["deploy", "search", "index", "none"], 2)
        got = html.unescape(re.sub("</?mark>", "", an.best_passage(body, query, 80)))
        stems = {an.stem(w) for w in query}

        def score(span):
            a, b = span
            found = [an.stem(w.lower()) for w in re.findall(r"[^\W_]+", body[a:b])]
            every = [an.stem(w.lower()) for w in re.findall(r"[^\W_]+", body)]
            total = 0.0
            for s in stems:
                if s in found:
                    weight = np.log(1 + (1 + len(body) / 87 + 0.5) / (every.count(s) + 0.5))
                    total += weight * found.count(s) / (found.count(s) + 1.2 * (0.25 + 0.75 * (b - a) / 87))
            return total * (1 + 1 / np.log(87 + a))

        best = max(map(score, spans))
        if best:
            assert got in {body[a:b].strip() for a, b in spans if score((a, b)) == pytest.approx(best)}
        else:
            assert got == body[:80]


def test_marks_are_escaped():
    assert an.best_passage("a < b. The <b>deployed</b> one.", ["deploy"], 20) == "The &lt;b&gt;<mark>deployed</mark>&lt;/b&gt;"
    assert an.best_passage(None, ["x"]) == "" and an.best_passage("some & text", None) == "some &amp; text"
