"""Language ID: counts, backoff and predictions against plain Python; edges."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, language
from lodestar.llm.queries import QUERIES

SYLLABLES = {"aa": ["th", "er", "on", "ing", "sh"], "bb": ["lle", "éa", "ou", "ment", "è"], "cc": ["ció", "ña", "os", "que", "ll"]}


def made(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 40))]
        out.append((i, rng.choice([" ", "\n", ", ", " 12 "]).join(words).title(), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def letters(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain(rows, lexicon, grams, longest):
    """A function of a text to the logarithms by language, from dictionaries."""
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for w in letters(text):
            counts[w][lang] += 1
    totals = Counter()
    for c in counts.values():
        totals.update(c)
    runs = {n: defaultdict(Counter) for n in range(1, longest + 1)}
    for w, c in counts.items():
        for n in runs:
            padded = w if n == 1 else f" {w} "
            for i in range(len(padded) - n + 1):
                for lang, x in c.items():
                    runs[n][padded[i : i + n]][lang] += x

    def table(found, most):
        whole = Counter()
        for c in found.values():
            whole.update(c)
        least = -(math.log(max(whole.values())) + 1)
        place = {w: math.floor(math.log2(max(v / whole[k] for k, v in c.items())) * language.STEPS) for w, c in found.items()}
        # Whole steps of the scale, as many as hold at most `most`.
        kept, n = set(), 0
        for p in sorted(set(place.values()), reverse=True):
            own = {w for w in place if place[w] == p}
            if n + len(own) > most:
                break
            kept |= own
            n += len(own)
        return {w: {k: math.log(c[k] / whole[k]) if k in c else least for k in totals} for w, c in found.items() if w in kept}

    words = table(counts, lexicon)
    assert 0 < len(words) <= lexicon and (len(words) == len(counts) or lexicon < len(counts))
    tables = {n: table(r, grams) for n, r in runs.items()}

    def score(text):
        out = {k: math.log(v / sum(totals.values())) for k, v in totals.items()}
        for w in letters(text):
            if w in words:
                own = [words[w]]
            else:
                for n in range(longest, 0, -1):
                    padded = w if n == 1 else f" {w} "
                    own = [tables[n][padded[i : i + n]] for i in range(len(padded) - n + 1) if padded[i : i + n] in tables[n]]
                    if own:
                        break
            for k in out:
                out[k] += sum(x[k] for x in own) / len(own) if own else 0
        return out

    return score


@pytest.mark.parametrize("lexicon", [60, 10_000])
def test_against_plain(spark, lexicon):
    rows = made(1, 200)
    model = language.train(frame(spark, rows), lexicon=lexicon)
    score = plain(rows, lexicon, 10**9, language.LONGEST)
    asked = [t for _, t, _ in made(2, 60)] + ["therzz lleou", "zzz", "queing quethou ßx", "x" * 300]
    langs, p = model.predict(pa.array(asked))
    for text, lang, mine in zip(asked, langs, p, strict=True):
        want = score(text)
        assert want[lang] == pytest.approx(max(want.values()), abs=1e-3)
        assert mine == pytest.approx(1 / sum(math.exp(v - max(want.values())) for v in want.values()), abs=1e-3)


def test_learns_all_words(spark):
    rows = made(3, 300)
    got = {(r.lang, r.word): r.n for r in language.word_counts(frame(spark, rows)).collect()}
    want = Counter((lang, w) for _, t, lang in rows for w in letters(t))
    assert got == want


def test_edges(spark):
    rows = made(4, 50) + [(None, "ther", "aa"), (99, None, "aa"), (100, "", "bb"), (101, "12 + 3", "cc"), (102, "theron", None)]
    docs = frame(spark, rows).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)).withColumn("n", F.lit(2))
    model = language.train(language.training(docs))
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "lang", "n", "lang_pred", "score"}
    assert [(out[i].lang_pred, out[i].score) for i in (99, 100, 101)] == [("und", 0.0)] * 3
    assert out[102].lang_pred == "aa" and 0 < out[102].score <= 1
    assert language.training(docs).filter("doc_id is null or lang is null").isEmpty()
    # Nothing to learn from, and nothing to predict.
    none = language.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, none).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), model).collect() == []
    one = language.train(docs.filter("lang = 'bb'"))
    assert {r.lang_pred for r in language.predict(docs, one).collect()} == {"bb", "und"}


def test_long_text_as_a_whole(spark, monkeypatch):
    rows = made(5, 40)
    model = language.train(frame(spark, rows))
    text = " ".join(t for _, t, _ in rows)
    whole = model.predict(pa.array(["a", text, None, text + " é"]))
    monkeypatch.setattr(language, "PIECE", 400)
    cut = model.predict(pa.array(["a", text, None, text + " é"]))
    assert whole[0] == cut[0] and whole[1] == pytest.approx(cut[1])


def test_equal_scores_go_to_the_first_language(spark):
    docs = frame(spark, [(1, "same words", "zz"), (2, "same words", "aa")])
    langs, _ = language.train(docs).predict(pa.array(["same", "other"]))
    assert langs == ["aa", "aa"]


def test_held_out_accuracy(spark, sf_dir):
    got = QUERIES["op11_language_id"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(common.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(common.held_out(r.doc_id) for r in rows)
