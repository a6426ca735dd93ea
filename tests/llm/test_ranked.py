"""Ranked lexical search against brute force; edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ranked
from lodestar.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import database, difference

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, total = len(found), sum(x[2] for x in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for i, t in items:
        if i is not None and terms(t):
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        hits = []
        for d, c, size in found:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0 and d is not None:
                hits.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("term", F.lit("y"))


def texts(rng, n, words):
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"terms": 5}, {"group": 3}])
def test_against_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(ranked, "SHARD", 16)
    rng = random.Random(len(limits) + 1)
    words = [rng.choice("abcdeé") * rng.randrange(1, 4) + rng.choice(["", "X", "7", "Ä", "-", "_b"]) for _ in range(60)]
    docs = texts(rng, 150, words) + [(3, "repeated a"), (3, "repeated a"), (None, "a aa aaa"), (900, None), (901, ""), (902, "-- ++")]
    items = texts(rng, 12, words) + [(4, "more a for four"), (20, None), (21, ""), (None, "a"), (22, "unknownword"), (23, "repeated")]
    got = ranked.ranked(*frames(spark, docs, items), k=7, **limits)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 7)


def test_ties_and_few(spark):
    docs = [(i, "same text") for i in range(40, 0, -1)] + [(100, "other"), (-5, "same text")]
    got = ranked.ranked(*frames(spark, docs, [(1, "same"), (2, "other nothing")]))
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id").collect())) == [(1, r + 1, d) for r, d in enumerate([-5, *range(1, 10)])] + [(2, 1, 100)]


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert ranked.ranked(docs.limit(0), items).collect() == []
    assert ranked.ranked(docs, items.limit(0)).collect() == []
    assert [f.dataType.simpleString() for f in ranked.ranked(docs, items).schema] == ["bigint", "int", "bigint", "bigint"]


def test_very_long_text(spark):
    docs = [(1, "needle " + "hay " * 300_000 + "needle"), (2, "needle hay"), (3, "x" * 2_000_000)]
    items = [(1, "needle"), (2, "x" * 2_000_000)]
    assert sorted(map(tuple, ranked.ranked(*frames(spark, docs, items)).collect())) == brute(docs, items, 10)


def test_selected():
    rng = np.random.default_rng(1)
    for _ in range(200):
        score, ids = rng.integers(0, 6, 40), rng.permutation(40)
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if s > 0)[:9]
        top = ranked.selected(score, ids, 9)
        assert list(zip((-score[top]).tolist(), ids[top].tolist(), strict=True)) == want


def test_sql(spark, sf_dir):
    assert difference(spark, database(sf_dir), QUERIES["op12_ranked_search"], ORACLE_SQL["op12_ranked_search"], sf_dir) == ""
