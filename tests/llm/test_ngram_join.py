"""The join against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import ngram_join as N


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, k=4, percent=85):
    """rows (doc_id, text) to {doc_id: (n_shingles, component_id)}."""
    sets = {}
    for d, text in rows:
        w = words(text)
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        shared = collections.Counter(y for x in s for y in holders[x])
        for y, i in shared.items():
            if 100 * i >= percent * (len(s) + len(sets[y]) - i):
                a, b = find(d), find(y)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_components(df).collect()}


def near_group(seed, copies, size=60):
    """Copies of one text with a few words changed, on both sides of the limit, and texts that share a passage only."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    rows = []
    for i in range(copies):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(t[rng.randrange(3) :])))
    rows += [(copies + i, " ".join(base[:30] + [f"y{i}_{j}" for j in range(40)])) for i in range(10)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = near_group(seed, 120)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, "é à ü ö"), (8, "é à ü ö"), (9, "a b c d e f"), (10, "A b c d e f")]
    assert run(spark, rows, n=1, sig="x", part="y", text2="z") == brute(rows)
    got = run(spark, rows)
    assert got[1] == (0, 1) and got[5][1] == 4 and got[8][1] == 7 and got[10][1] == 9


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_long_text(spark):
    rng = random.Random(5)
    t = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    rows = [(1, t), (2, t + " end"), (3, t[: len(t) // 2])]
    assert run(spark, rows) == brute(rows)


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "q r s t"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.ngram_components(df).collect()), key=repr)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 1, None), (2, 0, 2)], key=repr)


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "y"), (3, "other words are here now", None), (4, None, "z")], "doc_id long, text string, extra string")
    kept = N.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4}


def test_keep_one_judges_rows_by_their_texts(spark):
    rows = [(1, "a b c d e f"), (3, "a b c d e f"), (3, "q r s t u"), (5, "one text is here"), (5, "and another one there"), (7, "x y z x y z"), (7, "x y z x y z"), (None, "a b c d e f"), (None, "only without an id"), (None, "only without an id"), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("s")).withColumn("keep", F.lit(1))
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a b c d e f"), (3, "q r s t u"), (5, "one text is here"), (5, "and another one there"), (7, "x y z x y z"), (None, "only without an id"), (8, "")], key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_long_lists_and_hot_shingles(spark, monkeypatch, seed):
    """Lists beyond LIST are searched in rounds, by blocks, and hot shingles are dealt out by set: with limits so low, all of it happens."""
    for name, value in (("LIST", 5), ("BLOCK", 4), ("HOT", 8), ("WIDER", 3)):
        monkeypatch.setattr(N, name, value)
    rows = near_group(seed, 80) + [(1000 + i, t) for i, t in near_group(seed + 10, 60, 30)]
    assert run(spark, rows) == brute(rows)


def test_links_of_a_group():
    """The search of a whole list against all pairs, with components known before."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(80, 100), replace=False), rng.integers(200, 400, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(40)]
    known = [0 if i < 6 else i for i in range(40)]
    members = [N._Member(1000 + i, known[i], True, None, None, None, s) for i, s in enumerate(sets)]
    parent = list(known)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {(a, b) for a in range(40) for b in range(a) if N.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])), 85)}
    for a, b in links:
        parent[max(find(known[a]), find(known[b]))] = min(find(known[a]), find(known[b]))
    want = [find(known[i]) for i in range(40)]
    got = N._links(members, 85)
    assert all((u - 1000, v - 1000) in links or (v - 1000, u - 1000) in links for u, v in got)
    parent = list(known)
    for u, v in got:
        a, b = find(known[u - 1000]), find(known[v - 1000])
        parent[max(a, b)] = min(a, b)
    assert [find(known[i]) for i in range(40)] == want and len(links) > 20


def test_divide_skip():
    import numpy as np

    rng = np.random.default_rng(1)
    q = np.unique(rng.integers(0, 1000, 300).astype(np.uint64))
    records = [np.unique(np.concatenate([rng.choice(q, rng.integers(1, len(q)), replace=False), rng.integers(1000, 2000, 20).astype(np.uint64)])) for _ in range(50)]
    t = N.overlap_needed(len(q), 60)
    want = [(i, len(np.intersect1d(q, r))) for i, r in enumerate(records) if len(np.intersect1d(q, r)) >= t]
    assert sorted(N.divide_skip(q, records, 60)) == want
