"""Filter audit against playing all orders; the polynomial; edges."""

import itertools
import random
import re
from fractions import Fraction

import pytest

from lodestar.llm import audit
from lodestar.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import database, difference

COLUMNS = [c.split()[0] for c in audit.SCHEMA.split(", ")]


def fails(rows):
    """Of each row the letters that it fails."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        out.append({k for k, v in tests.items() if v})
    return out


def brute(rows, labels):
    bad, out = fails(rows), []
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in (0, 1))
    for part in {s or "" for _, _, s in rows}:
        mine = [(r[0], f) for r, f in zip(rows, bad, strict=True) if (r[2] or "") == part]
        own, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for i, x in enumerate(order):
                before = [(d, f) for d, f in mine if not f & set(order[:i])]
                gone = [d for d, f in before if x in f]
                shapley[x] += len(gone)
                failing = sum(x in f for _, f in mine)
                own.append([part, "".join(order), i + 1, len(before) - len(gone), len(gone), failing - len(gone), sum(f == {x} for _, f in mine), sum(d in good for d in gone), sum(d in toxic for d in gone)])
        out += [(*o, shapley[o[1][o[2] - 1]]) for o in own]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        words = [rng.choice("abcdefghij") * rng.randrange(1, 9) + rng.choice(["", "", "X", "#", "|"] if rng.random() < 0.05 else [""]) for _ in range(rng.choice([0, 3, 150, 199, 200, 230]))]
        rows.append((i, rng.choice([" ", "\n", "\x0b", " \t"]).join(words), rng.choice(["s0", "s0", "s1", None, ""])))
    for _ in range(60):
        rows.append((rng.randrange(1000), rng.choice(rows)[1], rng.choice(["s1", "s2"])))
    return [*rows, rows[5], (None, rows[7][1], "s1"), (None, None, "s3"), (500, None, "s3"), (501, "", "s3"), (502, "É Ä" * 80, "s3")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    labels = [(d, random.Random(d).choice([0, 1, None]), d % 3 == 0 and 1 or 0) for d in range(0, 600, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, mask int")
    got = audit.audited(audit.mask_counts(docs, spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, n int")))
    merged = {}
    for d, q, t in labels:
        if d is not None:
            a, b = merged.get(d, (0, 0))
            merged[d] = max(a, q or 0), max(b, t or 0)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, [(d, *x) for d, x in merged.items()])


def test_polynomial():
    rng = random.Random(3)
    for _ in range(20):
        counts = [rng.randrange(0, 10**12) for _ in range(32)]
        p = audit.Removal(counts)
        removed = [sum(c for m, c in enumerate(counts) if m & s) for s in range(32)]
        assert [p.corner(s) for s in range(32)] == removed == p.corners().tolist()
        for i in range(5):
            total = sum(removed[b | 1 << i] - removed[b] for order in itertools.permutations(range(5)) for b in [sum(1 << x for x in order[: order.index(i)])])
            assert p.shapley(i) * 120 == total and isinstance(p.shapley(i), Fraction)
        assert sum(p.shapley(i) for i in range(5)) == removed[31]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(audit.mask_counts(docs, labels)).collect() == []
    one = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")
    rows = audit.audited(audit.mask_counts(one, labels)).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and {r.good_lost for r in rows} == {0}


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 600_000, "s"), (2, "word " * 600_000, "s")], "doc_id long, text string, source string")
    counts = {r["mask"]: r.n for r in audit.mask_counts(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert counts == {0b00010: 1, 0b10010: 1}


def test_sql(spark, sf_dir):
    assert difference(spark, database(sf_dir), QUERIES["op13_filter_audit"], ORACLE_SQL["op13_filter_audit"], sf_dir) == ""
