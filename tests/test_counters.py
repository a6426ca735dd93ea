"""Counters and merging histograms against plain Python."""

import math
import random

import pytest

from lodestar.operators import counters, reports
from lodestar.streaming.sketches import Sketches


def rate(points, end, width):
    """One series' rate over the range before end."""
    own = [(t, v) for t, v in sorted(points) if end - width < t <= end]
    if len(own) < 2:
        return None
    grown = sum(b if b < a else b - a for (_, a), (_, b) in zip(own[:-1], own[1:], strict=True))
    span = own[-1][0] - own[0][0]
    mean = span / (len(own) - 1)
    a, b = own[0][0] - (end - width), end - own[-1][0]
    a, b = (mean / 2 if x >= mean * 1.1 else x for x in (a, b))
    if grown > 0:
        a = min(a, span * own[0][1] / grown)
    return grown * (span + a + b) / span / (width / 1000)


def test_rates(spark):
    rng = random.Random(1)
    samples = {}
    for name in ("a", "b", "once"):
        t, v = rng.randrange(5000), 0
        for _ in range(1 if name == "once" else 60):
            samples[name, t] = v
            t += rng.choice([700, 1000, 1300, 9000])
            v = rng.randrange(3) if rng.random() < 0.1 else v + rng.randrange(0, 40)
    df = spark.createDataFrame([(s, t, v) for (s, t), v in samples.items()], "series string, t_ms long, value long")
    got = {(r.series, r.at_ms): r.rate for r in counters.rates(df, "series", range_ms=10_000, step_ms=1000).collect()}
    points = {s: [(t, v) for (x, t), v in samples.items() if x == s] for s in ("a", "b", "once")}
    want = {(s, at): r for s, p in points.items() for at in range(0, 300_000, 1000) if (r := rate(p, at, 10_000)) is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    total = {r.series: r.total for r in counters.increase(df, "series").collect()}
    assert total == {s: sum(b if b < a else b - a for (_, a), (_, b) in zip(sorted(p)[:-1], sorted(p)[1:], strict=True)) for s, p in points.items()}
    summed = {}
    for (_, at), r in want.items():
        summed[at] = summed.get(at, 0) + r
    assert counters.peak(counters.rates(df, "series", range_ms=10_000, step_ms=1000)).first().peak == pytest.approx(max(summed.values()))
    with pytest.raises(ValueError):
        counters.rates(df, "series", range_ms=1500, step_ms=1000)


def test_sketches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([0.0, None, -rng.random() * 50, rng.lognormvariate(3, 3), 5.0, 10_000.0]), i % 4) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, v double, batch int")
    s = Sketches(spark, f"file://{tmp_path}/s", ("k",), error=0.02)
    for b in (0, 1, 1, 2, 3, 0):
        s.add(df.filter(f"batch = {b}"), "v", b)
    s.compact(1)
    s.add(df.filter("batch = 3"), "v", 3)
    want = {(r.k, r.le): r.n for r in reports.histogram(df.filter("v is not null"), "v", "k").collect()}
    assert {(r.k, r.le): r.n for r in s.histogram().collect()} == want
    for r in s.quantiles(0.0, 0.1, 0.5, 0.9, 0.99, 1.0).collect():
        own = sorted(v for k, v, _ in rows if k == r.k and v is not None)
        exact = own[max(1, math.ceil(r.q * len(own))) - 1]
        assert abs(r.value - exact) <= abs(exact) * 0.0201
    assert s.quantiles(0.5).count() == 2
