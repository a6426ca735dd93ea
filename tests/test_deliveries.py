"""Deliveries: claims in two phases, failures of a batch and of single deliveries, odd input."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions.scalar import signer
from lodestar.streaming import deliveries
from lodestar.streaming.deliveries import Deliveries

KIND = "key string, at_ms long, off long, body string, bad boolean"


def played(rows, ttl, fails):
    """Delivery by delivery."""
    claims, out = {}, {}
    for key, at, off, _, bad in sorted(rows, key=lambda r: (r[1], r[2])):
        if bad:
            out[off] = "forged"
        elif key is None:
            out[off] = "no key"
        elif key in claims and at < claims[key] + ttl:
            out[off] = "duplicate"
        elif fails(off):
            claims.pop(key, None)
            out[off] = "failed"
        else:
            claims[key] = at
            out[off] = "handled"
    return out


def test_against_one_by_one(spark, tmp_path):
    rng = random.Random(3)
    # A third of all are of one key.
    rows = [(rng.choice(["hot", None, *(f"k{i}" for i in range(12))] + ["hot"] * 6), off * 10, off, "b", rng.random() < 0.1) for off in range(240)]
    fails = lambda off: off % 5 == 2
    handled = []

    def handle(df, name):
        got = df.collect()
        handled.extend(r.off for r in got)
        return spark.createDataFrame([(r.key,) for r in got if fails(r.off)], "key string")

    d = Deliveries(spark, f"file://{tmp_path}/d", F.when(F.col("bad"), "forged"), handle, ttl_ms=700, buckets=2)
    for n, lo in enumerate(range(0, 240, 120)):
        d.batch(spark.createDataFrame(rows[lo : lo + 120], KIND), n)
    want = played(rows, 700, fails)
    assert {r.off: r.outcome for r in d.outcomes().collect()} == want
    assert sorted(handled) == sorted(off for off, x in want.items() if x in ("handled", "failed"))


def test_a_batch_that_fails_claims_nothing(spark, tmp_path):
    calls = []

    def handle(df, name):
        calls.append((name, sorted(r.off for r in df.collect())))
        if len(calls) == 1:
            raise OSError("the sink is away")

    d = Deliveries(spark, f"file://{tmp_path}/d", F.lit(None).cast("string"), handle, buckets=2)
    batch = spark.createDataFrame([("a", 1, 1, "", False), ("a", 2, 2, "", False), ("b", 3, 3, "", False)], KIND)
    with pytest.raises(OSError):
        d.batch(batch, 0)
    assert d.claims.read() is None
    d.batch(batch, 0)
    d.batch(spark.createDataFrame([("a", 9, 4, "", False)], KIND), 1)
    d.batch(batch.limit(0), 2)
    assert calls == [("0-0", [1, 3]), ("0-0", [1, 3])]
    assert {r.off: r.outcome for r in d.outcomes().collect()} == {1: "handled", 2: "duplicate", 3: "handled", 4: "duplicate"}


def test_nothing_is_sent_to_every_task(spark, tmp_path):
    rows = [(f"k{i % 40}", i * 10, i, "b", False) for i in range(400)]
    plans = []

    def handle(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.filter("off % 3 = 0").select("key")

    seen, cut, counted = [], deliveries.cut, deliveries.counted
    kept = lambda f: lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), f(df, name))[1]
    deliveries.cut, deliveries.counted = kept(cut), kept(counted)
    try:
        d = Deliveries(spark, f"file://{tmp_path}/d", F.lit(None).cast("string"), handle, ttl_ms=3000, buckets=2)
        d.batch(spark.createDataFrame(rows, KIND), 0)
    finally:
        deliveries.cut, deliveries.counted = cut, counted
    assert len(plans) > 1 and not any("Broadcast" in p for p in seen + plans)
    assert {r.off: r.outcome for r in d.outcomes().collect()} == played(rows, 3000, lambda off: off % 3 == 0)


def test_problems(spark):
    sign = signer("s", "v0=")
    df = spark.createDataFrame([("1000", "b", "b", 1_000_000), ("1000", "b", "c", 1_000_000), ("1000", "b", "b", 1_301_000), ("x", "b", "b", 1), (None, "b", "b", 1), ("1000", None, None, 1_000_000)], "t string, body string, signed string, at long")
    df = df.withColumn("sig", sign(F.concat(F.lit("v0:"), "t", F.lit(":"), "signed")))
    assert [r[0] for r in df.select(deliveries.event_problem("s", F.col("t"), F.col("sig"), F.col("body"), F.col("at"))).collect()] == [None, "forged", "old", "old", "forged", "forged"]
    df = spark.createDataFrame([("b", "b"), ("b", "c"), (None, None)], "body string, signed string").withColumn("sig", signer("s")(F.col("signed")))
    assert [r[0] for r in df.select(deliveries.hook_problem("s", F.col("sig"), F.col("body"))).collect()] == [None, "forged", "forged"]
    assert df.select(deliveries.hook_problem("", F.col("sig"), F.col("body")).alias("p")).filter("p is null").count() == 0
