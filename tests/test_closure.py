"""Kept expansions against expansions from scratch, batch by batch."""

import random

import pytest

from lodestar.operators import graph
from lodestar.operators.closure import Closure

EDGE = "src string, dst string, present boolean, version long, src_ts_ms long"


def frame(spark, edges):
    return spark.createDataFrame([(a, b, p, 1, 0) for (a, b), p in edges.items()], EDGE)


def rows(df):
    return sorted((r.user, r.principal, r.depth, tuple(r.path)) for r in df.collect())


def test_random_batches(spark, tmp_path):
    rng = random.Random(5)
    users, groups, things = [f"u:{i}" for i in range(8)], ["g:everyone", *(f"g:{i}" for i in range(7))], [f"c:{i}" for i in range(5)]
    kept, edges = Closure(spark, f"file://{tmp_path}/c", buckets=4), {}
    all_users = spark.createDataFrame([(u,) for u in [*users, "u:new"]], "user string")
    before = None
    for batch in range(6):
        changed = {}
        for _ in range(rng.choice([1, 3, 12])):
            src = rng.choice(users + groups * 2)
            dst = rng.choice([g for g in groups if g != src] + things)
            # Often an edge that is there goes; cycles come and go.
            if edges and rng.random() < 0.4:
                src, dst = rng.choice(sorted(edges))
            changed[src, dst] = rng.random() < 0.6
        edges |= changed
        kept.apply(frame(spark, changed), batch)
        if batch == 3:
            kept.apply(frame(spark, changed), batch)  # done again
        if batch % 2:
            assert rows(kept.expansion(all_users)) == rows(graph.expand(frame(spark, edges), all_users))
        if batch == 3:
            before = rows(kept.expansion(all_users))
    assert rows(kept.expansion(all_users, batch=3)) == before
    assert rows(kept.expansion(all_users.filter("user = 'u:3'"))) == [r for r in rows(kept.expansion(all_users)) if r[0] == "u:3"]


def test_only_what_a_batch_touches(spark, tmp_path):
    kept = Closure(spark, f"file://{tmp_path}/c", buckets=4)
    edges = {("u:a", "g:1"): True, ("u:b", "g:2"): True, ("g:1", "g:3"): True, ("g:2", "c:x"): True, ("g:3", "c:y"): True}
    assert kept.apply(frame(spark, edges), 0) == {"groups": 3, "users": 2}
    assert kept.apply(frame(spark, {("g:3", "c:z"): True}), 1) == {"groups": 2, "users": 1}
    assert kept.apply(frame(spark, {("u:b", "c:own"): True}), 2) == {"groups": 0, "users": 1}
    assert kept.apply(frame(spark, {("u:b", "c:own"): True, ("g:9", "c:x"): False}), 3) == {"groups": 0, "users": 0}
    delta = kept.users.delta(1).collect()
    assert [(r.user, r.principal, r.present) for r in delta] == [("u:a", "c:z", True)]


def test_too_deep(spark, tmp_path):
    kept = Closure(spark, f"file://{tmp_path}/c", steps=2, buckets=2)
    kept.apply(frame(spark, {("u:a", "g:1"): True, ("g:1", "g:2"): True, ("g:2", "g:3"): True}), 0)
    users = spark.createDataFrame([("u:a",)], "user string")
    with pytest.raises(graph.TooDeep):
        kept.expansion(users)
    assert ("u:a", "g:2") in {r[:2] for r in rows(kept.expansion(users, strict=False))}
