"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann


def search(spark, rows, every=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("list", F.lit(1))
    return ann.search(df, F.pmod(F.col("vec_id"), F.lit(every)) == 0).collect()


def test_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[::3] *= 2
    got: dict = {}
    for r in search(spark, [(i, v.tolist()) for i, v in enumerate(x)]):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d = x.astype(np.float64)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        s = d @ d[q]
        assert all(abs(f[2] - s[f[1]]) < 1e-9 for f in found) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        s[q] = -np.inf
        hit += len({f[1] for f in found} & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 150 and hit / (20 * 150) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (20, [float("inf"), 0.0]), (40, [0.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search(spark, rows))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 40, 0.0), (40, 1, 1, 0.5), (40, 2, 2, 0.5), (40, 3, 0, 0.0)]


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(3, None)]])
def test_nothing_to_find(spark, rows):
    assert search(spark, rows) == []
