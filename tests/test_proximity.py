"""Vector graphs: the walk's recall with and without permissions, changes, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import proximity, retrieval
from lodestar.operators.proximity import Graph, VectorIndex

KIND = "doc_id long, embedding array<float>, allowed array<string>, datasource string, deleted boolean, quarantined boolean"


def clustered(seed, n, d=24):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(8, d))
    return centres[rng.integers(0, 8, n)] + 0.6 * rng.normal(size=(n, d))


def made(spark, seed, n):
    rows = [(i, [float(x) for x in v], [f"c:{i % 5}"], f"s{i % 3}", i % 11 == 0, i % 13 == 0) for i, v in enumerate(clustered(seed, n))]
    return spark.createDataFrame(rows, KIND)


def asked(spark, n=20):
    rows = [(i, f"u:{i % 2}", v.tolist()) for i, v in enumerate(clustered(77, n))]
    return spark.createDataFrame([*rows, (90, "u:0", None), (91, "u:0", [0.0] * 24), (92, "u:0", [1.0, 2.0]), (93, "u:none", rows[0][2])], "query_id long, user string, vector array<double>")


def found(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_walk_finds_nearly_all():
    v, q = proximity.unit(clustered(1, 3000)), proximity.unit(clustered(2, 100))
    g = Graph.build(v)
    assert [len(x) for x in g.layers] == Graph.sizes(3000) and all((x < len(x)).all() for x in g.layers)
    exact = np.argsort(-(q @ v.T), axis=1)[:, :20]
    got = g.search(q, 64)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got[:, :20].tolist(), exact.tolist(), strict=True)]) >= 0.97 * 20
    # The nearest come first, none twice.
    s = np.take_along_axis(q @ v.T, got, 1)
    assert (np.diff(s, axis=1) <= 1e-5).all() and all(len(set(r)) == len(r) for r in got.tolist())


@pytest.mark.parametrize("n", [0, 1, 2, 33, 100])
def test_small_graphs(n):
    v = proximity.unit(clustered(3, n)) if n else np.zeros((0, 24), np.float32)
    if n:
        got = Graph.build(v).search(v, n)
        assert (np.sort(got, 1) == np.arange(n)).all()


def test_equal_vectors():
    v = np.concatenate([np.tile(proximity.unit(clustered(4, 1)), (500, 1)), proximity.unit(clustered(5, 200))])
    got = Graph.build(np.random.default_rng(1).permutation(v)).search(v[-5:], 64)
    assert (got >= 0).all()


def test_recall_with_permissions(spark, tmp_path):
    docs, searches = made(spark, 1, 1500), asked(spark).filter("query_id <> 92")
    held = spark.createDataFrame([("u:0", "c:1"), ("u:0", "c:2"), ("u:1", "c:4")], "user string, principal string")
    index = VectorIndex(spark, f"file://{tmp_path}/g", segment=800)
    index.update(docs)
    for h, wanted in ((None, None), (held, None), (held, {"datasource": ["s1"]})):
        want = found(retrieval.knn(docs, searches, h, 10, wanted))
        got = found(index.search(searches, h, 10, wanted, scan=False))
        assert len(want) > 50 and len(want & got) >= 0.95 * len(want)
        assert found(retrieval.knn(docs, searches, h, 10, wanted, index)) >= want if h is not None else True
        assert found(got_all := index.search(searches, h, 10, wanted)) and got_all.columns == ["query_id", "doc_id", "score", "rank"]


def test_changes(spark, tmp_path):
    searches, docs = asked(spark), made(spark, 1, 300)
    index = VectorIndex(spark, f"file://{tmp_path}/g")
    with pytest.raises(ValueError):
        index.search(searches, None)
    index.update(docs.limit(0), 0)
    assert found(index.search(searches, None)) == set()
    index.update(docs, 1)
    changed = made(spark, 2, 300).filter("doc_id % 4 = 1").withColumn("deleted", F.col("doc_id") % 8 == 1)
    index.update(changed, 2)
    index.update(changed, 2)
    odd = spark.createDataFrame([(0, [1.0, None] + [0.0] * 22, [], "s0", False, False), (3, [1.0], [], "s0", False, False), (6, [], [], "s0", False, False), (9, None, [], "s0", False, False), (12, [0.5] * 24, [], "s0", False, False), (15, [0.25] * 24, [], "s0", False, False)], KIND)
    index.update(odd, 3)
    now = docs.join(changed.unionByName(odd).select("doc_id"), "doc_id", "left_anti").unionByName(changed).unionByName(odd)
    want = sorted(map(tuple, retrieval.knn(now, searches.filter("query_id <> 92"), None, 12).collect()))
    assert sorted(map(tuple, index.search(searches, None, 12).collect())) == want
