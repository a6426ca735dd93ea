import pytest

from lodestar.operators import graph

KIND = "src string, dst string, present boolean, version long, src_ts_ms long, off long"


def edges(spark, *rows):
    return spark.createDataFrame([(s, d, p, v, 0, i) for i, (s, d, p, v) in enumerate(rows)], KIND)


NEST = [("u:alice", "g:platform", True, 1), ("g:platform", "g:eng", True, 1), ("g:eng", "c:code", True, 1), ("g:everyone", "c:general", True, 1)]


def users(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "user string")


def held(spark, e, user):
    return {r.principal for r in graph.expand(e, users(spark, user)).collect()}


def test_nesting_and_paths(spark):
    e = graph.latest(edges(spark, *NEST))
    x = graph.expand(e, users(spark, "u:alice", "u:bob")).cache()
    assert {r.principal for r in x.filter("user = 'u:alice'").collect()} == {"u:alice", "g:everyone", "g:platform", "g:eng", "c:code", "c:general"}
    assert {r.principal for r in x.filter("user = 'u:bob'").collect()} == {"u:bob", "g:everyone", "c:general"}
    assert graph.path_to(x, "u:alice", "c:code").first().path == ["u:alice", "g:platform", "g:eng", "c:code"]
    assert graph.path_to(x, "u:alice", "c:general").first().path == ["g:everyone", "c:general"]
    assert graph.path_to(x, "u:bob", "c:code").count() == 0


def test_revoke_and_late_grant(spark):
    e = graph.latest(edges(spark, *NEST, ("u:alice", "g:platform", False, 3), ("u:alice", "g:platform", True, 2)))
    assert "g:eng" not in held(spark, e, "u:alice")


def test_first_of_equal_versions_wins(spark):
    assert graph.latest(edges(spark, ("u:a", "g:b", True, 5), ("u:a", "g:b", False, 5))).first().present


def test_epoch_counts_applied_changes(spark):
    e = edges(spark, ("u:a", "g:b", True, 1), ("u:a", "g:b", True, 1), ("u:a", "g:b", False, 2), ("u:a", "g:b", True, 1), ("u:c", "g:b", True, 1))
    assert graph.epoch(e).first().epoch == 3


def test_cycle_ends(spark):
    e = graph.latest(edges(spark, ("u:a", "g:x", True, 1), ("g:x", "g:y", True, 1), ("g:y", "g:x", True, 1), ("g:y", "c:z", True, 1)))
    assert held(spark, e, "u:a") == {"u:a", "g:everyone", "g:x", "g:y", "c:z"}


def test_too_deep(spark):
    chain = [("u:a", "g:1", True, 1)] + [(f"g:{i}", f"g:{i + 1}", True, 1) for i in range(1, 9)]
    with pytest.raises(graph.TooDeep):
        graph.expand(graph.latest(edges(spark, *chain)), users(spark, "u:a")).count()
    ok = held(spark, graph.latest(edges(spark, *chain[:-1])), "u:a")
    assert "g:8" in ok
    t = {r.principal for r in graph.truth(graph.latest(edges(spark, *chain)), users(spark, "u:a")).collect()}
    assert "g:9" in t


def test_containers_end_walks_but_truth_goes_on(spark):
    e = graph.latest(edges(spark, ("u:a", "c:x", True, 1), ("c:x", "g:y", True, 1)))
    assert "g:y" not in held(spark, e, "u:a")
    assert "g:y" in {r.principal for r in graph.truth(e, users(spark, "u:a")).collect()}


def test_reconcile(spark):
    e = graph.latest(edges(spark, ("u:a", "c:x", True, 1), ("u:b", "c:x", True, 1), ("g:t", "c:x", True, 1), ("u:z", "c:y", True, 1)))
    want = spark.createDataFrame([("u:b", "c:x"), ("u:c", "c:x")], "src string, dst string")
    assert {tuple(r) for r in graph.reconcile(want, e).collect()} == {("u:a", "c:x", False), ("u:c", "c:x", True)}


def test_outbox(spark):
    e = spark.createDataFrame([("u:a", "g:x", 1, False), ("u:b", "g:x", 2, False), ("u:c", "g:x", 3, True)], "src string, dst string, version long, published boolean")
    first = graph.pending(e, 1)
    assert [r.src for r in first.collect()] == ["u:a"]
    assert [r.src for r in graph.pending(graph.published(e, first)).collect()] == ["u:b"]
    v = graph.versioned(e.select("src", "dst"), last=100, now_ns=50).select("version").collect()
    assert len({r.version for r in v}) == 3 and min(r.version for r in v) > 100
