"""State tables: versions of the schema, buckets that follow the rows."""

import os

import pytest

from lodestar.streaming import store
from lodestar.streaming.store import SchemaChange, Table


def table(spark, path, schema, **more):
    return Table(spark, f"file://{path}/t", ["id"], schema, **more)


def test_three_versions_read_as_one(spark, tmp_path):
    one = table(spark, tmp_path, "id string, n long")
    one.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long"), 0)
    two = table(spark, tmp_path, "id string, n long, tag string")
    assert sorted(map(tuple, two.read().collect())) == [("a", 1, None), ("b", 2, None)]
    two.upsert(spark.createDataFrame([("b", 3, "x")], "id string, n long, tag string"), 1)
    three = table(spark, tmp_path, "id string, n long, tag string, many array<int>")
    three.upsert(spark.createDataFrame([("c", 4, "y", [1])], "id string, n long, tag string, many array<int>"), 2)
    assert sorted(map(tuple, three.read().collect())) == [("a", 1, None, None), ("b", 3, "x", None), ("c", 4, "y", [1])]
    assert [len(v.fields) for v in three.versions()] == [2, 3, 4]
    three.compact(3)
    assert three.read().count() == 3
    # An older program may read, but no longer write.
    assert sorted(map(tuple, one.read().collect())) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(SchemaChange, match="many is missing"):
        table(spark, tmp_path, "id string, n long, tag string").upsert(spark.createDataFrame([("d", 1, "z")], "id string, n long, tag string"), 4)


def test_a_changed_type_is_refused(spark, tmp_path):
    table(spark, tmp_path, "id string, n long").upsert(spark.createDataFrame([("a", 1)], "id string, n long"), 0)
    before = sorted(os.listdir(f"{tmp_path}/t/delta"))
    for schema, row in (("id string, n string", ("a", "1")), ("id string, n int", ("a", 1)), ("id string, m long", ("a", 1))):
        with pytest.raises(SchemaChange):
            table(spark, tmp_path, schema).upsert(spark.createDataFrame([row], schema), 1)
    with pytest.raises(SchemaChange, match="key"):
        t = Table(spark, f"file://{tmp_path}/t", ["id", "part"], "id string, part string, n long")
        t.upsert(spark.createDataFrame([("a", "p", 1)], "id string, part string, n long"), 1)
    assert sorted(os.listdir(f"{tmp_path}/t/delta")) == before and len(table(spark, tmp_path, "id string, n long").versions()) == 1


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROWS", 20)
    monkeypatch.setattr(store, "TASK", 15)
    t = table(spark, tmp_path, "id long, n long", buckets=2, compact_after=3)
    rows = lambda lo, hi, n: spark.range(lo, hi).selectExpr("id", f"cast({n} as long) as n")
    for batch in range(7):
        changed = rows(batch * 60, batch * 60 + 120, batch)
        for _ in range(2 if batch in (2, 4) else 1):  # with and without compaction in between
            assert (t.read(batch, t.touched(changed, batch)) is None) == (batch == 0)
            t.upsert(changed, batch)
    want = {i: min(6, i // 60) for i in range(480)}
    assert dict(map(tuple, t.read().collect())) == want
    assert t._count(t._base()) == 32  # 480 rows, 20 in a bucket
    few = rows(5, 8, 0)
    buckets = t.touched(few)
    assert len(buckets) <= 3
    assert {i: n for i, n in want.items() if 5 <= i < 8}.items() <= dict(map(tuple, t.read(buckets=buckets).collect())).items()
    assert t.read(buckets=buckets).count() < 120
    t.vacuum()
    assert dict(map(tuple, t.read().collect())) == want
