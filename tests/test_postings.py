"""The written index: the same hits as from the texts, blocks left out, nothing read but the index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import postings, retrieval
from lodestar.operators.postings import Index

KIND = "doc_id {}, title string, body string, allowed array<string>, datasource string, kind string, deleted boolean, quarantined boolean"


def made(spark, seed, n, doc="long", words=40):
    rng = random.Random(seed)
    # Frequent and rare words, so that bounds differ.
    text = lambda k: " ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randrange(0, k)))
    rows = [(i if doc == "long" else f"d{i}", text(4), text(60), rng.sample(["c:a", "c:b", "u:1", "u:2"], rng.randrange(0, 3)), rng.choice(["en", "de"]), rng.choice(["x", "y"]), rng.random() < 0.1, rng.random() < 0.1) for i in range(n)]
    return spark.createDataFrame(rows, KIND.format(doc))


def asked(spark, n=15, words=40):
    rng = random.Random(9)
    return spark.createDataFrame([(i, f"u:{i % 3}", " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(1, 6)))) for i in range(n)] + [(n, "u:1", "unknown words"), (n + 1, "u:1", ""), (n + 2, "u:nobody", "w1")], "query_id long, user string, query string")


HELD = [("u:0", "c:a"), ("u:1", "c:b"), ("u:1", "u:1"), ("u:2", "u:2")]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("doc", "k"), [("long", 3), ("string", 50)])
def test_same_hits_as_from_texts(spark, tmp_path, doc, k):
    docs, searches = made(spark, 1, 600, doc), asked(spark)
    held = spark.createDataFrame(HELD, "user string, principal string")
    index = Index(spark, f"file://{tmp_path}/i", block=8, segment=200, buckets=4)
    index.update(docs)
    for h, wanted in ((held, {}), (None, {"datasource": ["de"], "kind": ["x", "z"]})):
        want = rows(retrieval.bm25(docs, searches, h, k, wanted=wanted))
        assert want and rows(retrieval.bm25(docs, searches, h, k, index=index, wanted=wanted)) == want


def test_changes_replace_entries(spark, tmp_path):
    searches = asked(spark)
    index = Index(spark, f"file://{tmp_path}/i", block=4, segment=50, buckets=3)
    now = made(spark, 2, 200)
    index.update(now, 0)
    for batch in range(1, 4):
        changed = made(spark, 10 + batch, 400).filter(F.col("doc_id") % 7 == batch)
        for _ in range(batch % 2 + 1):  # some are tried again
            index.update(changed, batch)
        now = now.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed)
    want = rows(retrieval.bm25(now, searches, None, 5))
    assert rows(index.search(searches, None, 5)) == want
    stats = {f: (r.n, round(r.avg_len, 9)) for f, r in enumerate(sorted(retrieval.field_stats(now).collect(), key=lambda r: r.field != "title"))}
    assert {f: (n, round(x, 9)) for f, (n, x) in index.stats().items()} == stats
    compact = index.compact(now, f"file://{tmp_path}/j")
    assert rows(compact.search(searches, None, 5)) == want and compact.replaced().isEmpty()
    with pytest.raises(ValueError):
        index.update(now, 2)


def test_blocks_are_left_out_and_no_text_is_read(spark, tmp_path):
    rng = random.Random(4)
    # One frequent word, rarely alone in a short text: few blocks hold a high score.
    body = lambda i: "common" if i % 97 == 0 else "common " + " ".join(f"x{rng.randrange(5)}" for _ in range(40))
    docs = spark.createDataFrame([(i, "", body(i), ["c:a"], "en", "x", False, False) for i in range(4000)], KIND.format("long"))
    searches = spark.createDataFrame([(1, "u:0", "common"), (2, "u:0", "common rare")], "query_id long, user string, query string")
    index = Index(spark, f"file://{tmp_path}/i", block=16, segment=2000)
    index.update(docs)
    scan = index.scan(searches, None, 5)
    counts = scan.filter("doc_id is null").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped")).collect()
    assert len(counts) == 2 and all(r.blocks >= 250 and r.skipped > 0.7 * r.blocks for r in counts)
    assert rows(index.search(searches, None, 5)) == rows(retrieval.bm25(docs, searches, None, 5))
    assert all(f"{tmp_path}/i/" in f for f in scan.inputFiles())


def test_bounds_hold(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", block=8, segment=100)
    index.update(made(spark, 5, 300))
    for r in index._read("blocks", postings._schema("long")).filter("field >= 0").limit(500).collect():
        for mean in (1.0, 7.5, 300.0):
            part = lambda tf, n, mean=mean: tf / (tf + 1.2 * (0.25 + 0.75 * n / mean))
            assert max(map(part, r.tf, r.len)) == pytest.approx(max(map(part, r.best_tf, r.best_len)), abs=1e-12)
        assert len(r.docs) <= 8 and list(r.docs) == sorted(r.docs)


def test_frontier():
    rng = np.random.default_rng(2)
    block, tf, length = np.sort(rng.integers(0, 6, 80)), rng.integers(1, 9, 80), rng.integers(1, 30, 80)
    got = postings._frontier(block, tf, length)
    for b in range(6):
        own = {(int(tf[i]), int(length[i])) for i in np.flatnonzero(block == b)}
        best = {x for x in own if not any(y != x and y[0] >= x[0] and y[1] <= x[1] for y in own)}
        assert {(int(tf[i]), int(length[i])) for i in got if block[i] == b} == best


def test_empty(spark, tmp_path):
    index, searches = Index(spark, f"file://{tmp_path}/i"), asked(spark)
    with pytest.raises(ValueError):
        index.search(searches, None)
    index.update(made(spark, 1, 5).limit(0))
    assert rows(index.search(searches, None)) == [] and index.stats() == {}
    index.update(made(spark, 1, 5).withColumn("title", F.lit(None).cast("string")).withColumn("body", F.lit("")))
    assert rows(index.search(searches, None)) == []


def test_users_who_see_few_documents(spark, tmp_path, monkeypatch):
    """Their documents alone are scored, others' searches walk; replaced and hidden documents stay out of both."""
    docs, searches = made(spark, 5, 300), asked(spark)
    held = spark.createDataFrame([("u:0", "c:a"), ("u:1", "c:b"), ("u:2", "u:2")], "user string, principal string")
    index = Index(spark, f"file://{tmp_path}/i", block=8, segment=100, buckets=4)
    index.update(docs.withColumn("title", F.lit("w1 w2")), 0)
    index.update(docs, 1)
    want = rows(retrieval.bm25(docs, searches, held, 5, wanted={"kind": ["x"]}))
    seen = sorted(r.n for r in retrieval.visible_counts(docs, held).collect())
    monkeypatch.setattr(postings, "MANY", 0)
    for few in (0, seen[0], seen[-1]):
        monkeypatch.setattr(postings, "NARROW", few)
        assert want and rows(index.search(searches, held, 5, {"kind": ["x"]})) == want


def test_marks_are_written_once_a_segment(spark, tmp_path):
    """Not with each block of a term: that is what moved most."""
    index = Index(spark, f"file://{tmp_path}/i", block=4, segment=50, buckets=3)
    index.update(made(spark, 2, 200), 0)
    assert spark.read.parquet(f"{tmp_path}/i/blocks/0").filter("field >= 0 and (size(marks) > 0 or size(mark) > 0)").isEmpty()
