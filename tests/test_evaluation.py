"""Relevance metrics on odd labels, held against their SQL."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators import retrieval
from lodestar.plans import queries as plans
from tests.compare import TABLES, database, difference


def folder(spark, sf_dir, to, **changed):
    """The tables of sf_dir, some of them changed."""
    for t in TABLES:
        if t in changed:
            changed[t](spark.read.parquet(f"{sf_dir}/{t}.parquet")).toPandas().to_parquet(f"{to}/{t}.parquet")
        else:
            os.symlink(f"{sf_dir}/{t}.parquet", f"{to}/{t}.parquet")
    return str(to)


@pytest.mark.parametrize("name", ["q_eval_sampled", "q_eval_lift"])
def test_no_label_has_a_vector(spark, sf_dir, tmp_path, name):
    d = folder(spark, sf_dir, tmp_path, embeddings=lambda e: e.withColumn("vec_id", F.col("vec_id") + 1_000_000))
    assert difference(spark, database(d), plans.QUERIES[name], plans.ORACLE_SQL[name], d) == ""


def copied(d):
    """Each document three times, and once with the same beginning and another end."""
    more = [d.withColumn("doc_id", F.col("doc_id") + 1000 * n) for n in (1, 2)]
    more.append(d.withColumn("doc_id", F.col("doc_id") + 3000).withColumn("text", F.concat("text", F.lit(" and another end"))).filter("doc_id % 3 > 0"))
    return d.unionByName(more[0]).unionByName(more[1]).unionByName(more[2]).unionByName(more[2].withColumn("doc_id", F.col("doc_id") + 1000))


@pytest.mark.parametrize("name", ["q_eval_metrics", "q_eval_lift"])
def test_titles_ask_no_further_than_their_relevant_documents(spark, sf_dir, tmp_path, monkeypatch, name):
    """No title is searched to the full depth, but in the part of the documents that bounds those of labels with vectors; the results stay those of SQL."""
    vectors = lambda e: e.unionByName(e.filter("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1000))
    d = folder(spark, sf_dir, tmp_path, documents=copied, embeddings=vectors)
    last, bounded, usual = [], [], retrieval._weigh

    def noted(spark, queries, *args):
        last[:] = [*last, *(r.query_id for r in queries if hasattr(r, "least"))]
        bounded.extend(r.query_id for r in queries if getattr(r, "least", None) is not None)
        return usual(spark, queries, *args)

    monkeypatch.setattr(retrieval, "_weigh", noted)
    assert difference(spark, database(d), plans.QUERIES[name], plans.ORACLE_SQL[name], d) == ""
    assert len(set(bounded)) > 50 and set(last) == set(bounded)


def test_equal_vectors_are_searched_once(spark, sf_dir, tmp_path, monkeypatch):
    vectors = lambda e: e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 1000)).unionByName(e.withColumn("vec_id", F.col("vec_id") + 2000))
    d = folder(spark, sf_dir, tmp_path, documents=copied, embeddings=vectors)
    asked, usual = [], retrieval._scan
    monkeypatch.setattr(retrieval, "_scan", lambda spark, rows, *args: asked.extend(tuple(r.vector) for r in rows) or usual(spark, rows, *args))
    assert difference(spark, database(d), plans.QUERIES["q_eval_metrics"], plans.ORACLE_SQL["q_eval_metrics"], d) == ""
    assert asked and len(asked) == len(set(asked))
