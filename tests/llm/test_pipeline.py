"""The pipeline on a small fixture: each stage's decisions take effect, clean documents stay."""

import random

import corpus_pipeline
from lodestar.llm import common, ngram_join
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["an", "re", "ti", "on", "es", "th"]) for _ in range(rng.randrange(1, 4))) + str(rng.randrange(40))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    item = text(40)
    docs = [(i, text(60)) for i in range(200)] + [(1000 + i, "|| ## 99 00 || ## " * 20 + str(i)) for i in range(200)]
    docs += [(2000, docs[3][1]), (2001, docs[4][1] + " end"), (2002, text(10) + " " + item + " " + text(10)), (2003, text(40) + " password: hunter2222 " + text(20)), (2004, None)]
    labels = [(i, 1) for i in range(200)] + [(1000 + i, 0) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).withColumn("predicted", F.lit("own")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs_.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs_ = common.saved(stage(spark, docs_, str(tmp_path)), name)
        seen[name] = {r.doc_id for r in docs_.select("doc_id").collect()}
        if name == "secrets":
            assert "[SECRET]" in docs_.filter("doc_id = 2003").first().text and {r.predicted for r in docs_.collect()} == {"own"}
        if name != "encoding":
            assert docs_.columns == columns
    assert len(seen["quality"] & set(range(200))) >= 198 and not seen["quality"] & set(range(1000, 1200))
    assert 2000 not in seen["near_duplicates"] and 2001 not in seen["near_duplicates"] and {3, 4} <= seen["near_duplicates"]
    assert seen["near_duplicates"] - seen["decontamination"] == {2002}
    assert seen["encoding"] == seen["secrets"] == seen["decontamination"]
    assert docs_.filter("octet_length(ids) <> 2 * n_tokens").count() == 0


def test_near_duplicates_take_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(50)]
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    # One word changed in the middle: five-word similarity 41/51, four-word 43/51; two of them: five-word 36/56.
    docs = spark.createDataFrame([(1, changed()), (2, changed(25)), (3, changed(15, 35))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()} == {1, 3}
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {1, 2, 3}


def test_stages_on_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing and missing columns, and empty tables pass through every stage."""
    schema = "doc_id long, text string"
    rows = [(1, None), (2, ""), (None, "no number here at all"), (3, "some words of a text"), (3, "some words of a text"), (3, "quite another text here")]
    spark.createDataFrame([(1, "an item that nobody holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part, n in (([], 0), (rows, 5)):
        docs = spark.createDataFrame(part, schema).withColumn("sig", F.lit("s")).withColumn("score", F.lit(1)).withColumn("part", F.lit("p"))
        for name, stage in corpus_pipeline.STAGES:
            out = common.saved(stage(spark, docs, str(tmp_path)), name)
            assert name == "encoding" or out.columns == docs.columns
            docs = out
        assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.count() == n


def test_stages_against_brute_force(spark, tmp_path):
    """Near copies and benchmark passages against plain comparison of all pairs."""
    from tests.llm.test_ngram_join import brute, near_group
    from tests.llm.test_text_operators import brute_leaks

    rows = near_group(21, 60) + [(500 + i, t) for i, t in near_group(22, 20, 45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()}
    assert kept == {c for _, c in brute(rows, 5, 80).values()}
    items = [(i, " ".join(t.split()[5:45])) for i, t in rows[:3]]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stay = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    leaks = {d: max(v for (x, _), v in brute_leaks(rows, items).items() if x == d) for d, _ in brute_leaks(rows, items)}
    # The fingerprints' radius may miss what is just similar enough, never what is alike, and nothing else goes.
    assert {d for d, _ in rows} - set(leaks) <= stay and not stay & {d for d, v in leaks.items() if v >= 0.95}
