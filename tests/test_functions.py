import hashlib
import hmac

from pyspark.sql import functions as F

from lodestar import schemas
from lodestar.functions import analysis, scalar, vectors
from lodestar.operators import reports, retrieval


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_content_hash(spark):
    h = one(spark, scalar.content_hash(F.col("t"), F.col("b")), t="a", b="b")
    assert h == hashlib.sha256(b"a\0b").hexdigest()[:32]
    assert h != one(spark, scalar.content_hash(F.col("t"), F.col("b")), t="ab", b="")


def test_embed_text(spark):
    for t, b, n, want in (("Title", "body text", 8, "Title\n\nb"), ("", "", 10, " "), ("héllo wörld", "", 5, "héllo")):
        assert one(spark, scalar.embed_text(F.lit(t), F.lit(b), n)) == want


def test_slack_micros(spark):
    for ts, want in (("1700000000.000100", 1700000000000100), ("", 0), ("x", 0), ("5.5", 5500000), ("7", 7000000)):
        assert one(spark, scalar.slack_micros(F.lit(ts))) == want


def test_jira_time(spark):
    assert one(spark, scalar.epoch_ms(scalar.jira_time(F.lit("2011-07-19T21:32:10.000+0000")))) == 1311111130000
    assert one(spark, scalar.jira_time(F.lit("null"))) is None


def test_titles_and_names(spark):
    assert one(spark, scalar.message_title(F.lit("a\nb"))) == "a"
    assert one(spark, scalar.message_title(F.lit("é" * 91))) == "é" * 87 + "..."
    assert one(spark, scalar.title_case(F.lit("abc"))) == "Abc"
    assert one(spark, scalar.base36(F.lit(35))) == "z"
    assert one(spark, scalar.split_list(F.lit(" a, ,b"))) == ["a", "b"]
    assert one(spark, scalar.next_link(F.lit('<http://x/2>; rel="next", <http://x/9>; rel="last"'))) == "http://x/2"
    assert one(spark, scalar.duplicates_named(F.lit("Thanks.\n\nDuplicate of #4321\n"))) == ["4321"]
    assert one(spark, scalar.duplicates_named(F.lit("not a duplicate of #1"))) == []
    assert one(spark, scalar.is_project_key(F.lit("AB_1"))) and not one(spark, scalar.is_project_key(F.lit("a")))


def test_fnv(spark):
    assert int(one(spark, scalar.fnv1a64(F.lit("")))) == 0xCBF29CE484222325
    assert int(one(spark, scalar.fnv1a64(F.lit("a")))) == 0xAF63DC4C8601EC8C


def test_signatures(spark):
    sig = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    assert one(spark, scalar.github_verified("k", F.lit(sig), F.lit("body")))
    assert not one(spark, scalar.github_verified("", F.lit(sig), F.lit("body")))
    v0 = "v0=" + hmac.new(b"k", b"v0:100:body", hashlib.sha256).hexdigest()
    assert one(spark, scalar.slack_verified("k", F.lit("100"), F.lit(v0), F.lit("body"), F.lit(400)))
    assert not one(spark, scalar.slack_verified("k", F.lit("100"), F.lit(v0), F.lit("body"), F.lit(401)))


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))
    assert one(spark, vectors.cosine(a, b)) == 1.0
    assert one(spark, vectors.normalised(a)) == [0.6, 0.8]
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_stems():
    for w, want in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "relational": "relat", "generalization": "gener", "adjustment": "adjust", "happy": "happi", "controlling": "control"}.items():
        assert analysis.stem(w) == want, w
    assert analysis.fold("Straße café") == "Strasse cafe"


def test_english_and_snippet(spark):
    assert one(spark, analysis.english(F.lit("The Running cafés"))) == ["the", "run", "cafe"]
    s = one(spark, analysis.snippets(40)(F.lit("x <b> " * 10 + "deploys failed"), F.array(F.lit("deploy"))))
    assert "<mark>deploys</mark>" in s and "&lt;b&gt;" in s


def test_principals_and_edges(spark):
    p = lambda x: one(spark, schemas.is_principal(F.lit(x)))
    assert p("u:a") and p("g:x") and p("c:slack:C1") and not p("x:a") and not p("u:") and not p("u:a|b") and not p("")
    e = lambda s, d, v=1: one(spark, schemas.edge_problem(F.lit(s), F.lit(d), F.lit(v)))
    assert e("u:a", "g:b") is None and e("g:a", "c:b") is None
    assert e("c:a", "g:b") == "container as source" and e("g:a", "u:b") == "points at a user" and e("u:a", "g:b", 0) == "non-positive version" and e("a", "g:b") == "malformed edge"


def test_percentiles(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "v")
    assert tuple(reports.percentiles(df, "v").first()) == (50, 95, 99, 100, 100)
    assert tuple(reports.percentiles(df.filter("v = 7"), "v").first()) == (7, 7, 7, 7, 1)
    assert tuple(reports.percentiles(df.limit(0), "v").first()) == (None, None, None, None, 0)


def test_fusion(spark):
    bm = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abd")], "query_id long, doc_id string, rank int")
    kn = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("cbe")], "query_id long, doc_id string, rank int")
    got = retrieval.fuse({"bm25": bm, "knn": kn}).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["b", "a", "c", "d", "e"]
    assert got[0].ranks == {"bm25": 2, "knn": 2}
    assert retrieval.limit_of(0) == 10 and retrieval.limit_of(51) == 10 and retrieval.limit_of(7) == 7
    assert retrieval.mode_of("", "x", True) == "hybrid" and retrieval.mode_of("knn", " ", True) == "bm25" and retrieval.mode_of("knn", "x", False) == "bm25"


def test_relevance(spark):
    hits = spark.createDataFrame([("bm25", 1, d, i + 1) for i, d in enumerate([1, 5, 2, 3])], "mode string, query_id long, doc_id long, rank int").withColumn("good", F.col("doc_id").isin(2, 9))
    labels = spark.createDataFrame([(1, 1, "s", 2)], "query_id long, own long, datasource string, n_rel int")
    r = reports.relevance(reports.outcomes(hits, labels)).filter("datasource is null").first()
    assert (r.hit_at_1, r.recall_at_5, r.mrr_at_10) == (0.0, 0.5, 0.5)
