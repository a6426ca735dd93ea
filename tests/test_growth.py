"""What plans and tasks hold mustn't grow with the tables: one test for each step that did."""

import json
import re

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar.operators import fold, graph, postings, proximity, retrieval
from lodestar.operators.closure import Closure
from lodestar.plans import changelog, reports
from lodestar.plans import retrieval as retrieval_plans
from lodestar.sources import mappings
from lodestar.streaming import keyed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_within_their_row(spark):
    docs = spark.createDataFrame([(1, "b a", "a b A c a", False), (2, None, "", False), (3, "x", "y", True)], "doc_id long, title string, body string, deleted boolean")
    found = retrieval.postings(docs)
    plan = _plan(found)
    assert "Exchange" not in plan and "Aggregate" not in plan
    rows = {(r.field, r.term, r.doc_id, r.tf, r.len) for r in found.collect()}
    assert rows == {("title", "a", 1, 1, 2), ("title", "b", 1, 1, 2), ("body", "a", 1, 3, 5), ("body", "b", 1, 1, 5), ("body", "c", 1, 1, 5)}


def test_records_are_parsed_once(spark, sf_dir):
    assert _plan(changelog.dead_letters(spark, sf_dir)).count("from_json") == 1


def test_later_events_are_read_once(spark):
    plan = _plan(fold.gate(changelog.fx.doc_events(spark, "/root/testdata/sf0.001")))
    assert "unboundedfollowing" not in plan.lower()


def test_segments_are_built_from_small_batches(spark, tmp_path):
    sizes, usual, build = f"{tmp_path}/sizes", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), postings._build

    def noted(size):
        run = build(size)

        def one(batches):
            def each():
                for b in batches:
                    with open(sizes, "a") as f:
                        f.write(f"{b.num_rows}\n")
                    yield b

            yield from run(each())

        return one

    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("body"), F.lit(False).alias("deleted"), F.lit(False).alias("quarantined"))
    postings._build = noted
    try:
        postings.Index(spark, f"file://{tmp_path}/i").update(docs, 0)
    finally:
        postings._build = build
    got = [int(x) for x in open(sizes)]
    assert sum(got) == 1500 and max(got) <= postings.DOCS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual


class _Counted:
    """Links that count how often they are looked up: once a step."""

    def __init__(self, links):
        self.links, self.steps = links, 0

    def __len__(self):
        return len(self.links)

    def __getitem__(self, at):
        self.steps += 1
        return self.links[at]


def test_steps_of_a_walk_dont_grow_with_its_beam():
    v = proximity.unit(np.random.default_rng(0).normal(size=(1500, 16)))
    g = proximity.Graph.build(v)
    links = _Counted(g.layers[-1])
    ids, sims = proximity.beam(v, links, v[:10], np.zeros(10, np.int64), 1500)
    assert links.steps <= 150
    assert (np.sort(ids, 1) == np.arange(1500)).all() and (np.diff(sims, axis=1) <= 0).all()


def test_graphs_are_built_by_all_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"), F.lit(False).alias("deleted"), F.lit(False).alias("quarantined"))
    few, proximity.SMALL = proximity.SMALL, 10
    try:
        index = proximity.VectorIndex(spark, f"file://{tmp_path}/g")
        index.update(rows, 0)
        assert index.entries().select("segment").distinct().count() == 4
    finally:
        proximity.SMALL = few


class _State:
    def __init__(self):
        self.value, self.most = None, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.value, self.most = (self.value or []) + rows, max(self.most, len(rows))

    def clear(self):
        self.value = None


def test_keyed_fold_takes_rows_as_two_texts():
    fold = keyed.Fold()
    fold.document, fold.pending = _State(), _State()
    event = lambda i: Row(event=json.dumps({"off": i, "op": "upsert", "version": 1 + i, "hash": str(i)}), carried=json.dumps({"title": f"t{i}", "allowed": ["c:a"]}))
    out = list(fold.handleInputRows(("d",), iter([event(i) for i in (*range(100, 200), *range(100))]), None))
    assert [(r.id, r.version, r.title, r.allowed, r.labels, r.applied) for r in out] == [("d", 200, "t199", ["c:a"], [], 200)]
    assert fold.pending.most == keyed.HELD and fold.pending.value is None
    assert [r.duplicate for r in fold.handleInputRows(("d",), iter([event(199)]), None)] == [1]


def test_payloads_are_parsed_once_a_scan(spark, sf_dir):
    assert _plan(reports.map_projects(spark, sf_dir)).count("from_json") == 2
    assert _plan(reports.vanished_comments(spark, sf_dir)).count("from_json") == 2


def test_comments_of_an_issue_crawled_twice_stay(spark):
    raw = spark.createDataFrame([("P-1", '{"comment": {"comments": [{"id": "1"}]}}'), ("P-1", '{"comment": {"comments": [{"id": "2"}]}}'), ("P-2", "{}")], "key string, json string")
    kind = spark.createDataFrame([], mappings.JIRA_ISSUE).schema["fields"].dataType
    raw = raw.select("key", F.lit(9).cast("long").alias("now_ms"), F.from_json("json", kind).alias("fields"))
    before = spark.createDataFrame([("P-1", "1"), ("P-1", "2"), ("P-1", "3"), ("P-2", "1"), ("P-3", "1")], "key string, comment_id string")
    gone = mappings.vanished_comments(before, raw).select("doc.id").collect()
    assert sorted(r.id for r in gone) == ["jira:P-1/c3", "jira:P-1/c3", "jira:P-2/c1"]


def test_words_of_texts_are_split_row_by_row(spark, sf_dir):
    assert "ArrowEvalPython" not in _plan(retrieval_plans.standard_words(spark, sf_dir))


def test_what_everyone_holds_isnt_dealt_by_one_task(spark):
    users = spark.range(2000).select(F.concat(F.lit("u:"), F.col("id").cast("string")).alias("user"))
    both = graph._to_all(users, spark.range(3).withColumnRenamed("id", "n"))
    assert both.count() == 6000
    assert both.collect() and "Broadcast" not in _plan(both)


def test_kept_expansions_bring_no_pairs_together_again(spark, tmp_path):
    kept = Closure(spark, f"file://{tmp_path}/c", buckets=2)
    edges = [("u:a", "g:1"), ("u:a", "c:x"), ("g:1", "g:2"), ("g:2", "g:3"), ("g:3", "c:z"), ("g:everyone", "c:x"), ("g:everyone", "g:3"), ("g:everyone", "u:a")]
    kept.apply(spark.createDataFrame([(a, b, True) for a, b in edges], "src string, dst string, present boolean"), 0)
    found = kept.expansion(spark.createDataFrame([("u:a",), ("u:b",)], "user string"))
    # Aggregates by user, none by user and principal.
    keys = re.findall(r"keys?=\[([^\]]*)\]", _plan(found))
    assert keys and not [k for k in keys if "principal#" in k]
    assert {(r.user, r.principal): (r.depth, ">".join(r.path)) for r in found.collect()} == {
        ("u:a", "u:a"): (0, "u:a"), ("u:a", "g:1"): (1, "u:a>g:1"), ("u:a", "g:2"): (2, "u:a>g:1>g:2"), ("u:a", "c:x"): (1, "u:a>c:x"), ("u:a", "g:3"): (1, "g:everyone>g:3"), ("u:a", "c:z"): (2, "g:everyone>g:3>c:z"), ("u:a", "g:everyone"): (0, "g:everyone"),
        ("u:b", "u:b"): (0, "u:b"), ("u:b", "g:everyone"): (0, "g:everyone"), ("u:b", "c:x"): (1, "g:everyone>c:x"), ("u:b", "g:3"): (1, "g:everyone>g:3"), ("u:b", "c:z"): (2, "g:everyone>g:3>c:z"), ("u:b", "u:a"): (1, "g:everyone>u:a"),
    }


def test_walks_read_only_edges_that_can_be_reached(spark, monkeypatch):
    inner, usual = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: inner.append(usual(df, name).count()) or usual(df, name) if name == "inner" else usual(df, name))
    edges = [*((f"u:{i}", "g:1", True) for i in range(50)), ("g:1", "g:2", True), ("g:2", "c:x", True), ("g:3", "c:y", True)]
    found = graph.reach(spark.createDataFrame(edges, "src string, dst string, present boolean"), spark.createDataFrame([("g:1",)], "root string"))
    assert inner == [2]
    assert sorted((r.principal, r.depth) for r in found.collect()) == [("c:x", 2), ("g:1", 0), ("g:2", 1)]


DOCS = "doc_id long, title string, body string, deleted boolean, quarantined boolean, allowed array<string>, embedding array<double>"


def test_asked_words_are_counted_without_a_shuffle(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(1, "b a", "a b A c a", False, False, ["c:x"], None), (2, None, "", False, False, [], None), (3, "a", "a", True, False, [], None), (4, "z z", "b z", False, True, None, None)], DOCS)
    plans, usual = [], retrieval.cut
    monkeypatch.setattr(retrieval, "cut", lambda df, name: plans.append(_plan(df)) or usual(df, name))
    terms = spark.createDataFrame([("a",), ("b",), ("none",)], "term string")
    want = [(1, ["c:x"], [("body", "a", 3, 5), ("body", "b", 1, 5), ("title", "a", 1, 2), ("title", "b", 1, 2)]), (4, None, [("body", "b", 1, 2)])]
    for most in (retrieval.BROADCAST_TERMS, 2):
        monkeypatch.setattr(retrieval, "BROADCAST_TERMS", most)
        lists, stats = retrieval.term_lists(docs, terms, keep={"allowed": F.col("allowed")})
        assert sorted((r.doc_id, r.allowed, sorted(tuple(e) for e in r.entries)) for r in lists.collect()) == want
        assert {(r.field, r.n, r.avg_len) for r in stats.collect()} == {("title", 2, 2.0), ("body", 2, 3.5)}
    assert "Exchange" not in plans[0]
    assert "embeddings" not in _plan(retrieval_plans._inputs(spark, sf_dir, vectors=False)[0])


def test_python_gets_few_documents_at_once(spark, tmp_path, monkeypatch):
    def noted(make):
        def made(*args):
            run = make(*args)

            def one(batches):
                def each():
                    for b in batches:
                        with open(f"{tmp_path}/sizes", "a") as f:
                            f.write(f"{b.num_rows}\n")
                        yield b

                yield from run(each())

            return one

        return made

    for name in ("_count", "_weigh", "_scan"):
        monkeypatch.setattr(retrieval, name, noted(getattr(retrieval, name)))
    i = F.col("id")
    docs = spark.range(0, 3000, 1, 1).select(i.alias("doc_id"), F.lit("t").alias("title"), F.concat(F.lit("w "), i.cast("string")).alias("body"), F.lit(False).alias("deleted"), F.lit(False).alias("quarantined"), F.array(F.lit("c:x")).alias("allowed"), F.array(i + 1.0, F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([(1, "u:a", "w 7", [1.0, 1.0])], "query_id long, user string, query string, vector array<double>")
    assert [r.doc_id for r in retrieval.bm25(docs, asked, None, 2).orderBy("rank").collect()] == [7, 0]
    assert [r.doc_id for r in retrieval.knn(docs, asked, None, 2).orderBy("rank").collect()] == [0, 1]
    got = [int(x) for x in open(f"{tmp_path}/sizes")]
    assert sum(got) == 9000 and max(got) <= retrieval.ROWS


def test_searches_that_ask_one_word_are_added_up_in_parts(spark, monkeypatch):
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.lit("t w").alias("title"), F.concat(F.lit("w w "), F.repeat(F.lit("x "), (F.col("id") % 50).cast("int"))).alias("body"), F.lit(False).alias("deleted"), F.lit(False).alias("quarantined"), F.array(F.lit("c:x")).alias("allowed"))
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.lit("u:a").alias("user"), F.lit("w x t").alias("query"))
    lengths, usual = [0], np.repeat

    def repeat(*args):
        out = usual(*args)
        lengths.append(len(out))
        return out

    monkeypatch.setattr(retrieval, "SCORED", 1)
    got = sorted(map(tuple, retrieval.bm25(docs, asked, None, 300).collect()))
    entries = retrieval.term_lists(docs, spark.createDataFrame([("w",), ("x",), ("t",)], "term string"))[0].withColumn("allowed", F.lit(None).cast("array<string>"))
    queries = [Row(query_id=q, user="u:a", term=t, qtf=1) for q in range(40) for t in ("t", "w", "x")]
    weights = {(f, t): (1.0, 1.0, 300) for f in retrieval.BOOSTS for t in ("t", "w", "x")}
    run = retrieval._weigh(spark, queries, weights, {"title": 2.0, "body": 26.0}, None, 300)
    batch = entries.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(np, "repeat", repeat)
    rows = sum(b.num_rows for b in run(iter([batch])))
    assert rows == 300 * 40 == len(got)
    # At most 128 documents at once, each with two words in a field that 40 searches ask.
    assert max(lengths) <= 128 * 40
