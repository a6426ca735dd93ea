import json

import pytest
from pyspark.sql import functions as F

from lodestar.engine import Engine
from lodestar.operators import graph
from lodestar.schemas import STATE
from lodestar.session import scratch
from lodestar.sources import decode, directory, dumps, mappings, rest
from lodestar.streaming import pipelines
from lodestar.streaming.store import Table

DOC = {"id": "d1", "datasource": "slack", "container": "slack:C1", "kind": "message", "title": "t", "body": "b", "allowed": ["c:slack:C1"]}


def event(id_="d1", op="upsert", version=1, src=1, **doc):
    return json.dumps({"op": op, "doc": DOC | {"id": id_} | doc, "version": version, "src_ts_ms": src, "emit_ts_ms": 2, "mode": "live"})


def records(spark, *rows):
    return spark.createDataFrame([(k, v, "documents", 0, i, ts) for i, (k, v, ts) in enumerate(rows)], "key string, value string, topic string, partition int, offset long, ts_ms long")


def test_decode(spark):
    r = decode.decode_docs(records(spark, ("d1", event(), 0), ("d1", None, 0), ("d1", "{", 0), ("other", event(), 0), ("d1", event(version=0), 0), ("d1", event(allowed=["bad"]), 0), ("d1", event(op="delete", datasource=""), 0)))
    assert [(x.kind, x.problem) for x in r.orderBy("offset").collect()] == [("event", None), ("skip", None), ("poison", "unreadable"), ("poison", "key is not the doc id"), ("poison", "non-positive version"), ("poison", "malformed principal"), ("event", None)]
    d = decode.dead_letters(r).collect()
    assert len(d) == 4 and d[0].topic == "documents.dlq" and d[0].headers["dlq-source-offset"] == "2"


def test_quarantine_sequence(spark):
    docs = pipelines.Documents(spark, scratch(spark, "q"), now_ms=lambda: 9)
    docs.batch(records(spark, ("d1", event(version=100, src=100), 0)), 0)
    docs.batch(records(spark, ("d1", "{", 500)), 1)
    docs.batch(records(spark, ("d1", event(version=200, src=200), 600)), 2)
    r = docs.read().first()
    assert (r.version, r.quarantined, r.quarantined_at_ms) == (200, True, 500)
    for _ in range(2):  # a batch that is done again changes nothing
        docs.batch(records(spark, ("d1", event(version=600, src=600), 700)), 3)
    r = docs.read().first()
    assert (r.version, r.quarantined, docs.read().count()) == (600, False, 1)
    assert {x.what: x.n for x in docs.metrics().collect()} == {"applied": 3, "quarantine": 1}
    assert docs.dead_letters().count() == 1


def test_dead_letters_come_first(spark, monkeypatch):
    docs = pipelines.Documents(spark, scratch(spark, "f"))
    monkeypatch.setattr(pipelines, "retry", lambda action: (_ for _ in ()).throw(IOError("full")))
    with pytest.raises(IOError):
        docs.batch(records(spark, ("d1", event(), 0)), 0)
    assert docs.state.read() is None


def test_table_compacts(spark):
    t = Table(spark, scratch(spark, "t"), ["k"], "k string, v long", compact_after=3)
    assert t.read() is None
    for i in range(5):
        t.upsert(spark.createDataFrame([("a", i), (f"b{i}", i)], "k string, v long"), i)
    assert {(r.k, r.v) for r in t.read().collect()} == {("a", 4), ("b0", 0), ("b1", 1), ("b2", 2), ("b3", 3), ("b4", 4)}
    assert {r.k: r.v for r in t.read(before=4).collect()}["a"] == 3
    t.vacuum()
    assert {r.k: r.v for r in t.read().collect()}["a"] == 4


def test_retry():
    calls, waits = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise IOError

    pipelines.retry(action, sleep=waits.append)
    assert waits == [0.1, 0.2]


def test_dedup(spark):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:30:00"), ("a", 3, "2024-01-01 01:00:01"), ("b", 4, "2024-01-01 00:00:00"), ("b", 5, "2024-01-01 00:00:00")], "k string, i long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.i for r in pipelines.deduplicated_batch(rows, "k", "ts", "i", 3600).collect()} == {1, 3, 4}


def test_dedup_stream(spark):
    path = scratch(spark, "dedup")
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:00:00")], "k string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{path}/in")
    s = pipelines.deduplicated(spark.readStream.schema("k string, ts timestamp").parquet(f"{path}/in"), "k", "ts", "1 hour")
    s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{path}/out").count() == 2


def test_dumps(spark):
    path = scratch(spark, "dump")
    e = decode.decode_docs(records(spark, ("d1", event(), 0), ("d2", event("d2", version=3), 0))).select("e.op", "e.doc", "e.version", "e.src_ts_ms", "e.emit_ts_ms", "e.mode")
    dumps.write_dump(e, path)
    assert {(r.doc.id, r.version) for r in dumps.read_dump(spark, path).collect()} == {("d1", 1), ("d2", 3)}
    spark.createDataFrame([("{bad",)], "value string").write.mode("append").text(path)
    assert dumps.read_dump(spark, path, strict=False).filter("op is not null").count() == 2
    with pytest.raises(Exception):
        dumps.read_dump(spark, path).collect()


def test_hooks(spark):
    issue = {"number": 7, "title": "T", "body": "B", "state": "open", "html_url": "h", "user": {"login": "me"}, "labels": [{"name": "bug"}], "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z"}
    comment = {"id": 5, "body": "Duplicate of #9\nduplicate of #7", "html_url": "h", "issue_url": "x/issues/7", "user": {"login": "me"}, "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z"}
    hooks = [("issues", {"action": "edited", "issue": issue}), ("issues", {"action": "deleted", "issue": issue}), ("pull_request", {"action": "opened", "pull_request": issue | {"number": 8}}), ("issue_comment", {"action": "created", "issue": issue, "comment": comment}), ("issue_comment", {"action": "deleted", "issue": issue, "comment": comment}), ("push", {})]
    d = spark.createDataFrame([(e, json.dumps(b | {"repository": {"full_name": "o/r"}}), 1) for e, b in hooks], "event string, body string, now_ms long")
    got = {(r.op, r.doc.id): r for r in mappings.github_hooks(d).collect()}
    assert set(got) == {("upsert", "github:o/r#7"), ("delete", "github:o/r#7"), ("upsert", "github:o/r#8"), ("upsert", "github:o/r#7/c5"), ("delete", "github:o/r#7/c5")}
    assert got["upsert", "github:o/r#8"].doc.kind == "pull_request" and got["upsert", "github:o/r#7"].doc.labels == ["bug", "state:open"]
    c = got["upsert", "github:o/r#7/c5"].doc
    assert (c.title, c.duplicates, c.parent_id) == ("Re: T", ["github:o/r#9"], "github:o/r#7")
    assert got["delete", "github:o/r#7"].version == 1704153600001


def test_chat_events(spark):
    rows = [{"type": "message", "channel": "C1", "user": "U1", "text": "hi\nthere", "ts": "1700000000.000100"}, {"type": "message", "subtype": "channel_join", "channel": "C1", "ts": "1.0"}, {"type": "message", "subtype": "message_changed", "channel": "C1", "message": {"user": "U2", "text": "new", "ts": "1700000000.000100", "edited": {"ts": "1700000005.000000"}}}, {"type": "message", "subtype": "message_deleted", "channel": "C1", "ts": "1700000009.0", "deleted_ts": "1700000000.000100"}, {"type": "member_left_channel", "channel": "C2", "user": "U1"}, {"type": "member_joined_channel", "channel": "C1", "user": "U1"}]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", mappings.SLACK_EVENT).alias("e"), F.lit(1).cast("long").alias("now_ms")).select("e.*", "now_ms")
    people = spark.createDataFrame([("U1", "7", "Ada")], "user string, dir_id string, name string")
    channels = spark.createDataFrame([("C1", "gen", False), ("C2", "priv", True)], "channel string, name string, is_private boolean")
    got = [(r.op, r.doc.id, r.doc.title, r.doc.author, r.version) for r in mappings.slack_events(raw, people, channels, "w").collect()]
    assert sorted(got) == [("delete", "slack:C1/1700000000.000100", "", "", 1700000009000000), ("upsert", "slack:C1/1700000000.000100", "hi", "Ada", 1700000000000100), ("upsert", "slack:C1/1700000000.000100", "new", "U2", 1700000005000000)]
    assert [tuple(r) for r in mappings.slack_memberships(raw, people, channels).collect()] == [("u:7", "c:slack:C2", False)]


def listing(n, refuse=None):
    items = [{"number": i, "updated_at": f"2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z"} for i in range(n)]

    def fetch(url, params):
        since, page = params.get("since", ""), int(params.get("page", 1))
        if "?" in url:
            since, page = url.split("since=")[1].split("&")[0], int(url.split("page=")[1])
        if refuse and page > refuse:
            return 422, {}, None
        rest_ = [x for x in items if x["updated_at"] >= since]
        part = rest_[(page - 1) * 100 : page * 100]
        link = {"Link": f'<http://x/next?since={since}&page={page + 1}>; rel="next"'} if len(rest_) > page * 100 else {}
        return 200, link, part

    return fetch


def test_repository_pages_restart():
    got = [x["number"] for _, x in rest.repository_pages(listing(1050, refuse=3), "http://x", "o/r", "issues", "")]
    assert got == list(range(1050))


def project(url, params):
    issues = [{"key": f"K-{i:03d}", "fields": {"updated": f"2024-01-01T00:{0 if i < 60 else i - 59:02d}:00.000+0000"}} for i in range(95)]
    jql = params["jql"]
    assert jql.startswith('project = "') and params["jql"].split('"')[1] in ("K", "L")
    since = jql.split('"')[3].replace(" ", "T") if "updated >=" in jql else ""
    rest_ = [x for x in issues if x["fields"]["updated"][:16] >= since]
    rest_ = rest_[::-1] if "DESC" in jql else rest_
    return 200, {}, {"issues": rest_[params["startAt"] : params["startAt"] + params["maxResults"]]}


def test_project_pages_and_source(spark):
    assert len(list(rest.project_pages(project, "http://x", "K", "", page=25))) == 95
    rest.register(spark)
    df = spark.read.format("crawl").option("kind", "jira").option("base", "http://x").option("units", "K").option("transport", "tests.test_streams_sources:project").load()
    assert df.count() == 95


def test_slow_down_and_channels():
    replies = iter([(429, {"Retry-After": "3"}, None), (200, {}, {"messages": [{"ts": "1.0"}], "response_metadata": {"next_cursor": "n"}}), (200, {}, {"messages": [{"ts": "2.0"}]})])
    waits = []
    assert rest.get(lambda u, p: next(replies), "u", {}, sleep=waits.append)[0] == 200 and waits == [3.0]
    replies = iter([(200, {}, {"messages": [{"ts": "1.0"}], "response_metadata": {"next_cursor": "n"}}), (200, {}, {"messages": [{"ts": "2.0"}]})])
    assert [t for t, _ in rest.channel_pages(lambda u, p: next(replies), "u", "C", "")] == ["1.0", "2.0"]


def test_workspace_listings_and_comments():
    asked = []

    def fetch(url, params):
        asked.append((url, params))
        name = url.rsplit("/", 1)[1]
        if name == "comment":
            part = [{"id": str(i), "updated": f"2024-01-{i + 1:02d}"} for i in range(5)][params["startAt"] : params["startAt"] + 2]
            return 200, {}, {"comments": part, "total": 5}
        more = {"response_metadata": {"next_cursor": "n"}} if "cursor" not in params else {}
        return 200, {}, {"ok": True, "channels" if name.endswith("s.list") and name.startswith("conv") else "members": ["U1"] if name.endswith("members") else [{"id": "A"}]} | more

    got = {kind: [x for _, x in rest.PAGES[kind](fetch, "http://x", "C1", "")] for kind in ("slack_users", "slack_channels", "slack_members", "jira_comments")}
    assert got["slack_users"] == got["slack_channels"] == [{"id": "A"}, {"id": "A"}] and got["slack_members"] == [{"id": "U1", "channel": "C1"}] * 2
    assert [c["id"] for c in got["jira_comments"]] == list("01234") and {c["key"] for c in got["jira_comments"]} == {"C1"}


def test_unchanged_listing_has_nothing():
    calls = []

    def fetch(url, params, etag=""):
        calls.append(etag)
        return (304, {}, None) if etag == "e1" else (200, {"ETag": "e1"}, [{"number": 1, "updated_at": "2024-01-01"}])

    etags = {}
    assert len(list(rest.repository_pages(fetch, "b", "o/r", "issues", "", etags))) == 1
    assert list(rest.repository_pages(fetch, "b", "o/r", "issues", "", etags)) == [] and calls == ["", "e1"]
    assert len(list(rest.repository_pages(fetch, "b", "o/r", "issues", ""))) == 1  # a read of rows never asks by it


def test_crawl_streams_units_in_tasks(spark, tmp_path):
    rest.register(spark)
    options = {"kind": "jira", "base": "http://x", "units": "K,L", "transport": "tests.test_streams_sources:project", "cursors": '{"K": "2024-01-01T00:30:00.000Z"}'}
    reader = rest._StreamReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    assert [(p.unit, p.since) for p in parts] == [("K", "2024-01-01T00:30:00.000Z"), ("L", "")] and reader.partitions(end, end) == []
    assert end["K"] == {"at": "2024-01-01T00:35:00.000Z", "marks": ["K-094"]}
    assert [sum(1 for _ in reader.read(p)) for p in parts] == [6, 95]  # the cursor's own minute is read
    q = spark.readStream.format("crawl").options(**options).load().writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/*").groupBy("unit").count().collect()
    assert sorted(map(tuple, got)) == [("K", 6), ("L", 95)]


def test_feed_and_lag(spark, tmp_path):
    from lodestar.streaming import feed

    now = [0.0]
    f = feed.Feed(keep=3, rate=4, clock=lambda: now[0])
    assert [f.publish({"i": i}) for i in range(6)] == [True] * 4 + [False] * 2 and f.dropped == 2
    assert [e["i"] for _, e in f.since(0)] == [1, 2, 3] and [n for n, _ in f.since(3)] == [4]
    now[0] += 1
    assert f.publish({"i": 9}) and f.since(4)[0][1] == {"i": 9}
    lags = []
    r = feed.Reporter(feed.Feed(), lags.append)
    r.seen({"sources": [{"endOffset": {"t": {"0": 3, "1": 5}}, "latestOffset": {"t": {"0": 10, "1": 5}, "u": {"0": 4}}}]})
    assert r.lag == {"t": 7} and lags == [[("t", 7)]]
    live = feed.Feed()
    reporter = feed.Reporter(live)
    spark.streams.addListener(reporter)
    try:
        spark.createDataFrame([(1,)], "a int").write.json(f"{tmp_path}/in")
        spark.readStream.schema("a int").json(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        assert live.since(0, wait_s=20)
        for _ in range(100):
            if live.since() and live.since()[-1][1]["type"] == "ended":
                break
            __import__("time").sleep(0.1)
        kinds = [e["type"] for _, e in live.since()]
        assert kinds[0] == "started" and kinds[-1] == "ended" and "batch" in kinds
    finally:
        spark.streams.removeListener(reporter)


def test_stream_tells_what_changed(spark, tmp_path):
    from lodestar.plans.changelog import records
    from lodestar.streaming import feed, pipelines

    f, events = feed.Feed(), spark.createDataFrame([(i, f"d{i}", i + 1) for i in range(8)], "off long, id string, version long")
    cols = {c: F.lit("x") for c in ("datasource", "container", "kind", "title", "body", "url", "author", "parent_id", "mode")}
    events = events.withColumns(cols | {"op": F.lit("upsert"), "labels": F.array().cast("array<string>"), "allowed": F.array(F.lit("c:x")), "updated_at": F.lit(None).cast("timestamp"), "src_ts_ms": F.col("version"), "emit_ts_ms": F.col("version"), "at_ms": F.col("version")})
    records(events).write.json(f"{tmp_path}/in")
    docs = pipelines.Documents(spark, f"file://{tmp_path}/out", changed=lambda df, n: feed.sampled(f, df, n, 3))
    docs.start(pipelines.file_records(spark, f"{tmp_path}/in")).awaitTermination()
    assert [e["id"] for _, e in f.since()] == ["d0", "d1", "d2"] and docs.read().count() == 8


def test_company_and_policy(spark):
    users, edges = directory.company(spark, 100, ["api", "web"], ["eng"])
    assert users.count() == 100 and directory.find_users(users, "ADA").count() > 0
    assert directory.company(spark, 100, ["api", "web"], ["eng"])[1].exceptAll(edges).count() == 0
    assert directory.workspace(spark, 3, 50, 0).count() == 50
    c = spark.createDataFrame([("a", "public"), ("b", "members"), ("x-api", "restricted"), ("known", "public")], "id string, visibility string")
    teams = spark.createDataFrame([("api", "api"), ("web", "web")], "team string, topic string")
    got = {tuple(r) for r in mappings.container_edges(c, spark.createDataFrame([("known",)], "id string"), teams).collect()}
    assert got == {("g:everyone", "c:a"), ("g:api", "c:x-api")}


def test_engine(spark):
    docs = spark.createDataFrame([("d1", "Deploy failed", "the deployed search", ["c:x"], False), ("d2", "Deploy ok", "secret deploy", ["c:y"], False), ("d3", "Deploy gone", "deploy", ["c:x"], True)], "id string, title string, body string, allowed array<string>, deleted boolean")
    full = spark.createDataFrame([], STATE)
    for f in full.schema.fields:
        if f.name not in docs.columns:
            docs = docs.withColumn(f.name, F.lit(None).cast(f.dataType))
    docs = docs.withColumn("quarantined", F.lit(False)).withColumn("needs_embed", F.lit(True)).withColumn("embedding", F.when(F.col("id") == "d1", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")))
    edges = graph.latest(spark.createDataFrame([("u:a", "c:x", True, 1, 0, 0)], "src string, dst string, present boolean, version long, src_ts_ms long, off long"))
    e = Engine(docs, edges, embedder=lambda texts: [[1.0, 0.5] for _ in texts])
    hits = e.search("a", "deploying").collect()
    assert [(h.doc_id, h.matched) for h in hits] == [("d1", "c:x")] and "<mark>" in hits[0].snippet and set(hits[0].ranks) == {"bm25", "knn"}
    assert e.search("b", "deploy").count() == 0
    assert [h.doc_id for h in e.search("a").collect()] == ["d1"]
    assert e.explain("a", "d2").first().status == "unheld" and e.explain("a", "d3").first().status == "deleted" and e.explain("a", "d1").first().path == ["u:a", "c:x"]
    assert e.principals("a").first().consistent and tuple(e.stats().first()) == (2, 0, 2)


def test_revoke_is_seen_by_the_next_search(spark):
    kind = "src string, dst string, present boolean, version long, src_ts_ms long, off long"
    events = [("u:a", "g:t", True, 1, 0, 0), ("g:t", "c:x", True, 1, 0, 1)]
    docs = spark.createDataFrame([("d1", "Deploy", "text", ["c:x"], False)], "id string, title string, body string, allowed array<string>, deleted boolean")
    for f in spark.createDataFrame([], STATE).schema.fields:
        if f.name not in docs.columns:
            docs = docs.withColumn(f.name, F.lit(None).cast(f.dataType))
    docs = docs.withColumn("quarantined", F.lit(False))
    e = Engine(docs, lambda: graph.latest(spark.createDataFrame(events, kind)), epoch=lambda: len(events))
    assert e.search("a", "deploy").count() == 1
    held = e.expansion("u:a")
    assert e.expansion("u:a") is held
    events.append(("u:a", "g:t", False, 2, 0, 2))
    assert e.search("a", "deploy").count() == 0 and e.explain("a", "d1").first().status == "unheld"


def test_deletes_and_poison_are_seen_by_the_next_search(spark, tmp_path):
    from lodestar.plans.changelog import records
    from lodestar.streaming.pipelines import Documents

    def event(off, n, op, version, text="deploy it"):
        return (f"doc:{n}", off, op, version, 0, 0, "live", 1000 + off, "feed", "src1", "message", text, "body", "", "", "", ["c:x"], [], None)

    kind = "id string, off long, op string, version long, src_ts_ms long, emit_ts_ms long, mode string, at_ms long, datasource string, container string, kind string, title string, body string, url string, author string, parent_id string, allowed array<string>, labels array<string>, updated_at timestamp"
    docs = Documents(spark, f"file://{tmp_path}/d", now_ms=lambda: 0)
    edges = graph.latest(spark.createDataFrame([("u:a", "c:x", True, 1, 0, 0)], "src string, dst string, present boolean, version long, src_ts_ms long, off long"))
    seen = []
    steps = [[event(i, i, "upsert", 1) for i in range(4)], [event(10, 0, "delete", 2)], [event(11, 1, "poison", None)], [event(12, 2, "upsert", 2, "other words")]]
    for n, step in enumerate(steps):
        docs.batch(records(spark.createDataFrame(step, kind)), n)
        seen.append(sorted(h.doc_id for h in Engine(docs.read, edges).search("a", "deploy").collect()))
    assert seen == [["doc:0", "doc:1", "doc:2", "doc:3"], ["doc:1", "doc:2", "doc:3"], ["doc:2", "doc:3"], ["doc:3"]]
    # What is hidden between the search and its check isn't shown.
    states = iter([docs.read(), docs.read(), docs.read().withColumn("deleted", F.col("id") == "doc:3")])
    assert Engine(lambda: next(states), edges).search("a", "deploy").count() == 0


def test_more_teams_than_one_array_holds(spark, monkeypatch):
    c = spark.createDataFrame([(f"room-{i}-{'api' if i % 3 else 'none'}", "restricted") for i in range(20)], "id string, visibility string")
    teams = spark.createDataFrame([(f"t{i}", "api" if i % 5 == 0 else f"topic{i}") for i in range(30)], "team string, topic string")
    known = spark.createDataFrame([], "id string")
    want = sorted(map(tuple, mappings.container_edges(c, known, teams).collect()))
    monkeypatch.setattr(mappings, "MOST_TEAMS", 7)
    assert want and sorted(map(tuple, mappings.container_edges(c, known, teams).collect())) == want


def test_written_index(spark, tmp_path):
    from lodestar.operators import postings, retrieval

    kind = "doc_id long, title string, body string, content_hash string, deleted boolean, quarantined boolean"
    rng = __import__("random").Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    old = [(i, text(3), text(20), f"h{i}", False, False) for i in range(60)]
    index = postings.Index(spark, f"file://{tmp_path}/index")
    index.update(spark.createDataFrame(old, kind))
    changed = [(i, text(3), text(20), f"new{i}", i % 2 == 0, False) for i in range(0, 60, 5)]
    index.update(spark.createDataFrame(changed, kind))
    index.update(spark.createDataFrame(changed, kind))  # tried again
    now = spark.createDataFrame([r for r in old if r[0] % 5] + changed, kind)
    searches = spark.createDataFrame([(i, "u", f"w{i} w{i + 1} w{i}") for i in range(20)], "query_id long, user string, query string")
    want = sorted(map(tuple, retrieval.bm25(now, searches, None).collect()))
    assert want and sorted(map(tuple, retrieval.bm25(now, searches, None, index=index).collect())) == want
    compacted = index.compact(now, f"file://{tmp_path}/compact")
    assert sorted(map(tuple, retrieval.bm25(now, searches, None, index=compacted).collect())) == want
    assert {r.term for r in index._asked(["w1"]).select("term").collect()} == {"w1"}
