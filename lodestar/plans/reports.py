"""Queries on statistics, samples, pages and the mappings of raw payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import reports, retrieval
from ..session import cut, table
from ..sources import decode, mappings
from . import fixtures as fx
from .fixtures import with_


def by_datasource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_source(fx.docs(spark, sf_dir))


BY_DATASOURCE_SQL = with_(fx.DOCS) + "SELECT datasource, count(*) AS n FROM docs WHERE NOT deleted GROUP BY 1 ORDER BY n DESC, datasource LIMIT 20"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.docs(spark, sf_dir).filter("not deleted").agg(F.count("*").alias("docs"), F.count_if("quarantined").alias("quarantined"), F.count_if("needs_embed").alias("backlog"))


TOTALS_SQL = with_(fx.DOCS) + "SELECT count(*) AS docs, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (needs_embed) AS backlog FROM docs WHERE NOT deleted"


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.live(fx.docs(spark, sf_dir)).withColumn("ms", retrieval.fresh_ms())


_FRESH = ", f AS (SELECT datasource, CASE WHEN mode = 'live' AND src_ts_ms > 0 AND src_ts_ms <= indexed_at_ms THEN indexed_at_ms - src_ts_ms ELSE 0 END AS ms FROM docs WHERE NOT deleted AND NOT quarantined)"


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.percentiles(_fresh(spark, sf_dir).filter("ms > 0"), "ms", "datasource")


PERCENTILES_SQL = with_(fx.DOCS) + _FRESH + " SELECT datasource, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, max(ms) AS max, count(*) AS n FROM f WHERE ms > 0 GROUP BY datasource"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_fresh(spark, sf_dir), "ms", "datasource")


HISTOGRAM_SQL = with_(fx.DOCS) + _FRESH + f" SELECT datasource, le, count(*) FILTER (le IS NULL OR ms <= le) AS n FROM f, (SELECT unnest({reports.BUCKETS} || [NULL]) AS le) GROUP BY datasource, le"


def under_700(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.share_below(_fresh(spark, sf_dir), "ms", 700, "datasource")


UNDER_SQL = with_(fx.DOCS) + _FRESH + " SELECT datasource, round(avg(CASE WHEN ms < 700 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM f GROUP BY datasource"


def revoke_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as looks at a grant that their first one revokes: an event whose number is a multiple of three no longer shows it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"))
    first = e.groupBy("user_id").agg(F.min("ms").alias("revoked_ms"))
    probes = e.join(first, "user_id").select(F.col("user_id").alias("trial"), "revoked_ms", F.col("ms").alias("probe_ms"), (F.col("event_id") % 3 != 0).alias("visible"))
    return reports.revoke_latency(probes, timeout_ms=3 * 86_400_000, share_ms=86_400_000)


REVOKE_TIMES_SQL = """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
t AS (SELECT user_id, min(ms) FILTER (event_id % 3 = 0) - min(ms) AS ms FROM e GROUP BY user_id),
k AS (SELECT CASE WHEN ms <= 259200000 THEN ms END AS ms FROM t)
SELECT count(*) AS trials, count(*) FILTER (ms IS NULL) AS timeouts, round(avg(CASE WHEN ms < 86400000 THEN 1.0 ELSE 0.0 END), 6) AS share,
  quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, max(ms) AS max, count(ms) AS n FROM k
"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counter(table(spark, sf_dir, "events"), F.round(F.col("value") * 100).cast("long"), "event_type").join(
        table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes")), "event_type"
    )


COUNTERS_SQL = "SELECT event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type"


def peak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.peak_rate(table(spark, sf_dir, "events"), seconds=600, slide=60)


PEAK_SQL = """
WITH t AS (SELECT epoch_us(ts) // 60000000 AS tick, count(*) AS n FROM events GROUP BY 1)
SELECT round(max(n) / 600.0, 6) AS peak FROM (SELECT tick - o AS start, sum(n) AS n FROM t, range(10) r(o) GROUP BY 1)
"""


def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 4096 samples of each kind of event."""
    return reports.newest(table(spark, sf_dir, "events"), 4096, F.desc("ts"), F.desc("event_id"), by=["event_type"]).select("event_type", "event_id", "place")


LAST_SQL = "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 4096"


def feed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five ids of each kind, as a live feed shows them."""
    e = reports.newest(table(spark, sf_dir, "events"), 5, F.desc("ts"), F.desc("event_id"), by=["event_type"])
    return e.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("ids"))


FEED_SQL = "SELECT event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS ids FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5 GROUP BY event_type"


def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample(fx.docs(spark, sf_dir).select("doc_id", "datasource"), "doc_id", 100)


SAMPLE_SQL = with_(fx.DOCS) + "SELECT doc_id, datasource FROM docs ORDER BY md5(doc_id || '|42'), doc_id LIMIT 100"


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_after(fx.docs(spark, sf_dir).select("id", "title"), "id", "d15", 50)


KEYSET_SQL = with_(fx.DOCS) + "SELECT id, title FROM docs WHERE id > 'd15' ORDER BY id LIMIT 50"


def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_at(fx.docs(spark, sf_dir).select("id", "title"), ["id"], 40, 20)


OFFSET_SQL = with_(fx.DOCS) + "SELECT id, title FROM docs ORDER BY id LIMIT 20 OFFSET 40"


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("ts"))
    page, more = reports.history(e, "ts", 100, 900, 50)
    return page.withColumn("k", F.lit(1)).join(more.withColumn("k", F.lit(1)), "k").select("event_id", "has_more")


HISTORY_SQL = "SELECT event_id, (SELECT count(*) FROM events WHERE event_id > 100 AND event_id < 900) > 50 AS has_more FROM events WHERE event_id > 100 AND event_id < 900 ORDER BY event_id DESC LIMIT 50"


def lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as partitions of topics by kind, a tenth of each not yet read."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 6).cast("int").alias("partition")).agg(F.count("*").alias("latest"))
    return reports.lag(e.withColumn("committed", F.when(F.col("partition") == 5, F.lit(-1)).otherwise(F.col("latest") - F.floor(F.col("latest") / 10))))


LAG_SQL = "SELECT topic, CAST(sum(n // 10) AS BIGINT) AS lag FROM (SELECT event_type AS topic, user_id % 6 AS p, count(*) AS n FROM events GROUP BY 1, 2) WHERE p <> 5 GROUP BY topic"


def user_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat users (suppliers) found in the directory (customers) by address, letters in either case."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@Example.org")).alias("email"))
    u = table(spark, sf_dir, "supplier").select(F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("real_name"), F.concat(F.lit("uSER"), F.col("s_suppkey").cast("string"), F.lit("@example.ORG")).alias("email"), (F.col("s_suppkey") % 5 == 0).alias("is_bot"), F.lit(False).alias("deleted"))
    return mappings.resolved(u, d)


EMAILS_SQL = "SELECT 'U' || s_suppkey AS \"user\", (SELECT max(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey = s_suppkey) AS dir_id, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0"


# Raw payloads made of the tables' rows.


def _out(events: DataFrame) -> DataFrame:
    return events.select("op", "doc.id", "doc.container", "doc.kind", "doc.title", "doc.body", "doc.url", "doc.author", "doc.parent_id", F.array_join("doc.labels", ",").alias("labels"), F.array_join("doc.duplicates", ",").alias("duplicates"), F.array_join("doc.allowed", ",").alias("allowed"), "version", "src_ts_ms", "mode")


def map_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as issues of repositories named for their sources, through JSON."""
    d = table(spark, sf_dir, "documents")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 100000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = d.select(F.col("source").alias("repo"), F.lit(1800000000000).alias("now_ms"), F.to_json(F.struct(
        F.col("doc_id").alias("number"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), F.when(F.col("doc_id") % 2 == 0, "open").otherwise("closed").alias("state"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("html_url"), F.struct(F.col("lang").alias("login")).alias("user"), F.array(F.struct(F.col("lang").alias("name"))).alias("labels"),
        at.alias("created_at"), at.alias("updated_at"), F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("x").alias("url"))).alias("pull_request"),
    )).alias("json"))
    return _out(mappings.github_issues(raw.select("repo", "now_ms", F.from_json("json", mappings.GITHUB_ISSUE).alias("j")).select("repo", "now_ms", "j.*")))


MAP_ISSUES_SQL = """
SELECT 'upsert' AS op, 'github:' || source || '#' || doc_id AS id, 'github:' || source AS container, CASE WHEN doc_id % 3 = 0 THEN 'pull_request' ELSE 'issue' END AS kind, substr(text, 1, 40) AS title, text AS body,
  'https://example.org/' || doc_id AS url, lang AS author, '' AS parent_id, lang || ',state:' || CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END AS labels, '' AS duplicates, 'c:github:' || source AS allowed,
  (1704067200 + doc_id % 100000) * 1000 AS version, (1704067200 + doc_id % 100000) * 1000 AS src_ts_ms, 'live' AS mode FROM documents
"""


def map_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as comments on issues that two in three times have a known title; some name a duplicate."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    at = F.lit("2024-01-01T00:00:00Z")
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nDuplicate of #"), (F.col("conv_id") + F.col("turn")).cast("string"), F.lit("\n"))).otherwise(""))
    one = c.groupBy("conv_id", "turn").agg(F.max(body).alias("body"), F.max("role").alias("role"))
    raw = one.select(F.lit("o/r").alias("repo"), F.lit(1800000000000).alias("now_ms"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "body", F.lit("").alias("html_url"), F.concat(F.lit("https://example.org/issues/"), F.col("conv_id").cast("string")).alias("issue_url"), F.struct(F.col("role").alias("login")).alias("user"), at.alias("created_at"), at.alias("updated_at"))
    titles = one.filter("conv_id % 3 <> 0").select(F.lit("o/r").alias("repo"), F.col("conv_id").alias("number"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("issue_title")).distinct()
    return _out(mappings.github_comments(raw, titles))


MAP_COMMENTS_SQL = r"""
WITH c AS (SELECT conv_id, turn, max(role) AS role, max(coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Duplicate of #' || (conv_id + turn) || chr(10) ELSE '' END) AS body FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)
SELECT 'upsert' AS op, 'github:o/r#' || conv_id || '/c' || (conv_id * 1000 + turn) AS id, 'github:o/r' AS container, 'comment' AS kind, 'Re: ' || CASE WHEN conv_id % 3 <> 0 THEN 'Talk ' || conv_id ELSE 'o/r#' || conv_id END AS title, body, '' AS url,
  coalesce(role, '') AS author, 'github:o/r#' || conv_id AS parent_id, '' AS labels,
  coalesce(array_to_string(list_transform(list_filter(regexp_extract_all(body, '(?im)^\s*duplicate of\s+#(\d+)\b', 1), lambda n: CAST(n AS BIGINT) <> conv_id), lambda n: 'github:o/r#' || CAST(n AS BIGINT)), ','), '') AS duplicates,
  'c:github:o/r' AS allowed, 1704067200000 AS version, 1704067200000 AS src_ts_ms, 'live' AS mode FROM c
"""


def map_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages of channels: authors that the directory knows or not, replies, edits, titles of their first lines."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("role").alias("role"))
    ts = F.concat((F.lit(1700000000) + F.col("conv_id")).cast("string"), F.lit("."), F.lpad(F.col("turn").cast("string"), 6, "0"))
    root = F.concat((F.lit(1700000000) + F.col("conv_id")).cast("string"), F.lit(".000000"))
    raw = c.select(F.concat(F.lit("C"), (F.col("conv_id") % 5).cast("string")).alias("channel"), F.lit(1800000000000).alias("now_ms"), F.col("role").alias("user"), "text", ts.alias("ts"), root.alias("thread_ts"), F.lit("").alias("subtype"), F.when(F.col("turn") % 4 == 1, F.struct(F.concat((F.lit(1700009999) + F.col("conv_id")).cast("string"), F.lit(".5")).alias("ts"))).alias("edited"))
    people = spark.createDataFrame([("user", "7", "A User")], "user string, dir_id string, name string")
    channels = spark.createDataFrame([("C1", "general", False), ("C2", "", True)], "channel string, name string, is_private boolean")
    return _out(mappings.slack_messages(raw, people, channels, "acme"))


MAP_CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, max(coalesce(text, '')) AS text, coalesce(max(role), '') AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
m AS (SELECT *, 'C' || (conv_id % 5) AS ch, (1700000000 + conv_id) || '.' || lpad(CAST(turn AS VARCHAR), 6, '0') AS ts, (1700000000 + conv_id) || '.000000' AS root, split_part(text, chr(10), 1) AS line,
  CASE WHEN turn % 4 = 1 THEN (1700009999 + conv_id) * 1000000 + 500000 ELSE (1700000000 + conv_id) * 1000000 + turn END AS v FROM c)
SELECT 'upsert' AS op, 'slack:' || ch || '/' || ts AS id, 'slack:' || ch AS container, 'message' AS kind, CASE WHEN length(line) > 90 THEN substr(line, 1, 87) || '...' ELSE line END AS title, text AS body,
  'https://acme.slack.com/archives/' || ch || '/p' || replace(ts, '.', '') AS url, CASE WHEN role = 'user' THEN 'A User' ELSE role END AS author, CASE WHEN root <> ts THEN 'slack:' || ch || '/' || root ELSE '' END AS parent_id,
  CASE WHEN ch = 'C1' THEN '#general' ELSE '' END AS labels, '' AS duplicates, 'c:slack:' || ch AS allowed, v AS version, v // 1000 AS src_ts_ms, 'live' AS mode FROM m
"""


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues of projects, their lines as comments, through JSON."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    lines = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("body")))).alias("lines"))
    at = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250+0200"))
    person = F.struct(F.lit("n").alias("name"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("displayName"))
    link = F.struct(F.struct(F.lit("Duplicate").alias("name")).alias("type"), F.struct(F.concat(F.lit("P1-"), F.col("o_custkey").cast("string")).alias("key")).alias("outwardIssue"))
    comments = F.transform("lines", lambda x: F.struct(x["id"].alias("id"), x["body"].alias("body"), person.alias("author"), at.alias("created"), at.alias("updated")))
    fields = F.struct(
        F.col("o_orderpriority").alias("summary"), F.col("o_orderstatus").alias("description"), F.array(F.lit("a")).alias("labels"), F.struct(F.lit("Bug").alias("name")).alias("issuetype"), F.struct(F.col("o_orderstatus").alias("name")).alias("status"),
        person.alias("reporter"), at.alias("created"), at.alias("updated"), F.when(F.col("o_orderkey") % 9 == 0, F.array(link)).alias("issuelinks"), F.struct(comments.alias("comments"), F.size("lines").alias("total")).alias("comment"),
    )
    key = F.concat(F.lit("P"), (F.col("o_orderkey") % 3).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    raw = o.join(lines, o.o_orderkey == lines.l_orderkey).select(F.lit(1800000000000).alias("now_ms"), F.to_json(F.struct(key.alias("key"), fields.alias("fields"))).alias("json"))
    # Written once, as a crawl would leave them; what reads them twice doesn't make them twice.
    raw = cut(raw, "payloads")
    # As a row of its own: filters on its fields would otherwise parse the payload again.
    return raw.select("now_ms", F.explode(F.array(F.from_json("json", mappings.JIRA_ISSUE))).alias("j")).select("now_ms", "j.*")


def map_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _projects(spark, sf_dir)
    return _out(mappings.jira_issues(raw, "https://t.example.org/").unionByName(mappings.jira_comments(raw, "https://t.example.org")))


MAP_PROJECTS_SQL = """
WITH o AS (SELECT *, 'P' || (o_orderkey % 3) AS p, 'P' || (o_orderkey % 3) || '-' || o_orderkey AS key, epoch_us(date_trunc('second', o_orderdate)) // 1000 + 250 - 7200000 AS v FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT 'upsert' AS op, 'jira:' || key AS id, 'jira:' || p AS container, 'issue' AS kind, o_orderpriority AS title, o_orderstatus AS body, 'https://t.example.org/browse/' || key AS url, 'Customer ' || o_custkey AS author, '' AS parent_id,
  'a,type:Bug,status:' || o_orderstatus AS labels, CASE WHEN o_orderkey % 9 = 0 THEN 'jira:P1-' || o_custkey ELSE '' END AS duplicates, 'c:jira:' || p AS allowed, v AS version, v AS src_ts_ms, 'live' AS mode FROM o
UNION ALL SELECT 'upsert', 'jira:' || key || '/c' || l_linenumber, 'jira:' || p, 'comment', 'Re: ' || o_orderpriority, l_returnflag, 'https://t.example.org/browse/' || key || '?focusedCommentId=' || l_linenumber || '#comment-' || l_linenumber,
  'Customer ' || o_custkey, 'jira:' || key, '', '', 'c:jira:' || p, v, v, 'live' FROM o JOIN lineitem ON l_orderkey = o_orderkey
"""


def vanished_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more comment than there is was known of every issue: their deletes."""
    raw = _projects(spark, sf_dir)
    n = F.size("fields.comment.comments")
    before = raw.select("key", F.explode(F.sequence(F.lit(1), n + 1).cast("array<string>")).alias("comment_id"))
    return _out(mappings.vanished_comments(before, raw))


VANISHED_SQL = """
SELECT 'delete' AS op, 'jira:P' || (o_orderkey % 3) || '-' || o_orderkey || '/c' || i AS id, 'jira:P' || (o_orderkey % 3) AS container, '' AS kind, '' AS title, '' AS body, '' AS url, '' AS author, '' AS parent_id, '' AS labels, '' AS duplicates, '' AS allowed,
  1800000000000 AS version, 1800000000000 AS src_ts_ms, 'live' AS mode
FROM (SELECT o_orderkey, unnest(range(1, n + 2)) AS i FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_linenumber = i)
"""


def decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, malformed in ten ways by turns: how many of each are refused, skipped and read."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id") % 11
    good = F.to_json(F.struct(F.when(i == 3, "replace").when(i == 4, "delete").otherwise("upsert").alias("op"), F.struct(
        F.when(i == 5, "").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"), F.when((i == 6) | (i == 4), "").otherwise("feed").alias("datasource"), F.col("source").alias("container"), F.col("text").alias("body"),
        F.array(F.when(i == 7, "x:bad").when(i == 8, "c:a|b").otherwise("c:src1")).alias("allowed")).alias("doc"), F.when(i == 9, 0).otherwise(F.col("doc_id") + 1).alias("version")))
    value = F.when(i == 0, F.lit(None)).when(i == 1, F.lit("{")).otherwise(good)
    key = F.when(i == 2, "other").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    r = d.select(key.alias("key"), value.alias("value"), F.lit("documents").alias("topic"), F.lit(0).alias("partition"), F.col("doc_id").alias("offset"), F.lit(0).cast("long").alias("ts_ms"))
    return decode.decode_docs(r).groupBy("kind", "problem").agg(F.count("*").alias("n"))


DECODE_SQL = """
SELECT CASE WHEN i = 0 THEN 'skip' WHEN i IN (4, 10) THEN 'event' ELSE 'poison' END AS kind,
  CASE i WHEN 1 THEN 'unreadable' WHEN 2 THEN 'key is not the doc id' WHEN 3 THEN 'unknown op' WHEN 5 THEN 'no doc id' WHEN 6 THEN 'missing datasource or container' WHEN 7 THEN 'malformed principal' WHEN 8 THEN 'malformed principal' WHEN 9 THEN 'non-positive version' END AS problem,
  count(*) AS n FROM (SELECT doc_id % 11 AS i FROM documents) GROUP BY 1, 2
"""


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat and tracker times of all events, read back from their texts."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    slack = F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    jira = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")
    return e.select("event_id", scalar.slack_micros(slack).alias("slack_us"), scalar.epoch_ms(scalar.jira_time(jira)).alias("jira_ms"), scalar.query_minute(F.col("ts").cast("timestamp")).alias("minute"), scalar.message_title(F.concat(F.repeat(F.col("event_type"), 20), F.lit("\nmore"))).alias("title"))


TIMES_SQL = """
SELECT event_id, epoch_us(ts) AS slack_us, epoch_us(ts) // 1000 AS jira_ms, strftime(ts, '%Y-%m-%d %H:%M') AS minute,
  CASE WHEN length(repeat(event_type, 20)) > 90 THEN substr(repeat(event_type, 20), 1, 87) || '...' ELSE repeat(event_type, 20) END AS title FROM events
"""

def map_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as deliveries: issues that are edited, deleted or transferred, and comments on them that stay or are deleted, each with its own delivery's title."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    i, at = F.col("doc_id"), F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 100000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    user = F.struct(F.lit("ann").alias("login"))
    issue = F.struct(i.alias("number"), F.concat(F.lit("T"), i.cast("string")).alias("title"), F.lit("b").alias("body"), F.lit("open").alias("state"), F.lit("").alias("html_url"), user.alias("user"), F.array(F.struct(F.lit("l").alias("name"))).alias("labels"), at.alias("created_at"), at.alias("updated_at"))
    comment = F.struct(i.alias("id"), F.lit("c").alias("body"), F.lit("").alias("html_url"), F.concat(F.lit("https://example.org/issues/"), i.cast("string")).alias("issue_url"), user.alias("user"), at.alias("created_at"), at.alias("updated_at"))
    action = F.when(i % 6 < 2, "edited").when(i % 6 == 2, "transferred").otherwise("deleted")
    body = F.to_json(F.struct(action.alias("action"), F.struct(F.col("source").alias("full_name")).alias("repository"), issue.alias("issue"), F.when(i % 2 == 1, comment).alias("comment")))
    raw = d.select(F.when(i % 2 == 1, "issue_comment").otherwise("issues").alias("event"), body.alias("body"), F.when(i % 4 < 2, F.lit(1)).otherwise(F.lit(1800000000000)).cast("long").alias("now_ms"))
    return _out(mappings.github_hooks(raw))


MAP_HOOKS_SQL = """
WITH d AS (SELECT *, doc_id % 2 = 1 AS c, NOT (doc_id % 6 < 2 OR doc_id % 2 = 1 AND doc_id % 6 = 2) AS gone, (1704067200 + doc_id % 100000) * 1000 AS v, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 1800000000000 END AS t FROM documents)
SELECT CASE WHEN gone THEN 'delete' ELSE 'upsert' END AS op, 'github:' || source || '#' || doc_id || CASE WHEN c THEN '/c' || doc_id ELSE '' END AS id, 'github:' || source AS container,
  CASE WHEN gone THEN '' WHEN c THEN 'comment' ELSE 'issue' END AS kind, CASE WHEN gone THEN '' WHEN c THEN 'Re: T' || doc_id ELSE 'T' || doc_id END AS title, CASE WHEN gone THEN '' WHEN c THEN 'c' ELSE 'b' END AS body, '' AS url,
  CASE WHEN gone THEN '' ELSE 'ann' END AS author, CASE WHEN c AND NOT gone THEN 'github:' || source || '#' || doc_id ELSE '' END AS parent_id, CASE WHEN c OR gone THEN '' ELSE 'l,state:open' END AS labels, '' AS duplicates,
  CASE WHEN gone THEN '' ELSE 'c:github:' || source END AS allowed, CASE WHEN gone THEN greatest(t, v + 1) ELSE v END AS version, CASE WHEN gone THEN t ELSE v END AS src_ts_ms, 'live' AS mode FROM d
"""


def _chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a chat from the events table: posts, edits, deletions, joins and leaves by turns."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    i = F.col("event_id")
    ts = F.concat((F.lit(1700000000) + i).cast("string"), F.lit(".000000"))
    kind = i % 5
    return e.select(
        F.lit(1800000000000).alias("now_ms"), F.when(kind == 3, "member_joined_channel").when(kind == 4, "member_left_channel").otherwise("message").alias("type"), F.when(kind == 1, "message_changed").when(kind == 2, "message_deleted").otherwise("").alias("subtype"),
        F.concat(F.lit("C"), (i % 3).cast("string")).alias("channel"), F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("user"), F.lit("hello").alias("text"), ts.alias("ts"), F.lit("").alias("thread_ts"),
        F.when(kind == 2, F.concat((F.lit(1699999999) + i).cast("string"), F.lit(".000000"))).alias("deleted_ts"),
        F.when(kind == 1, F.struct(F.lit("U1").alias("user"), F.lit("changed").alias("text"), F.concat((F.lit(1699999999) + i).cast("string"), F.lit(".000000")).alias("ts"), F.lit("").alias("thread_ts"), F.lit("").alias("subtype"), F.struct(ts.alias("ts")).alias("edited"))).alias("message"),
    )


def _chat(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    people = spark.range(10).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("user"), F.when(F.col("id") < 7, F.col("id").cast("string")).alias("dir_id"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"))
    return people, spark.createDataFrame([("C0", "", False), ("C1", "", True), ("C2", "", True)], "channel string, name string, is_private boolean")


def map_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(mappings.slack_events(_chat_events(spark, sf_dir), *_chat(spark), "acme"))


CHAT_EVENTS_SQL = """
WITH e AS (SELECT event_id AS i, event_id % 5 AS k, 'C' || (event_id % 3) AS ch, user_id % 10 AS u FROM events WHERE event_id % 5 < 3),
m AS (SELECT *, CASE WHEN k = 0 THEN 1700000000 + i ELSE 1699999999 + i END AS s, (1700000000 + i) * 1000000 AS v FROM e)
SELECT CASE WHEN k = 2 THEN 'delete' ELSE 'upsert' END AS op, 'slack:' || ch || '/' || s || '.000000' AS id, 'slack:' || ch AS container, CASE WHEN k = 2 THEN '' ELSE 'message' END AS kind, CASE k WHEN 0 THEN 'hello' WHEN 1 THEN 'changed' ELSE '' END AS title,
  CASE k WHEN 0 THEN 'hello' WHEN 1 THEN 'changed' ELSE '' END AS body, CASE WHEN k = 2 THEN '' ELSE 'https://acme.slack.com/archives/' || ch || '/p' || s || '000000' END AS url, CASE k WHEN 0 THEN 'N' || u WHEN 1 THEN 'N1' ELSE '' END AS author,
  '' AS parent_id, '' AS labels, '' AS duplicates, CASE WHEN k = 2 THEN '' ELSE 'c:slack:' || ch END AS allowed, v AS version, v // 1000 AS src_ts_ms, 'live' AS mode FROM m
"""


def map_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = mappings.slack_memberships(_chat_events(spark, sf_dir), *_chat(spark))
    return e.groupBy("src", "dst", "present").agg(F.count("*").alias("n"))


MEMBERSHIPS_SQL = "SELECT 'u:' || (user_id % 10) AS src, 'c:slack:C' || (event_id % 3) AS dst, event_id % 5 = 3 AS present, count(*) AS n FROM events WHERE event_id % 5 >= 3 AND event_id % 3 > 0 AND user_id % 10 < 7 GROUP BY 1, 2, 3"


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in title case, keys in base 36, signatures of payloads."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select("c_custkey", scalar.title_case(F.lower("c_mktsegment")).alias("title"), scalar.base36(key).alias("base36"))


STRINGS_SQL = """
SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title,
  CASE WHEN c_custkey >= 46656 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', c_custkey // 46656 % 36 + 1, 1) ELSE '' END || CASE WHEN c_custkey >= 1296 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', c_custkey // 1296 % 36 + 1, 1) ELSE '' END
    || CASE WHEN c_custkey >= 36 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', c_custkey // 36 % 36 + 1, 1) ELSE '' END || substr('0123456789abcdefghijklmnopqrstuvwxyz', c_custkey % 36 + 1, 1) AS base36 FROM customer
"""

QUERIES = {
    "q_stats_by_datasource": by_datasource, "q_stats_totals": totals, "q_percentiles": percentiles, "q_histogram": histogram, "q_under_700": under_700, "q_counters": counters, "q_peak_rate": peak_rate, "q_last_n": last_n,
    "q_feed_samples": feed_samples, "q_sample_seeded": sample_seeded, "q_keyset_page": keyset_page, "q_offset_page": offset_page, "q_history_page": history_page, "q_lag": lag, "q_user_emails": user_emails, "q_map_github": map_issues,
    "q_map_github_comments": map_comments, "q_map_slack": map_chat, "q_map_jira": map_projects, "q_vanished_comments": vanished_comments, "q_decode_rejects": decode_rejects, "q_times": times,
    "q_map_hooks": map_hooks, "q_map_slack_events": map_chat_events, "q_map_memberships": map_memberships, "q_revoke_times": revoke_times, "q_strings": strings,
}
ORACLE_SQL = {
    "q_stats_by_datasource": BY_DATASOURCE_SQL, "q_stats_totals": TOTALS_SQL, "q_percentiles": PERCENTILES_SQL, "q_histogram": HISTOGRAM_SQL, "q_under_700": UNDER_SQL, "q_counters": COUNTERS_SQL, "q_peak_rate": PEAK_SQL, "q_last_n": LAST_SQL,
    "q_feed_samples": FEED_SQL, "q_sample_seeded": SAMPLE_SQL, "q_keyset_page": KEYSET_SQL, "q_offset_page": OFFSET_SQL, "q_history_page": HISTORY_SQL, "q_lag": LAG_SQL, "q_user_emails": EMAILS_SQL, "q_map_github": MAP_ISSUES_SQL,
    "q_map_github_comments": MAP_COMMENTS_SQL, "q_map_slack": MAP_CHAT_SQL, "q_map_jira": MAP_PROJECTS_SQL, "q_vanished_comments": VANISHED_SQL, "q_decode_rejects": DECODE_SQL, "q_times": TIMES_SQL,
    "q_map_hooks": MAP_HOOKS_SQL, "q_map_slack_events": CHAT_EVENTS_SQL, "q_map_memberships": MEMBERSHIPS_SQL, "q_revoke_times": REVOKE_TIMES_SQL, "q_strings": STRINGS_SQL,
}
