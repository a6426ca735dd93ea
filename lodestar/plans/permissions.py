"""Queries on the permission graph."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fnv1a64
from ..operators import graph, reports, retrieval
from ..operators.closure import Closure
from ..session import cut, scratch, table
from ..sources import decode, directory, mappings
from ..streaming import pipelines
from . import fixtures as fx
from .fixtures import with_


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest(fx.edge_events(spark, sf_dir))


def expansion_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(edges_of(spark, sf_dir), "edges")
    return cut(graph.expand(edges, fx.users(spark, sf_dir)), "expansion")


def edges_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).select("src", "dst", "present", "version")


EDGES_SQL = with_(fx.EDGE_EVENTS) + "SELECT src, dst, present, version FROM edges"


def epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.epoch(fx.edge_events(spark, sf_dir))


EPOCH_SQL = (
    with_(fx.EDGE_EVENTS)
    + "SELECT count(*) FILTER (top IS NULL OR version > top) AS epoch FROM (SELECT version, max(version) OVER (PARTITION BY src, dst ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM edge_events)"
)


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion_of(spark, sf_dir).select("user", "principal", "depth")


PRINCIPALS_SQL = with_(fx.PRINCIPALS, recursive=True) + 'SELECT usr AS "user", principal, depth FROM held'


def kept_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from expansions that were kept up to date through three batches of changes, one of them done twice."""
    events = fx.edge_events(spark, sf_dir)
    kept = Closure(spark, scratch(spark, "closure"))
    half = 700
    batches = [F.col("off") < half, (F.col("off") >= half) & (F.col("off") < 10**12), F.col("off") >= 10**12]
    for number, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        touched = events.filter(batches[part]).select("src", "dst").distinct()
        kept.apply(graph.latest(events.filter(functools.reduce(operator.or_, batches[: part + 1]))).join(touched, ["src", "dst"], "left_semi"), number)
    return kept.expansion(fx.users(spark, sf_dir)).select("user", "principal", "depth", F.array_join("path", ">").alias("path"))


KEPT_SQL = with_(fx.PRINCIPALS, recursive=True) + """SELECT usr AS "user", principal, depth, array_to_string(path, '>') AS path FROM held"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion_of(spark, sf_dir).select("user", "principal", F.array_join("path", ">").alias("path"))


PATHS_SQL = with_(fx.PRINCIPALS, recursive=True) + "SELECT usr AS \"user\", principal, array_to_string(path, '>') AS path FROM held"


def truth_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: principals held, and how many the plain closure holds more or less. Faults are planted, so that the check has what to find: some users lack principals three steps away, some hold one that isn't."""
    edges, users = cut(edges_of(spark, sf_dir), "edges"), fx.users(spark, sf_dir)
    e = cut(graph.expand(edges, users), "expansion")
    faulty = e.filter(~(F.col("user").endswith("7") & (F.col("depth") >= 3))).select("user", "principal").union(users.filter(F.col("user").endswith("5")).select("user", F.lit("g:ghost")))
    off = reports.disagreements(faulty, graph.truth(edges, users)).groupBy("user").agg(F.count("*").alias("off"))
    return e.groupBy("user").agg(F.count("*").alias("held")).join(off, "user", "left").select("user", "held", F.coalesce("off", F.lit(0)).cast("long").alias("off"))


TRUTH_SQL = with_(fx.PRINCIPALS, recursive=True) + """SELECT usr AS "user", count(*) AS held, count(*) FILTER (usr LIKE '%7' AND depth >= 3) + max(CASE WHEN usr LIKE '%5' THEN 1 ELSE 0 END) AS off FROM held GROUP BY usr"""


def reverse_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.grants(edges_of(spark, sf_dir)).select("container", F.array_join("holders", ",").alias("holders"))


REVERSE_SQL = with_(fx.EDGE_EVENTS) + "SELECT dst AS container, string_agg(DISTINCT src, ',' ORDER BY src) AS holders FROM edges WHERE present AND dst LIKE 'c:%' AND src NOT LIKE 'u:%' GROUP BY dst"


def direct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.direct_groups(edges_of(spark, sf_dir)).select("user", F.array_join("groups", ",").alias("groups"))


DIRECT_SQL = with_(fx.EDGE_EVENTS) + "SELECT src AS \"user\", string_agg(DISTINCT dst, ',' ORDER BY dst) AS groups FROM edges WHERE present AND src LIKE 'u:%' AND dst LIKE 'g:%' GROUP BY src"


def visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.visible_counts(fx.docs(spark, sf_dir), expansion_of(spark, sf_dir))


_ACL = ", acl AS (SELECT doc_id, unnest(allowed) AS principal FROM docs WHERE NOT deleted AND NOT quarantined)"
VISIBLE_SQL = with_(fx.PRINCIPALS, fx.DOCS, recursive=True) + _ACL + ' SELECT usr AS "user", count(DISTINCT doc_id) AS n FROM held JOIN acl USING (principal) GROUP BY usr'


def can_see(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each search's user: documents that they hold a principal of, hidden ones too, and those that they don't."""
    users = fx.searches(spark, sf_dir).select("user").distinct()
    edges = cut(edges_of(spark, sf_dir), "edges")
    seen = retrieval.seen_counts(fx.docs(spark, sf_dir), graph.expand(edges, users))
    return users.join(seen, "user", "left").select("user", F.coalesce("n", F.lit(0)).cast("long").alias("seen"), F.lit(fx.docs(spark, sf_dir).count()).cast("long").alias("docs"))


CAN_SEE_SQL = (
    with_(fx.PRINCIPALS, fx.DOCS, recursive=True)
    + """SELECT u.usr AS "user", (SELECT count(DISTINCT d.doc_id) FROM (SELECT doc_id, unnest(allowed) AS principal FROM docs) d JOIN held h ON h.usr = u.usr AND h.principal = d.principal) AS seen, (SELECT count(*) FROM docs) AS docs
FROM (SELECT DISTINCT 'u:' || (item_id % 100 + 1) AS usr FROM benchmark) u"""
)


def reconcile_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that make the members of private containers another set of customers, seven times their number modulo 50."""
    edges = edges_of(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    place = F.pmod(key * 7, F.lit(50))
    want = c.filter((place < 20) & (place % 4 == 3)).select(F.concat(F.lit("u:"), key.cast("string")).alias("src"), F.concat(F.lit("c:src"), place.cast("string")).alias("dst"))
    return graph.reconcile(want, edges)


RECONCILE_SQL = (
    with_(fx.EDGE_EVENTS)
    + """, want AS (SELECT 'u:' || c_custkey AS src, 'c:src' || ((c_custkey * 7) % 50) AS dst FROM customer WHERE (c_custkey * 7) % 50 < 20 AND (c_custkey * 7) % 50 % 4 = 3),
have AS (SELECT src, dst FROM edges WHERE present AND src LIKE 'u:%' AND dst IN (SELECT dst FROM want))
SELECT coalesce(w.src, h.src) AS src, coalesce(w.dst, h.dst) AS dst, w.src IS NOT NULL AS present FROM want w FULL JOIN have h ON w.src = h.src AND w.dst = h.dst WHERE w.src IS NULL OR h.src IS NULL"""
)


def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which a third was published: what still waits, after one more chunk was sent."""
    e = edges_of(spark, sf_dir).withColumn("version", F.when(F.col("dst").startswith("g:"), F.lit(10)).otherwise(F.lit(20)).cast("long")).withColumn("published", F.length(F.concat_ws("|", "src", "dst")) % 3 == 0)
    sent = graph.pending(e, 100)
    return graph.pending(graph.published(e, sent), 5000).select("src", "dst", "version")


OUTBOX_SQL = (
    with_(fx.EDGE_EVENTS)
    + """, e AS (SELECT src, dst, CASE WHEN dst LIKE 'g:%' THEN 10 ELSE 20 END AS version, length(src || '|' || dst) % 3 = 0 AS published FROM edges),
waits AS (SELECT *, row_number() OVER (ORDER BY version, src, dst) AS r FROM e WHERE NOT published)
SELECT src, dst, version FROM waits WHERE r > 100 AND r <= 5100"""
)


def version_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions of all present edges by target: how many, how many different ones, and whether all lie above the last and none below now."""
    e = edges_of(spark, sf_dir).filter("present").select("src", "dst", "present")
    v = graph.versioned(e, last=10**18, now_ns=10**18 - 5)
    return v.groupBy("dst").agg(F.count("*").alias("n"), F.countDistinct("version").alias("versions"), (F.min("version") > 10**18).alias("above"), F.count_if("published").alias("published"))


VERSIONS_SQL = with_(fx.EDGE_EVENTS) + "SELECT dst, count(*) AS n, count(*) AS versions, true AS above, 0 AS published FROM edges WHERE present GROUP BY dst"


def identity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph by its stream, in two runs, malformed edges sent aside; the epoch beside each edge."""
    path = scratch(spark, "identity")
    e = fx.edge_events(spark, sf_dir)
    rec = decode.encode_edges(e, "off").select("key", "value", F.lit("identity").alias("topic"), F.lit(0).alias("partition"), F.col("off").alias("offset"), F.col("off").alias("ts_ms"))
    bad = spark.createDataFrame([("x", '{"from": "c:a", "to": "g:b", "present": true, "version": 1}', "identity", 0, 1, 1), ("u:a|u:b", '{"from": "u:a", "to": "u:b", "present": true, "version": 1}', "identity", 0, 2, 2), ("u:a|g:b", "{", "identity", 0, 3, 3)], "key string, value string, topic string, partition int, offset long, ts_ms long")
    s = pipelines.Identity(spark, f"{path}/out")
    for part in (rec.unionByName(bad).filter(F.col("offset") < 10**12), rec.filter(F.col("offset") >= 10**12)):
        part.write.mode("append").json(f"{path}/in")
        s.start(pipelines.file_records(spark, f"{path}/in")).awaitTermination()
    return s.read().select("src", "dst", "present", "version").withColumn("epoch", F.lit(s.epoch()).cast("long"))


IDENTITY_SQL = (
    with_(fx.EDGE_EVENTS)
    + "SELECT src, dst, present, version, (SELECT count(*) FILTER (top IS NULL OR version > top) FROM (SELECT version, max(version) OVER (PARTITION BY src, dst ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM edge_events)) AS epoch FROM edges"
)


def revokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many principals each user with a revoked membership held before it and holds after."""
    e = fx.edge_events(spark, sf_dir)
    changed = e.filter("not present").select(F.col("src").alias("user")).distinct()
    before, after = (graph.expand(cut(graph.latest(x), "edges"), changed).groupBy("user").agg(F.count("*").alias("n")) for x in (e.filter(F.col("off") < 10**12), e))
    return before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), "user")


def _held_with(edges: str) -> str:
    return fx.PRINCIPALS.replace("FROM edge_events) WHERE r = 1)", f"FROM edge_events {edges}) WHERE r = 1)", 1)


def _counts(name: str, where: str) -> str:
    return f"{name} AS (SELECT * FROM ({with_(_held_with(where), recursive=True)} SELECT usr, count(*) AS n FROM held GROUP BY usr))"


REVOKES_SQL = (
    f"WITH {_counts('b', 'WHERE off < 1000000000000')}, {_counts('a', '')}\n"
    "SELECT b.usr AS \"user\", b.n AS before, a.n AS after FROM b JOIN a USING (usr) WHERE usr IN (SELECT 'u:' || c_custkey FROM customer WHERE c_custkey % 17 = 0)"
)


def container_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants of the documents' sources as new containers, by their hash."""
    containers = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.lit("").alias("visibility")).distinct()
    teams = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("team"), F.lower("n_name").alias("topic"))
    return mappings.container_edges(containers, containers.limit(0), teams)


def container_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("source").distinct()
    h = fnv1a64(F.col("source"))
    return ids.select("source", h.cast("string").alias("hash"), (h % 100 < 55).alias("public"))


#: FNV-1a in SQL: shifts and sums stay within 128 bits.
_HASHED = """SELECT source, list_reduce(list_transform(regexp_extract_all(source, '.'), lambda c: CAST(ascii(c) AS HUGEINT)),
    lambda h, b: (CAST(xor(h, b) AS HUGEINT) * CAST(1099511628211 AS HUGEINT)) % CAST('18446744073709551616' AS HUGEINT), CAST('14695981039346656037' AS HUGEINT)) AS h
  FROM (SELECT DISTINCT source FROM documents)"""
HASH_SQL = f"SELECT source, CAST(h AS VARCHAR) AS hash, h % 100 < 55 AS public FROM ({_HASHED})"

POLICY_SQL = f"""
WITH s AS ({_HASHED}), r AS (
  SELECT source, h, lower(n_name) AS team, contains(lower(source), lower(n_name)) AS fits FROM s, nation WHERE h % 100 >= 55),
p AS (SELECT *, max(fits) OVER (PARTITION BY source) AS topical, row_number() OVER (PARTITION BY source ORDER BY fits DESC, md5(source || '|' || team), team) AS place FROM r)
SELECT 'g:everyone' AS src, 'c:' || source AS dst FROM s WHERE h % 100 < 55
UNION ALL SELECT 'g:' || team, 'c:' || source FROM p WHERE place <= 1 + h % 3 AND (fits OR NOT topical)
"""


def users_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a directory's users: those with a 7 in id, name or address, by id."""
    c = table(spark, sf_dir, "customer")
    u = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@Example.org")).alias("email"))
    return directory.find_users(u, "7")


USERS_SQL = "SELECT id, name, email FROM (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, lower(c_name) || '@Example.org' AS email FROM customer) WHERE contains(id, '7') OR contains(lower(name), '7') OR contains(lower(email), '7') ORDER BY id LIMIT 5000"


def directory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.groups(edges_of(spark, sf_dir))


GROUPS_SQL = with_(fx.EDGE_EVENTS) + "SELECT DISTINCT CASE WHEN p LIKE 'g:org-%' THEN 'org' ELSE 'team' END AS kind, p AS id FROM (SELECT src AS p FROM edges UNION ALL SELECT dst FROM edges) WHERE p LIKE 'g:%'"

QUERIES = {
    "q_edges_current": edges_current, "q_epoch": epoch, "q_principals": principals, "q_expansion_kept": kept_expansion, "q_paths": paths, "q_truth": truth_agrees, "q_reverse_grants": reverse_grants, "q_direct_groups": direct_groups,
    "q_visible_counts": visible_counts, "q_can_see": can_see, "q_reconcile_members": reconcile_members, "q_outbox_pending": outbox_pending, "q_versions": version_commits, "q_identity_stream": identity_stream, "q_revokes": revokes,
    "q_container_policy": container_policy, "q_container_hash": container_hash, "q_users": users_found, "q_groups": directory_groups,
}
ORACLE_SQL = {
    "q_edges_current": EDGES_SQL, "q_epoch": EPOCH_SQL, "q_principals": PRINCIPALS_SQL, "q_expansion_kept": KEPT_SQL, "q_paths": PATHS_SQL, "q_truth": TRUTH_SQL, "q_reverse_grants": REVERSE_SQL, "q_direct_groups": DIRECT_SQL,
    "q_visible_counts": VISIBLE_SQL, "q_can_see": CAN_SEE_SQL, "q_reconcile_members": RECONCILE_SQL, "q_outbox_pending": OUTBOX_SQL, "q_versions": VERSIONS_SQL, "q_identity_stream": IDENTITY_SQL, "q_revokes": REVOKES_SQL, "q_container_hash": HASH_SQL, "q_container_policy": POLICY_SQL, "q_users": USERS_SQL, "q_groups": GROUPS_SQL,
}
