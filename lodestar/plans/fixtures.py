"""Inputs derived from the given tables, the same in Spark and in SQL: a document changelog, a permission graph, indexed documents and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import first_tokens
from ..functions.scalar import epoch_ms
from ..session import table

DAY = 86_400_000


def doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a change of its user's document: duplicated, out of order, with deletes and poison."""
    e = table(spark, sf_dir, "events")
    i, at = F.col("event_id"), epoch_ms(F.col("ts"))
    op = F.when((F.col("event_type") == "error") & (i % 3 == 0), "poison").when((F.col("event_type") == "signup") & (i % 2 == 0), "delete").otherwise("upsert")
    src = at - (i % 11) * DAY
    n = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("doc:"), n).alias("id"), i.alias("off"), op.alias("op"), (1 + (i - i % 500) + ((i * 7919) % 7) * 200).alias("version"),
        src.alias("src_ts_ms"), at.alias("emit_ts_ms"), F.element_at(F.array(F.lit("live"), F.lit("backfill"), F.lit("replay")), (i % 3 + 1).cast("int")).alias("mode"), at.alias("at_ms"),
        F.lit("feed").alias("datasource"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("container"), F.lit("message").alias("kind"),
        F.col("event_type").alias("title"), F.col("props").alias("body"), F.concat(F.lit("https://example.org/"), i.cast("string")).alias("url"), F.concat(F.lit("a"), (i % 5).cast("string")).alias("author"),
        F.when(i % 4 == 0, F.concat(F.lit("doc:"), (F.col("user_id") % 7).cast("string"))).otherwise("").alias("parent_id"),
        F.array(F.concat(F.lit("c:src"), (F.col("user_id") % 20).cast("string"))).alias("allowed"), F.array(F.col("event_type")).alias("labels"),
        F.when(i % 7 != 0, F.timestamp_millis(src)).alias("updated_at"),
    )


DOC_EVENTS = f"""
doc_events AS (
  SELECT 'doc:' || user_id AS id, event_id AS off,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'poison' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'delete' ELSE 'upsert' END AS op,
    1 + (event_id - event_id % 500) + ((event_id * 7919) % 7) * 200 AS version,
    epoch_us(ts) // 1000 - (event_id % 11) * {DAY} AS src_ts_ms, epoch_us(ts) // 1000 AS emit_ts_ms,
    ['live', 'backfill', 'replay'][event_id % 3 + 1] AS mode, epoch_us(ts) // 1000 AS at_ms,
    event_type AS title, props AS body, 'https://example.org/' || event_id AS url, 'a' || (event_id % 5) AS author,
    CASE WHEN event_id % 4 = 0 THEN 'doc:' || (user_id % 7) ELSE '' END AS parent_id,
    CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) // 1000 - (event_id % 11) * {DAY} END AS updated_ms
  FROM events)"""


def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships of customers in nations, of nations in regions, grants of sources, revoked ones and late grants that must lose."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key, user = F.col("c_custkey"), F.concat(F.lit("u:"), F.col("c_custkey").cast("string"))
    nation = F.concat(F.lit("g:n"), F.col("c_nationkey").cast("string"))

    def edge(df, src, dst, present, version, off):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(present).alias("present"), F.lit(version).cast("long").alias("version"), off.cast("long").alias("off"))

    k = spark.range(20).withColumnRenamed("id", "k")
    ks = F.col("k").cast("string")
    grant = F.concat(F.lit("c:src"), ks)
    group = F.when(F.col("k") % 4 == 0, "g:everyone").when(F.col("k") % 4 == 1, F.concat(F.lit("g:n"), ks)).otherwise(F.concat(F.lit("g:r"), (F.col("k") % 5).cast("string")))
    parts = [
        edge(c, user, nation, True, 1, key),
        edge(n, F.concat(F.lit("g:n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("g:r"), F.col("n_regionkey").cast("string")), True, 1, F.col("n_nationkey")),
        edge(k.filter("k % 4 <> 3"), group, grant, True, 1, F.col("k")),
        edge(c.filter("c_custkey % 50 < 20 and c_custkey % 50 % 4 = 3"), user, F.concat(F.lit("c:src"), (key % 50).cast("string")), True, 1, key),
        edge(c.filter("c_custkey % 17 = 0"), user, nation, False, 2, key + 10**12),
        edge(c.filter("c_custkey % 34 = 0"), user, nation, True, 1, key + 2 * 10**12),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("src_ts_ms", F.col("off"))


EDGE_EVENTS = """
edge_events AS (
  SELECT 'u:' || c_custkey AS src, 'g:n' || c_nationkey AS dst, true AS present, 1 AS version, c_custkey AS off FROM customer
  UNION ALL SELECT 'g:n' || n_nationkey, 'g:r' || n_regionkey, true, 1, n_nationkey FROM nation
  UNION ALL SELECT CASE WHEN k % 4 = 0 THEN 'g:everyone' WHEN k % 4 = 1 THEN 'g:n' || k ELSE 'g:r' || (k % 5) END, 'c:src' || k, true, 1, k FROM range(20) t(k) WHERE k % 4 <> 3
  UNION ALL SELECT 'u:' || c_custkey, 'c:src' || (c_custkey % 50), true, 1, c_custkey FROM customer WHERE c_custkey % 50 < 20 AND c_custkey % 50 % 4 = 3
  UNION ALL SELECT 'u:' || c_custkey, 'g:n' || c_nationkey, false, 2, c_custkey + 1000000000000 FROM customer WHERE c_custkey % 17 = 0
  UNION ALL SELECT 'u:' || c_custkey, 'g:n' || c_nationkey, true, 1, c_custkey + 2000000000000 FROM customer WHERE c_custkey % 34 = 0),
edges AS (
  SELECT src, dst, present, version FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY version DESC, off) AS r FROM edge_events) WHERE r = 1)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("u:"), F.col("c_custkey").cast("string")).alias("user"))


#: What each customer holds, by the shortest path, the least of equals; from the user before from everyone's group.
PRINCIPALS = (
    EDGE_EVENTS
    + """,
walk(usr, ord, principal, depth, path) AS (
  SELECT 'u:' || c_custkey, 0, 'u:' || c_custkey, 0, ['u:' || c_custkey] FROM customer
  UNION ALL SELECT w.usr, 0, e.dst, w.depth + 1, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.principal AND e.present
    WHERE w.depth < 8 AND w.principal NOT LIKE 'c:%' AND NOT list_contains(w.path, e.dst)),
ewalk(principal, depth, path) AS (
  SELECT 'g:everyone', 0, ['g:everyone']
  UNION ALL SELECT e.dst, w.depth + 1, list_append(w.path, e.dst) FROM ewalk w JOIN edges e ON e.src = w.principal AND e.present
    WHERE w.depth < 8 AND w.principal NOT LIKE 'c:%' AND NOT list_contains(w.path, e.dst)),
found AS (
  SELECT usr, ord, principal, depth, path FROM walk
  UNION ALL SELECT 'u:' || c_custkey, 1, principal, depth, path FROM customer, ewalk),
held AS (
  SELECT usr, principal, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY usr, principal ORDER BY depth, ord, path) AS r FROM found) WHERE r = 1)"""
)


def docs(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Documents as the index holds them, with the vectors that there are, or without, for those who only read words."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    src = F.lit(1704067200000) + ((i * 7919) % 100_000) * 1000
    container = F.concat(F.lit("c:"), "source")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    if vectors:
        d = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return d.select(
        "doc_id", F.concat(F.lit("d"), i.cast("string")).alias("id"), F.col("lang").alias("datasource"), F.col("source").alias("container"),
        pick(["issue", "pull_request", "comment", "message"], i % 4).alias("kind"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"),
        F.when(i % 13 == 0, F.array(F.concat(F.lit("u:"), (i % 100).cast("string")), container)).otherwise(F.array(container)).alias("allowed"),
        (i % 29 == 0).alias("deleted"), (i % 31 == 0).alias("quarantined"), src.alias("src_ts_ms"), F.when(i % 37 != 0, src).alias("updated_ms"),
        (src + (i * 31) % 900).alias("indexed_at_ms"), pick(["live", "backfill", "replay"], i % 3).alias("mode"), *([F.col("embedding").isNull().alias("needs_embed"), "embedding"] if vectors else []),
    )


DOCS = """
docs AS (
  SELECT d.doc_id, 'd' || d.doc_id AS id, lang AS datasource, source AS container, ['issue', 'pull_request', 'comment', 'message'][d.doc_id % 4 + 1] AS kind,
    substr(text, 1, 60) AS title, text AS body, CASE WHEN d.doc_id % 13 = 0 THEN ['u:' || (d.doc_id % 100), 'c:' || source] ELSE ['c:' || source] END AS allowed,
    d.doc_id % 29 = 0 AS deleted, d.doc_id % 31 = 0 AS quarantined, 1704067200000 + ((d.doc_id * 7919) % 100000) * 1000 AS src_ts_ms,
    CASE WHEN d.doc_id % 37 <> 0 THEN 1704067200000 + ((d.doc_id * 7919) % 100000) * 1000 END AS updated_ms,
    1704067200000 + ((d.doc_id * 7919) % 100000) * 1000 + (d.doc_id * 31) % 900 AS indexed_at_ms,
    ['live', 'backfill', 'replay'][d.doc_id % 3 + 1] AS mode, e.embedding IS NULL AS needs_embed, e.embedding AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each benchmark item: its first eight words, the vector with its number, and one of the first hundred customers."""
    b, v = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    v = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    i = F.col("item_id")
    return b.select(i.alias("query_id"), F.concat(F.lit("u:"), (i % 100 + 1).cast("string")).alias("user"), first_tokens(F.col("text"), 8).alias("query")).join(v, "query_id", "left")


SEARCHES = r"""
searches AS (
  SELECT b.item_id AS query_id, 'u:' || (b.item_id % 100 + 1) AS usr, list_slice(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+'), 1, 8) AS words, e.embedding AS vector
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"
