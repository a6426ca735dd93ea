"""Queries on the changelog fold, its streams, and the sinks' contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import content_hash, embed_text
from ..operators import fold, reports
from ..session import cut, scratch
from ..sources import decode, dumps
from ..streaming import pipelines
from . import fixtures as fx
from .fixtures import with_

OUT = ["id", "version", "deleted", "quarantined", "quarantined_at_ms", "needs_embed", "content_hash", "title", "body", "url", "author", "parent_id", "mode", "src_ts_ms", "emit_ts_ms"]


def _state_out(state: DataFrame) -> DataFrame:
    return state.select(*OUT, F.unix_millis("updated_at").alias("updated_ms"), F.array_join("allowed", ",").alias("allowed"), F.array_join("labels", ",").alias("labels"))


def fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_out(fold.fold(fx.doc_events(spark, sf_dir)))


GATED = r"""
gated AS (
  SELECT *, op <> 'poison' AND (seen IS NULL OR version > seen) AS applied FROM (
    SELECT *, max(CASE WHEN op <> 'poison' THEN version ELSE 0 END) OVER (PARTITION BY id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
      CASE WHEN op = 'upsert' THEN substr(sha256(title || chr(0) || body), 1, 32) END AS hash
    FROM doc_events)),
marked AS (
  SELECT *, last_value(CASE WHEN applied THEN coalesce(hash, '') END IGNORE NULLS) OVER (PARTITION BY id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running,
    max(CASE WHEN applied THEN src_ts_ms END) OVER (PARTITION BY id ORDER BY off ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
  FROM gated)"""

STATE_SQL = (
    with_(fx.DOC_EVENTS, GATED)
    + """,
per AS (
  SELECT id, count(*) FILTER (applied) AS n, count(*) FILTER (op = 'poison') AS p, max_by(op, off) FILTER (applied) AS last_op, max(version) FILTER (applied) AS version,
    max_by(src_ts_ms, off) FILTER (applied) AS src_ts_ms, max_by(emit_ts_ms, off) FILTER (applied) AS emit_ts_ms,
    max_by(title, off) FILTER (applied AND op = 'upsert') AS title, max_by(body, off) FILTER (applied AND op = 'upsert') AS body, max_by(hash, off) FILTER (applied AND op = 'upsert') AS hash,
    max_by(url, off) FILTER (applied AND op = 'upsert') AS url, max_by(author, off) FILTER (applied AND op = 'upsert') AS author, max_by(parent_id, off) FILTER (applied AND op = 'upsert') AS parent_id,
    max_by(mode, off) FILTER (applied AND op = 'upsert') AS mode, max_by(updated_ms, off) FILTER (applied AND op = 'upsert' AND updated_ms IS NOT NULL) AS updated_ms,
    coalesce(bool_or(applied AND op = 'upsert' AND hash <> coalesce(running, '')), false) AS changed,
    coalesce(max(at_ms) FILTER (op = 'poison' AND at_ms > 0 AND (later IS NULL OR later <= at_ms)), 0) AS poison
  FROM marked GROUP BY id)
SELECT id, coalesce(version, 0) AS version, coalesce(last_op = 'delete', false) AS deleted, poison > 0 AS quarantined, poison AS quarantined_at_ms,
  CASE WHEN last_op = 'delete' THEN false ELSE changed END AS needs_embed,
  CASE WHEN last_op = 'delete' THEN '' ELSE hash END AS content_hash, CASE WHEN last_op = 'delete' THEN '' ELSE title END AS title, CASE WHEN last_op = 'delete' THEN '' ELSE body END AS body,
  url, author, parent_id, mode, src_ts_ms, emit_ts_ms, updated_ms,
  CASE WHEN last_op = 'upsert' THEN 'c:src' || (CAST(substr(id, 5) AS BIGINT) % 20) ELSE '' END AS allowed, CASE WHEN last_op = 'upsert' THEN title ELSE '' END AS labels
FROM per WHERE n > 0 OR p > 0
"""
)


def fold_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.discards(fold.gate(fx.doc_events(spark, sf_dir)))


DISCARDS_SQL = with_(fx.DOC_EVENTS, GATED) + "SELECT CASE WHEN version = seen THEN 'duplicate' ELSE 'stale' END AS reason, count(*) AS n FROM gated WHERE op <> 'poison' AND NOT applied GROUP BY 1"


def expected_applies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.expected_applies(fx.doc_events(spark, sf_dir).filter("op <> 'poison'"))


EXPECTED_SQL = (
    with_(fx.DOC_EVENTS)
    + """SELECT id, count(*) FILTER (top IS NULL OR version > top) AS applies FROM (
  SELECT id, version, max(version) OVER (PARTITION BY id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM doc_events WHERE op <> 'poison') GROUP BY id"""
)


def replay_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events again, on the state that they made: applied, duplicate and stale counts by document."""
    events = fx.doc_events(spark, sf_dir).filter("op <> 'poison'")
    state = cut(fold.fold(events), "state")
    again = fold.gate(events.withColumn("off", F.col("off") + 10**12), state)
    return again.groupBy("id").agg(F.count_if("applied").alias("applied"), F.count_if(F.col("reason") == "duplicate").alias("duplicate"), F.count_if(F.col("reason") == "stale").alias("stale"))


REPLAY_SQL = (
    with_(fx.DOC_EVENTS)
    + """SELECT id, 0 AS applied, count(*) FILTER (version = top) AS duplicate, count(*) FILTER (version < top) AS stale FROM (
  SELECT id, version, max(version) OVER (PARTITION BY id) AS top FROM doc_events WHERE op <> 'poison') GROUP BY id"""
)


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.docs(spark, sf_dir).select("doc_id", content_hash(F.col("title"), F.col("body")).alias("content_hash"))


CONTENT_SQL = with_(fx.DOCS) + "SELECT doc_id, substr(sha256(coalesce(title, '') || chr(0) || coalesce(body, '')), 1, 32) AS content_hash FROM docs"


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.docs(spark, sf_dir).select("doc_id", embed_text(F.col("title"), F.col("body")).alias("text"))


EMBED_TEXT_SQL = with_(fx.DOCS) + "SELECT doc_id, CASE WHEN t = '' THEN ' ' ELSE t END AS text FROM (SELECT doc_id, substr(CASE WHEN coalesce(body, '') = '' THEN coalesce(title, '') ELSE coalesce(title, '') || chr(10) || chr(10) || body END, 1, 400) AS t FROM docs)"


def embed_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.backlog(fx.docs(spark, sf_dir)).select("doc_id", "quarantined")


BACKLOG_SQL = with_(fx.DOCS) + "SELECT doc_id, quarantined FROM docs WHERE needs_embed AND NOT deleted"


def vector_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all embeddings, a seventh of them of an older text: which are written."""
    d = fx.docs(spark, sf_dir).withColumn("content_hash", content_hash(F.col("title"), F.col("body"))).withColumn("embed_hash", F.lit(""))
    v = d.filter("embedding is not null").select("id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), "embedding")
    out = fold.write_vectors(d.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("needs_embed", F.lit(True)), v)
    return out.select("doc_id", F.col("embedding").isNotNull().alias("written"), "needs_embed", "embed_hash")


CAS_SQL = (
    with_(fx.DOCS)
    + """SELECT doc_id, ok AS written, NOT ok AS needs_embed, CASE WHEN ok THEN hash ELSE '' END AS embed_hash FROM (
  SELECT doc_id, embedding IS NOT NULL AND doc_id % 7 <> 0 AND NOT deleted AS ok, substr(sha256(coalesce(title, '') || chr(0) || coalesce(body, '')), 1, 32) AS hash FROM docs)"""
)


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of how long applied live events took, at the time of the newest event."""
    events = fx.doc_events(spark, sf_dir)
    now = events.agg(F.max("emit_ts_ms")).first()[0]
    return reports.percentiles(fold.freshness(fold.gate(events), now), "lag_ms")


FRESH_SQL = (
    with_(fx.DOC_EVENTS, GATED)
    + """, s AS (SELECT m - src_ts_ms AS lag FROM gated, (SELECT max(emit_ts_ms) AS m FROM doc_events) WHERE applied AND mode = 'live' AND src_ts_ms > 0 AND src_ts_ms <= m)
SELECT quantile_disc(lag, 0.5) AS p50, quantile_disc(lag, 0.95) AS p95, quantile_disc(lag, 0.99) AS p99, max(lag) AS max, count(*) AS n FROM s"""
)


def chaos_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four versions of every document, some sent twice, some swapped, some deleted at last: lost, regressed, stale, double and missed after the fold and after faults in some of the documents."""
    from ..sources.directory import chaos

    d = fx.docs(spark, sf_dir).select("id", "doc_id", "title", "body")
    v = d.withColumn("version", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))
    gone = (F.col("version") == 4) & (F.col("doc_id") % 20 == 0)
    v = v.withColumn("op", F.when(gone, "delete").otherwise("upsert")).withColumn("body", F.concat("body", F.lit(" rev "), F.col("version").cast("string")))
    events = chaos(v.withColumn("src_ts_ms", F.col("version")).withColumn("mode", F.lit("replay")))
    gated = fold.gate(events)
    state = fold.fold(events, gated=gated)
    last = v.filter("version = 4").select("id", "version", (F.col("op") == "delete").alias("deleted"), F.when(F.col("op") == "delete", "").otherwise(content_hash(F.col("title"), F.col("body"))).alias("content_hash"))
    # Faults are planted, so that the check has what to find.
    m = F.substring("id", 2, 20).cast("long") % 50
    state = state.filter(m != 7).withColumns({
        "version": F.col("version") - F.when(m == 9, 1).when(m == 11, -1).otherwise(0), "content_hash": F.when(m == 13, "other").otherwise(F.col("content_hash")), "deleted": F.col("deleted") != (m == 15),
    })
    applies = gated.groupBy("id").agg(F.count_if("applied").alias("applies")).withColumn("applies", F.col("applies") + F.when(m == 17, 2).when(m == 19, -1).otherwise(0))
    return reports.convergence(last, state, applies, fold.expected_applies(events))


CHAOS_SQL = """
SELECT count(*) AS checked, count(*) FILTER (m IN (7, 9)) AS lost, count(*) FILTER (m = 11) AS regressed, count(*) FILTER (m IN (13, 15)) AS stale,
  2 * count(*) FILTER (m = 17) AS double_applies, count(*) FILTER (m = 19) AS missed_applies FROM (SELECT doc_id % 50 AS m FROM documents)
"""


def records(events: DataFrame) -> DataFrame:
    """Changelog events as the records of a log; poison is a value that can't be read."""
    doc = F.struct("id", "datasource", "container", "kind", "title", "body", "url", "author", "parent_id", "labels", F.array().cast("array<string>").alias("duplicates"), F.lit(None).cast("string").alias("created_at"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_at"), "allowed")
    value = F.when(F.col("op") == "poison", F.concat(F.lit('{"op": '), F.lit("broken"))).otherwise(F.to_json(F.struct("op", doc.alias("doc"), "version", "src_ts_ms", "emit_ts_ms", "mode")))
    return events.select(F.col("id").alias("key"), value.alias("value"), F.lit("documents").alias("topic"), F.lit(0).alias("partition"), F.col("off").alias("offset"), F.col("at_ms").alias("ts_ms"))


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state by the stream: records land in three parts, each folded by a run of its own that starts where the last one stopped."""
    path = scratch(spark, "stream")
    all_ = records(fx.doc_events(spark, sf_dir))
    most = all_.agg(F.max("offset")).first()[0] or 0
    docs = pipelines.Documents(spark, f"{path}/out", now_ms=lambda: 0)
    for part in range(3):
        all_.filter(F.floor(F.col("offset") * 3 / F.lit(most + 1)) == part).write.mode("append").json(f"{path}/in")
        docs.start(pipelines.file_records(spark, f"{path}/in")).awaitTermination()
    return _state_out(docs.read())


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream says of records and of the same records sent again: the second time nothing is applied."""
    path = scratch(spark, "replay")
    once = records(fx.doc_events(spark, sf_dir).filter("op <> 'poison'"))
    docs = pipelines.Documents(spark, f"{path}/out", now_ms=lambda: 0)
    parts = []
    for again in range(2):
        once.withColumn("offset", F.col("offset") + again * 10**12).write.mode("append").json(f"{path}/in")
        docs.start(pipelines.file_records(spark, f"{path}/in")).awaitTermination()
        parts.append(spark.read.schema("what string, n long").parquet(f"{path}/out/metrics/{again}").groupBy("what").agg(F.sum("n").alias("n")).select(F.lit(again).alias("pass"), "what", "n"))
    return parts[0].unionByName(parts[1])


STREAM_REPLAY_SQL = (
    with_(fx.DOC_EVENTS)
    + """, e AS (SELECT * FROM doc_events WHERE op <> 'poison'),
g AS (SELECT version, max(version) OVER (PARTITION BY id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, max(version) OVER (PARTITION BY id) AS top FROM e)
SELECT 0 AS pass, CASE WHEN seen IS NULL OR version > seen THEN 'applied' WHEN version = seen THEN 'duplicate' ELSE 'stale' END AS what, count(*) AS n FROM g GROUP BY 2
UNION ALL SELECT 1, CASE WHEN version = top THEN 'duplicate' ELSE 'stale' END, count(*) FROM g GROUP BY 2"""
)


def _keyed(spark: SparkSession, sf_dir: str) -> str:
    """Runs the keyed stateful fold over the first half of the log, and again from its checkpoint over the rest; the folder of checkpoint and outputs."""
    from ..streaming import keyed

    path, keyed_by = scratch(spark, "keyed"), spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    keyed.use_rocksdb(spark)
    try:
        events = fx.doc_events(spark, sf_dir)
        half = events.agg(F.max("off")).first()[0] // 2
        for part in (F.col("off") <= half, F.col("off") > half):
            records(events.filter(part)).write.mode("append").json(f"{path}/in")
            items = decode.doc_items(decode.decode_docs(pipelines.file_records(spark, f"{path}/in")))
            out = keyed.folded(items).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/{n}")).outputMode("update")
            out.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        if keyed_by:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed_by)
    return path


def keyed_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as the stream's own state store holds them at the end."""
    from ..streaming import keyed

    return _state_out(keyed.documents(spark, f"{_keyed(spark, sf_dir)}/checkpoint"))


def keyed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream gave out: each document's last version, deletion and quarantine, and what became of its events."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{_keyed(spark, sf_dir)}/out")
    last = F.max_by(F.struct("version", "deleted", "quarantined_at_ms"), F.struct("version", "applied")).alias("last")
    out = rows.groupBy("id").agg(last, *[F.sum(c).alias(c) for c in ("applied", "duplicate", "stale")])
    return out.select("id", F.coalesce("last.version", F.lit(0)).alias("version"), "last.deleted", "last.quarantined_at_ms", "applied", "duplicate", "stale")


KEYED_SQL = (
    with_(fx.DOC_EVENTS, GATED)
    + """SELECT id, coalesce(max(version) FILTER (applied), 0) AS version, coalesce(max_by(op, off) FILTER (applied) = 'delete', false) AS deleted,
  coalesce(max(at_ms) FILTER (op = 'poison' AND at_ms > 0 AND (later IS NULL OR later <= at_ms)), 0) AS quarantined_at_ms,
  count(*) FILTER (applied) AS applied, count(*) FILTER (op <> 'poison' AND NOT applied AND version = seen) AS duplicate, count(*) FILTER (op <> 'poison' AND NOT applied AND version < seen) AS stale
FROM marked GROUP BY id"""
)


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused records of the changelog by document, as the stream would send them aside."""
    d = decode.dead_letters(decode.decode_docs(records(fx.doc_events(spark, sf_dir))))
    return d.groupBy("key", "topic", F.col("headers")["dlq-error"].alias("error")).agg(F.count("*").alias("n"), F.max(F.col("headers")["dlq-source-offset"].cast("long")).alias("last_offset"))


DLQ_SQL = with_(fx.DOC_EVENTS) + "SELECT id AS key, 'documents.dlq' AS topic, 'unreadable' AS error, count(*) AS n, max(off) AS last_offset FROM doc_events WHERE op = 'poison' GROUP BY id"


def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to a dump, read back and counted by kind and document container."""
    path = scratch(spark, "dump")
    e = records(fx.doc_events(spark, sf_dir).filter("op <> 'poison'"))
    events = decode.decode_docs(e).select("e.op", "e.doc", "e.version", "e.src_ts_ms", "e.emit_ts_ms", "e.mode")
    dumps.write_dump(events, path)
    return dumps.read_dump(spark, path).groupBy("op", "mode", F.col("doc.container").alias("container")).agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


DUMP_SQL = with_(fx.DOC_EVENTS) + "SELECT op, mode, 'src' || (CAST(substr(id, 5) AS BIGINT) % 20) AS container, count(*) AS n, CAST(sum(version) AS BIGINT) AS versions FROM doc_events WHERE op <> 'poison' GROUP BY 1, 2, 3"


def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of a user and type that stay if one counts for twelve hours."""
    from ..session import table

    e = table(spark, sf_dir, "events").withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return pipelines.deduplicated_batch(e, "k", "ts", "event_id", 43_200)


DEDUP_SQL = """
WITH l AS (SELECT user_id || ':' || event_type AS k, list({'t': epoch_us(ts), 'e': event_id} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
r AS (SELECT k, list_reduce(list_transform(l, lambda x: [x]), lambda kept, x: CASE WHEN x[1].t - kept[-1].t > 43200000000 THEN list_concat(kept, x) ELSE kept END) AS kept FROM l)
SELECT k, unnest(list_transform(kept, lambda x: x.e)) AS event_id FROM r
"""

def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the documents once a container is purged, by container."""
    return fold.without_container(fx.docs(spark, sf_dir), "src3").groupBy("container").agg(F.count("*").alias("n"))


PURGE_SQL = with_(fx.DOCS) + "SELECT container, count(*) AS n FROM docs WHERE container IS DISTINCT FROM 'src3' GROUP BY container"

def schema_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state table that three versions of a program have written, each with one column more, a third of the log each."""
    from ..streaming.store import Table

    path, kinds = scratch(spark, "versions"), ["id string", "version long", "title string", "body string"]
    events = fx.doc_events(spark, sf_dir).filter("op = 'upsert'")
    most = events.agg(F.max("off")).first()[0] or 0
    for part in range(3):
        own = events.filter(F.floor(F.col("off") * 3 / F.lit(most + 1)) == part)
        names = [k.split()[0] for k in kinds[1 : part + 2]]
        rows = own.groupBy("id").agg(F.max_by(F.struct(*names), "off").alias("r")).select("id", "r.*")
        table = Table(spark, path, ["id"], ", ".join(kinds[: part + 2]))
        table.upsert(rows, part)
    return table.read()


SCHEMA_SQL = (
    with_(fx.DOC_EVENTS)
    + """, parts AS (SELECT *, floor(off * 3 / (max(off) OVER () + 1)) AS part FROM doc_events WHERE op = 'upsert')
SELECT id, version, CASE WHEN part >= 1 THEN title END AS title, CASE WHEN part >= 2 THEN body END AS body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off DESC) AS r FROM parts) WHERE r = 1"""
)


QUERIES = {
    "q_fold_state": fold_state, "q_fold_discards": fold_discards, "q_expected_applies": expected_applies, "q_replay_noop": replay_noop, "q_content_hash": content_hashes, "q_embed_text": embed_texts,
    "q_embed_backlog": embed_backlog, "q_vector_cas": vector_cas, "q_freshness": freshness, "q_converge": chaos_convergence, "q_stream_fold": stream_fold, "q_stream_replay": stream_replay,
    "q_keyed_fold": keyed_fold, "q_keyed_counts": keyed_counts, "q_dlq_quarantine": dead_letters, "q_dump_round_trip": dump_round_trip, "q_dedup_ttl": dedup_ttl, "q_purge": purged, "q_schema_log": schema_log,
}
ORACLE_SQL = {
    "q_fold_state": STATE_SQL, "q_fold_discards": DISCARDS_SQL, "q_expected_applies": EXPECTED_SQL, "q_replay_noop": REPLAY_SQL, "q_content_hash": CONTENT_SQL, "q_embed_text": EMBED_TEXT_SQL,
    "q_embed_backlog": BACKLOG_SQL, "q_vector_cas": CAS_SQL, "q_freshness": FRESH_SQL, "q_converge": CHAOS_SQL, "q_stream_fold": STATE_SQL, "q_stream_replay": STREAM_REPLAY_SQL,
    "q_keyed_fold": STATE_SQL, "q_keyed_counts": KEYED_SQL, "q_dlq_quarantine": DLQ_SQL, "q_dump_round_trip": DUMP_SQL, "q_dedup_ttl": DEDUP_SQL, "q_purge": PURGE_SQL, "q_schema_log": SCHEMA_SQL,
}
