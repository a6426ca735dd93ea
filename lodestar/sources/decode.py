"""Keyed log records to typed events; what can't be read is told apart from what is skipped on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_time
from ..schemas import DOC_EVENT, EDGE_EVENT, blank, doc_problem, edge_problem


def _parsed(records: DataFrame, schema: str) -> DataFrame:
    e = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # As a row of its own: filters on what comes of e would otherwise parse the value again for each field that they name.
    return records.select("*", F.explode(F.array(e)).alias("e"))


def decode_docs(records: DataFrame) -> DataFrame:
    """records with kind (event, poison, skip), problem and e, the event. Records without a value are skipped; refused are unreadable or malformed ones and those whose key isn't the document's id."""
    r = _parsed(records, DOC_EVENT)
    problem = (
        F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "unreadable")
        .when(F.col("e.doc").isNull(), "no doc id")
        .otherwise(F.coalesce(doc_problem(F.col("e.op"), F.col("e.doc"), F.col("e.version")), F.when(~F.col("key").eqNullSafe(F.col("e.doc.id")), "key is not the doc id")))
    )
    return _kinds(r, problem)


def decode_edges(records: DataFrame) -> DataFrame:
    """The same for edges, whose key is from|to."""
    r = _parsed(records, EDGE_EVENT)
    src, dst = F.col("e.from"), F.col("e.to")
    problem = F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "unreadable").otherwise(
        F.coalesce(edge_problem(src, dst, F.col("e.version")), F.when(~F.col("key").eqNullSafe(F.concat_ws("|", src, dst)), "key is not the edge"))
    )
    return _kinds(r, problem)


def _kinds(r: DataFrame, problem) -> DataFrame:
    skip = F.col("value").isNull()
    r = r.withColumn("problem", F.when(~skip, problem))
    return r.withColumn("kind", F.when(skip, "skip").when(F.col("problem").isNotNull(), "poison").otherwise("event"))


def doc_items(decoded: DataFrame) -> DataFrame:
    """What the fold takes: events, and poison with a key, which hides that document from its record's time on."""
    d = decoded.filter((F.col("kind") == "event") | (F.col("kind") == "poison") & ~blank(F.col("key")))
    event = F.col("kind") == "event"
    names = ("datasource", "container", "kind", "title", "body", "url", "author", "parent_id", "labels", "duplicates", "allowed")
    return d.select(
        F.when(event, F.col("e.doc.id")).otherwise(F.col("key")).alias("id"), F.col("offset").alias("off"), F.when(event, F.col("e.op")).otherwise("poison").alias("op"),
        *[F.when(event, F.col(f"e.{c}")).alias(c) for c in ("version", "src_ts_ms", "emit_ts_ms", "mode")], F.when(~event, F.col("ts_ms")).alias("at_ms"),
        *[F.when(event, F.col(f"e.doc.{c}")).alias(c) for c in names], *[F.when(event, iso_time(F.col(f"e.doc.{c}"))).alias(c) for c in ("created_at", "updated_at")],
    )


def edge_items(decoded: DataFrame) -> DataFrame:
    """(src, dst, present, version, src_ts_ms, off) of the readable edges."""
    e = decoded.filter(F.col("kind") == "event")
    return e.select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.coalesce("e.present", F.lit(False)).alias("present"), "e.version", "e.src_ts_ms", F.col("offset").alias("off"))


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Refused records as they came, with the reason and where they stood as headers."""
    headers = F.create_map(F.lit("dlq-error"), F.col("problem"), F.lit("dlq-source-topic"), F.col("topic"), F.lit("dlq-source-partition"), F.col("partition").cast("string"), F.lit("dlq-source-offset"), F.col("offset").cast("string"))
    return decoded.filter(F.col("kind") == "poison").select("key", "value", F.concat(F.col("topic"), F.lit(".dlq")).alias("topic"), headers.alias("headers"))


def encode_docs(events: DataFrame) -> DataFrame:
    """(key, value) of document events (op, doc, version, src_ts_ms, emit_ts_ms, mode)."""
    return events.select(F.col("doc.id").alias("key"), F.to_json(F.struct("op", "doc", "version", "src_ts_ms", "emit_ts_ms", "mode")).alias("value"))


def encode_edges(edges: DataFrame, *keep: str) -> DataFrame:
    """(key, value) of edge events (src, dst, present, version, src_ts_ms), and the kept columns."""
    return edges.select(*keep, F.concat_ws("|", "src", "dst").alias("key"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "present", "version", "src_ts_ms")).alias("value"))
