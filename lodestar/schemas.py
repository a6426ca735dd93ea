"""The data model: documents, events, edges, and which of them are well formed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A document as sources send it; times are ISO 8601 text on the wire.
DOC = (
    "struct<id:string,datasource:string,container:string,kind:string,title:string,body:string,url:string,author:string,parent_id:string,"
    "labels:array<string>,duplicates:array<string>,created_at:string,updated_at:string,allowed:array<string>>"
)
DOC_EVENT = f"op string, doc {DOC}, version long, src_ts_ms long, emit_ts_ms long, mode string"
EDGE_EVENT = "`from` string, `to` string, present boolean, version long, src_ts_ms long"
#: A keyed record of a log.
RECORD = "key string, value string, topic string, partition int, offset long, ts_ms long"

#: What an upsert sets, besides id.
CONTENT = ["datasource", "container", "kind", "title", "body", "url", "author", "parent_id", "labels", "duplicates", "allowed"]
#: One row for each document ever seen, tombstones and hidden stubs included.
STATE = (
    "id string, datasource string, container string, kind string, title string, body string, url string, author string, parent_id string, "
    "labels array<string>, duplicates array<string>, allowed array<string>, created_at timestamp, updated_at timestamp, version long, "
    "src_ts_ms long, emit_ts_ms long, mode string, content_hash string, embed_hash string, embedding array<float>, needs_embed boolean, "
    "deleted boolean, quarantined boolean, quarantined_at_ms long, indexed_at_ms long"
)
#: What the fold takes: an upsert, delete or poison of one document at a place in the log.
ITEM = (
    "id string, off long, op string, version long, src_ts_ms long, emit_ts_ms long, mode string, at_ms long, datasource string, container string, "
    "kind string, title string, body string, url string, author string, parent_id string, labels array<string>, duplicates array<string>, "
    "allowed array<string>, created_at timestamp, updated_at timestamp"
)

USER, GROUP, CONTAINER = "u:", "g:", "c:"
EVERYONE = "g:everyone"
MODES = ("live", "backfill", "replay")


def is_principal(p: Column) -> Column:
    """A known prefix, a name after it, and no bar. Null: false."""
    return F.coalesce(p.rlike(r"(?s)^[ugc]:.+$") & ~p.contains("|"), F.lit(False))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def doc_problem(op: Column, doc: Column, version: Column) -> Column:
    """Why a document event is refused; null if it is well formed."""
    return (
        F.when(blank(doc["id"]), "no doc id")
        .when(F.coalesce(version, F.lit(0)) <= 0, "non-positive version")
        .when(op == "delete", None)
        .when(F.coalesce(op, F.lit("")) != "upsert", "unknown op")
        .when(blank(doc["datasource"]) | blank(doc["container"]), "missing datasource or container")
        .when(F.exists(F.coalesce(doc["allowed"], F.array().cast("array<string>")), lambda p: ~is_principal(p)), "malformed principal")
    )


def edge_problem(src: Column, dst: Column, version: Column) -> Column:
    """Why an edge event is refused; null if it is well formed."""
    return (
        F.when(~is_principal(src) | ~is_principal(dst), "malformed edge")
        .when(src.startswith(CONTAINER), "container as source")
        .when(dst.startswith(USER), "points at a user")
        .when(F.coalesce(version, F.lit(0)) <= 0, "non-positive version")
    )
