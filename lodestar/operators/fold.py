"""The changelog fold: versioned upserts, deletes and poison of documents to their current state.

Everything is window functions and aggregates on one hash partitioning by id, so a batch is shuffled once, whatever the number of events of a document; a document's events are ordered by their place in the log, never by time.

- An event is applied if its version is above all before it (stored, or earlier in the batch); equal ones are duplicates, lower ones stale.
- Poison (an unreadable record) hides its document until an applied event whose source time is later than the poison's.
- Deletes leave tombstones with their version, so late upserts can't bring a document back.

Folding any events again, in any cut into batches, ends in the same state. Empty batches change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import content_hash
from ..schemas import CONTENT, ITEM, STATE


def empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def items(df: DataFrame) -> DataFrame:
    """df with all columns of an item; those that it lacks are null."""
    types = dict(x.strip().rsplit(" ", 1) for x in ITEM.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def gate(batch: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The items of a batch with applied, reason (duplicate or stale, of events that aren't), hash, changed (a new text) and survives (poison that still hides), and the stored s_version, s_poison and s_hash."""
    b = items(batch)
    stored = empty(b, STATE) if state is None else state
    kept = stored.select("id", F.col("version").alias("s_version"), F.col("quarantined_at_ms").alias("s_poison"), F.col("content_hash").alias("s_hash"))
    b = b.join(kept, "id", "left").withColumn("hash", F.when(F.col("op") == "upsert", content_hash(F.col("title"), F.col("body"))))
    w = Window.partitionBy("id").orderBy("off")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # What comes after, from the last on: a frame up to the end would be read again for each of a document's events.
    after = Window.partitionBy("id").orderBy(F.desc("off")).rowsBetween(Window.unboundedPreceding, -1)
    event = F.col("op") != "poison"
    # A stub that only poison made has version 0.
    seen = F.greatest(F.max(F.when(event, F.col("version")).otherwise(F.lit(0))).over(before), F.col("s_version"))
    b = b.withColumn("seen", seen).withColumn("applied", event & (F.col("seen").isNull() | (F.col("version") > F.col("seen"))))
    b = b.withColumn("reason", F.when(event & ~F.col("applied"), F.when(F.col("version") == F.col("seen"), "duplicate").otherwise("stale")))
    running = F.last(F.when(F.col("applied"), F.coalesce("hash", F.lit(""))), ignorenulls=True).over(before)
    later = F.max(F.when(F.col("applied"), F.coalesce("src_ts_ms", F.lit(0)))).over(after)
    return b.withColumn(
        "changed", F.col("applied") & (F.col("op") == "upsert") & (F.col("hash") != F.coalesce(running, F.col("s_hash"), F.lit("")))
    ).withColumn("survives", ~event & (F.col("at_ms") > 0) & F.coalesce(later <= F.col("at_ms"), F.lit(True)))


def fold(batch: DataFrame, state: DataFrame | None = None, now_ms: int = 0, gated: DataFrame | None = None) -> DataFrame:
    """The new rows of the documents that a batch changes. gated: gate(batch, state), if it is there already."""
    g = gate(batch, state) if gated is None else gated
    applied, up = F.col("applied"), F.col("applied") & (F.col("op") == "upsert")
    at = F.when(applied, F.col("off"))
    per = g.groupBy("id").agg(
        F.count_if(applied).alias("n_applied"),
        F.count_if(F.col("op") == "poison").alias("n_poison"),
        F.max_by(F.struct("op", "version", "src_ts_ms", "emit_ts_ms"), at).alias("last"),
        F.max_by(F.struct(*CONTENT, "mode", "hash"), F.when(up, F.col("off"))).alias("up"),
        F.max_by("created_at", F.when(up & F.col("created_at").isNotNull(), F.col("off"))).alias("n_created"),
        F.max_by("updated_at", F.when(up & F.col("updated_at").isNotNull(), F.col("off"))).alias("n_updated"),
        F.max(F.when(F.col("survives"), F.col("at_ms"))).alias("b_poison"),
        F.first("s_poison").alias("s_poison"),
        F.max(F.when(applied, F.coalesce("src_ts_ms", F.lit(0)))).alias("n_src"),
        F.bool_or("changed").alias("changed"),
    ).filter("n_applied > 0 or n_poison > 0")
    stored = empty(g, STATE) if state is None else state
    s = stored.select("id", *[F.col(c).alias(f"s_{c}") for c in stored.columns if c != "id" and c != "quarantined_at_ms"])
    j = per.join(s, "id", "left")
    deleted, wrote = F.col("last.op") == "delete", F.col("up").isNotNull()
    none = F.array().cast("array<string>")
    old = F.when((F.col("s_poison") > 0) & F.coalesce(F.col("n_src") <= F.col("s_poison"), F.lit(True)), F.col("s_poison"))
    poison = F.coalesce(F.greatest("b_poison", old), F.lit(0))

    def content(c: str, blank=None):
        kept = F.when(wrote, F.col(f"up.{c}")).otherwise(F.col(f"s_{c}"))
        return kept if blank is None else F.when(F.coalesce(deleted, F.lit(False)), blank).otherwise(F.coalesce(kept, blank) if c in ("allowed", "labels", "duplicates") else kept)

    columns = {c: content(c) for c in ("datasource", "container", "kind", "url", "author", "parent_id", "mode")}
    columns |= {c: content(c, F.lit("")) for c in ("title", "body")} | {c: content(c, none) for c in ("labels", "duplicates", "allowed")}
    columns["content_hash"] = F.when(deleted, F.lit("")).when(wrote, F.col("up.hash")).otherwise(F.col("s_content_hash"))
    columns |= {c: F.coalesce(F.col(f"n_{c[:7]}"), F.col(f"s_{c}")) for c in ("created_at", "updated_at")}
    columns |= {c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(f"s_{c}")) for c in ("src_ts_ms", "emit_ts_ms")}
    columns["version"] = F.coalesce(F.col("last.version"), F.col("s_version"), F.lit(0))
    columns["needs_embed"] = F.when(deleted, F.lit(False)).when(F.col("changed"), F.lit(True)).otherwise(F.coalesce("s_needs_embed", F.lit(False)))
    columns["deleted"] = F.coalesce(deleted, F.col("s_deleted"), F.lit(False))
    columns["quarantined"], columns["quarantined_at_ms"] = poison > 0, poison
    columns["indexed_at_ms"] = F.lit(now_ms).cast("long")
    columns |= {c: F.col(f"s_{c}") for c in ("embed_hash", "embedding")}
    types = dict(x.strip().rsplit(" ", 1) for x in STATE.split(", "))
    return j.select(*[("id" if c == "id" else columns[c].cast(t).alias(c)) for c, t in types.items()])


def merged(state: DataFrame | None, changed: DataFrame) -> DataFrame:
    """The whole state after a batch."""
    return changed if state is None else state.join(changed.select("id"), "id", "left_anti").select(*changed.columns).unionByName(changed)


def discards(gated: DataFrame) -> DataFrame:
    return gated.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def expected_applies(events: DataFrame) -> DataFrame:
    """(id, applies): how many events of each document are above all before them."""
    before = Window.partitionBy("id").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("version").over(before)
    return events.select("id", (top.isNull() | (F.col("version") > top)).alias("a")).groupBy("id").agg(F.count_if("a").alias("applies"))


def freshness(gated: DataFrame, now_ms) -> DataFrame:
    """(id, off, lag_ms) of applied live events with a source time that isn't later than now."""
    src, now = F.col("src_ts_ms"), F.lit(now_ms)
    return gated.filter(F.col("applied") & (F.col("mode") == "live") & (src > 0) & (src <= now)).select("id", "off", (now - src).alias("lag_ms"))


def write_vectors(state: DataFrame, vectors: DataFrame) -> DataFrame:
    """state with vectors (id, content_hash, embedding) where the text is still the one that was embedded; other vectors are dropped."""
    v = vectors.select("id", F.col("content_hash").alias("v_hash"), F.col("embedding").alias("v_embedding"))
    ok = F.coalesce(F.col("v_hash") == F.col("content_hash"), F.lit(False)) & ~F.col("deleted")
    j = state.join(v, "id", "left")
    new = {"embedding": F.when(ok, F.col("v_embedding")).otherwise(F.col("embedding")), "embed_hash": F.when(ok, F.col("v_hash")).otherwise(F.col("embed_hash")), "needs_embed": F.when(ok, F.lit(False)).otherwise(F.col("needs_embed"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])


def backlog(state: DataFrame) -> DataFrame:
    """Documents that wait for a vector: hidden ones too, deleted ones not."""
    return state.filter("needs_embed and not deleted")


def without_container(state: DataFrame, container: str) -> DataFrame:
    return state.filter(~F.col("container").eqNullSafe(container))
