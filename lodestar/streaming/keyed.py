"""The fold as a keyed stateful operator: the whole document in Spark's state store (RocksDB), so that a batch reads the documents that it changes and no others, and the state needs no table, no deltas and no compaction.

What comes of a document in a batch is ordered by its place in the log, whatever the order in which it arrives. Rows come as they are, as building a frame for each document takes longer than folding it. Of a document with more than HELD upserts in a batch only numbers stay in memory; what they carry waits in a list in the state store until it is known which of them count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import content_hash
from ..schemas import CONTENT, STATE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LISTS = ("labels", "duplicates", "allowed")
_TIMES = ("created_at", "updated_at")
#: The stored document: STATE without its key, times in microseconds.
_FIELDS = [x.strip().rsplit(" ", 1) for x in STATE.split(", ")][1:]
DOCUMENT = ", ".join(f"{c} {'long' if c in _TIMES else t}" for c, t in _FIELDS)
NAMES = [c for c, _ in _FIELDS]
#: What an upsert carries, and its place in the log.
CARRIED = [*CONTENT, "mode", "hash"]
_PENDING = "off long, " + ", ".join(f"{c} {'array<string>' if c in LISTS else 'string'}" for c in CARRIED)
#: What the fold looks at in every event.
_EVENT = ["off", "op", "version", "src_ts_ms", "emit_ts_ms", "at_ms", *_TIMES, "hash"]
#: Upserts of a document whose texts a task holds at once.
HELD = 64
COUNTS = ["applied", "duplicate", "stale"]
OUT = "id string, " + DOCUMENT + ", " + ", ".join(f"{c} long" for c in COUNTS)


class Fold(StatefulProcessor):
    """Rows of one document to its new state; a document of which nothing was applied or poisoned gives no row unless counts are asked for."""

    def __init__(self, now_ms: int = 0):
        self.now_ms = now_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", DOCUMENT)
        self.pending = handle.getListState("pending", _PENDING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events, held, spilled = [], [], False
        for r in rows:
            e = json.loads(r.event)
            events.append(tuple(map(e.get, _EVENT)))
            if r.carried is not None:
                held.append((e["off"], r.carried))
            if len(held) == HELD:
                # From here on what they carry goes to the state store.
                self.pending.appendList([(off, *map(json.loads(text).get, CARRIED)) for off, text in held])
                held, spilled = [], True
        events.sort(key=lambda e: e[0])
        old = self.document.get()
        now = dict(zip(NAMES, old, strict=True)) if old is not None else dict.fromkeys(NAMES) | {"deleted": False, "needs_embed": False, "quarantined_at_ms": 0} | {c: [] for c in LISTS}
        version, poison = now["version"], now["quarantined_at_ms"] or 0
        upsert, n, poisoned = None, dict.fromkeys(COUNTS, 0), False
        for off, op, v, src, emit, at, created, updated, digest in events:
            if op == "poison":
                poisoned, version = True, version or 0
                poison = max(poison, at or 0)
                continue
            if version is not None and v <= version:
                n["duplicate" if v == version else "stale"] += 1
                continue
            n["applied"] += 1
            version = v
            poison = 0 if (src or 0) > poison else poison
            now |= {"src_ts_ms": src, "emit_ts_ms": emit, "deleted": op == "delete"}
            if op == "delete":
                now |= {"needs_embed": False, "content_hash": ""}
            else:
                upsert = off
                now["needs_embed"] = now["needs_embed"] or digest != (now["content_hash"] or "")
                now["content_hash"] = digest
                now |= {c: t for c, t in zip(_TIMES, (created, updated), strict=True) if t is not None}
        if upsert is not None:
            now |= self._carried(held, upsert)
        if n["applied"] and now["deleted"]:
            now |= {"title": "", "body": ""} | {c: [] for c in LISTS}
        if spilled:
            self.pending.clear()
        if n["applied"] or poisoned:
            now |= {"version": version, "quarantined": poison > 0, "quarantined_at_ms": poison, "indexed_at_ms": self.now_ms}
            self.document.update(tuple(now[c] for c in NAMES))
        yield Row(id=key[0], **now, **n)

    def _carried(self, held: list[tuple[int, str]], off: int) -> dict:
        """What the upsert at a place of the log sets."""
        text = next((x for o, x in held if o == off), None)
        if text is None:
            found = dict(zip(CARRIED, next(r for r in self.pending.get() if r[0] == off)[1:], strict=True))
        else:
            found = dict(zip(CARRIED, map(json.loads(text).get, CARRIED), strict=True))
        found.pop("hash")
        return found | {c: found[c] or [] for c in LISTS}

    def close(self) -> None:
        pass


def folded(items: DataFrame, now_ms: int = 0) -> DataFrame:
    """A stream of items (operators.fold.ITEM) to the documents that each micro-batch touches, as they are after it (OUT), with how many of their events were applied, duplicate or stale. Needs PROVIDER as the session's state store: use_rocksdb()."""
    micros = [F.unix_micros(c).alias(c) for c in _TIMES]
    digest = F.when(F.col("op") == "upsert", content_hash(F.col("title"), F.col("body"))).alias("hash")
    rows = items.select("id", "off", "op", "version", "src_ts_ms", "emit_ts_ms", "at_ms", *micros, *CONTENT, "mode", digest)
    # Two texts a row: each cell of a row costs its task about as much as all that the fold does with the row.
    carried = F.when(F.col("op") == "upsert", F.to_json(F.struct(*CARRIED)))
    rows = rows.select("id", F.to_json(F.struct(*_EVENT)).alias("event"), carried.alias("carried"))
    return rows.groupBy("id").transformWithState(Fold(now_ms), OUT, "update", "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def documents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All documents (operators.fold.STATE) that a stream's state store holds after its last batch; of any session, while the stream runs or not."""
    rows = spark.read.format("statestore").option("stateVarName", "document").load(checkpoint)
    kinds = dict(_FIELDS)
    value = [(F.timestamp_micros(F.col(f"value.{c}")) if c in _TIMES else F.col(f"value.{c}").cast(kinds[c])).alias(c) for c in NAMES]
    return rows.select(F.col("key.id").alias("id"), *value)
