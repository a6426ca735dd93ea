"""The two streams: documents into the state table, edges into the graph. Each has its own checkpoint, so one that stalls never holds up the other.

A micro-batch writes its dead letters, then its changes, and only then does Spark commit its offsets: at least once, and once in effect, because folding a batch again changes nothing. There is no watermark: lateness is judged by version, and keyed state never expires.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import fold as folding
from ..operators import graph
from ..schemas import RECORD, STATE
from ..sources import decode
from .store import Table

EDGE_STATE = "src string, dst string, present boolean, version long, src_ts_ms long"


def record_schema(spark: SparkSession) -> StructType:
    return spark.createDataFrame([], RECORD).schema


def retry(action: Callable[[], None], tries: int = 5, first_s: float = 0.1, most_s: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Runs action until it succeeds, waiting twice as long each time up to most_s; the last failure is raised."""
    wait = first_s
    for i in range(tries):
        try:
            return action()
        except Exception:
            if i + 1 == tries:
                raise
            sleep(wait)
            wait = min(most_s, 2 * wait)


def kafka_records(spark: SparkSession, servers: str, topics: str, most_per_batch: int = 100_000) -> DataFrame:
    """Records of topics from a broker (needs Spark's Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most_per_batch).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", F.floor(F.unix_micros("timestamp") / 1000).alias("ts_ms"))


def file_records(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Records that JSON files in a folder hold, new files as they come."""
    reader = spark.readStream.schema(record_schema(spark))
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def to_kafka(records: DataFrame, servers: str, topic: str | None = None) -> None:
    """Sends records (key, value, and topic unless one is given) to a broker; equal keys share a partition, so a document's events keep their order (needs Spark's Kafka connector on the class path)."""
    out = records.select(F.col("key").cast("binary"), F.col("value").cast("binary"), *([] if topic else ["topic"]))
    writer = out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
    (writer.option("topic", topic) if topic else writer).save()


class Documents:
    """Folds document records. path: a shared folder for state, dead letters and metrics. changed: called with each batch's changes and number once they are written (a feed's samples, an index)."""

    def __init__(self, spark: SparkSession, path: str, now_ms: Callable[[], int] | None = None, changed: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.path, self.changed = spark, path.rstrip("/"), changed
        self.state = Table(spark, f"{self.path}/state", ["id"], STATE)
        self.now_ms = now_ms or (lambda: int(time.time() * 1000))

    def batch(self, records: DataFrame, number: int) -> None:
        decoded = decode.decode_docs(records)
        # The records of a batch are bounded by the trigger's limit; they are read thrice.
        decoded = decoded.persist()
        try:
            # Dead letters first: if they can't be kept, the batch fails before anything moves.
            retry(lambda: decode.dead_letters(decoded).write.mode("overwrite").parquet(f"{self.path}/dlq/{number}"))
            items = decode.doc_items(decoded)
            state = self.state.read(before=number, buckets=self.state.touched(items, number))
            gated = folding.gate(items, state).persist()
            try:
                changed = folding.fold(gated, state, self.now_ms(), gated)
                self.state.upsert(changed, number)
                if self.changed:
                    self.changed(self.state.delta(number), number)
                counts = gated.groupBy(F.when(F.col("op") == "poison", "quarantine").when(F.col("applied"), "applied").otherwise(F.col("reason")).alias("what")).agg(F.count("*").alias("n"))
                counts.write.mode("overwrite").parquet(f"{self.path}/metrics/{number}")
            finally:
                gated.unpersist()
        finally:
            decoded.unpersist()

    def start(self, records: DataFrame, **trigger) -> StreamingQuery:
        """trigger: as writeStream.trigger takes it; by default all that is there, then an end."""
        return records.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame:
        state = self.state.read()
        return folding.empty(self.spark.range(0), STATE) if state is None else state

    def metrics(self) -> DataFrame:
        return self.spark.read.schema("what string, n long").parquet(f"{self.path}/metrics/*").groupBy("what").agg(F.sum("n").alias("n"))

    def dead_letters(self) -> DataFrame:
        return self.spark.read.schema("key string, value string, topic string, headers map<string,string>").parquet(f"{self.path}/dlq/*")


class Identity:
    """Folds edge records."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = Table(spark, f"{self.path}/edges", ["src", "dst"], EDGE_STATE)

    def batch(self, records: DataFrame, number: int) -> None:
        decoded = decode.decode_edges(records).persist()
        try:
            retry(lambda: decode.dead_letters(decoded).write.mode("overwrite").parquet(f"{self.path}/dlq/{number}"))
            items = decode.edge_items(decoded)
            state = self.state.read(before=number, buckets=self.state.touched(items, number))
            marked = graph.applied(items, state)
            # An edge's newest change of the batch, if any was applied; the table takes it over what is stored.
            changed = graph.latest(marked.filter("applied").drop("applied"))
            self.state.upsert(changed, number)
            marked.agg(F.count_if("applied").alias("applied")).write.mode("overwrite").parquet(f"{self.path}/epochs/{number}")
        finally:
            decoded.unpersist()

    def start(self, records: DataFrame, **trigger) -> StreamingQuery:
        return records.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame:
        state = self.state.read()
        return folding.empty(self.spark.range(0), EDGE_STATE) if state is None else state

    def epoch(self) -> int:
        """One for each applied change so far."""
        return self.spark.read.schema("applied long").parquet(f"{self.path}/epochs/*").agg(F.coalesce(F.sum("applied"), F.lit(0))).first()[0]


def deduplicated(deliveries: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """A stream of deliveries without those whose key came before within ttl."""
    return deliveries.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def deduplicated_batch(deliveries: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """The same for a table: (key, order) of the deliveries that stay. The first of a key is kept, then each one that comes more than so many seconds after the last that was kept.

    Rows stream through their key's task in order, with the last kept time as the only state.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = deliveries.select(F.col(key).alias("key"), F.col(order).alias("order"), at.alias("at"))
    span = seconds * 1_000_000

    def run(frames):
        last_key, last = None, 0
        for f in frames:
            keep = []
            for k, t in zip(f["key"], f["at"]):
                ok = k != last_key or t - last > span
                if ok:
                    last_key, last = k, t
                keep.append(ok)
            yield f.loc[keep, ["key", "order"]]

    kinds = f"key {rows.schema['key'].dataType.simpleString()}, order {rows.schema['order'].dataType.simpleString()}"
    return rows.repartition("key").sortWithinPartitions("key", "at", "order").mapInPandas(run, kinds).select(F.col("key").alias(key), F.col("order").alias(order))


def lag_of(progress: dict) -> list[tuple[str, int, int, int]]:
    """(topic, partition, latest, committed) of a Kafka query's progress."""
    import json

    out = []
    for source in progress.get("sources", []):
        end, latest = (json.loads(x) if isinstance(x, str) else x or {} for x in (source.get("endOffset"), source.get("latestOffset")))
        for topic, parts in (latest or {}).items():
            out += [(topic, int(p), int(n), int((end or {}).get(topic, {}).get(p, -1))) for p, n in parts.items()]
    return out
