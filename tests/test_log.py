"""The log: nothing of what fails, everything of what is committed, once."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.sources import dumps, log

KIND = "key string, value string, ts_ms long"


def records(spark, path):
    log.register(spark)
    return sorted((r.partition, r.offset, r.key, r.value) for r in spark.read.format("log").option("path", path).load().collect())


def rows(spark, lo, hi):
    return spark.range(lo, hi, 1, 4).select(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("ts_ms"))


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert records(spark, path) == []
    log.produce(rows(spark, 0, 100), path, "ts_ms")
    log.produce(rows(spark, 100, 120), path, "ts_ms")
    log.produce(spark.createDataFrame([(None, None, None)], KIND), path, "ts_ms")
    got = records(spark, path)
    for p in {r[0] for r in got}:
        own = [r for r in got if r[0] == p]
        assert [r[1] for r in own] == list(range(len(own)))  # offsets without gaps
        values = [int(r[3]) for r in own if r[3]]
        assert values == sorted(values)
    assert len({(r[2], r[0]) for r in got}) == 8  # a key has one partition
    assert sorted(int(r[3]) for r in got if r[3]) == list(range(120))


def test_files_are_bounded_and_read_by_batches(tmp_path):
    path, kept = f"file://{tmp_path}/log", log.ROWS
    batch = pa.RecordBatch.from_pydict({"key": ["a", None] * 50, "value": [str(i) for i in range(100)], "ts_ms": range(100)})
    log.ROWS = 150
    try:
        message = log._staged({"path": path, "partitions": "1"}, iter([batch] * 5))
    finally:
        log.ROWS = kept
    assert [(p, n) for p, _, n in message.files] == [(0, 200), (0, 200), (0, 100)]
    log._Folder(path).commit([message], "x")
    parts = log._Reader({"path": path}).partitions()
    got = [b for p in parts for b in log._Reader({"path": path}).read(p)]
    assert len(parts) == 3 and [b.num_rows for b in got] == [100] * 5
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["offset"] for r in rows] == list(range(500)) and [r["value"] for r in rows] == [str(i) for i in range(100)] * 5 and rows[1]["key"] is None


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log.register(spark)
    bad = rows(spark, 0, 1000).withColumn("value", F.when(F.col("ts_ms") == 900, F.raise_error(F.lit("midway"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="midway"):
        log.produce(bad, path, "ts_ms")
    assert records(spark, path) == []
    log.produce(rows(spark, 0, 10), path, "ts_ms")
    assert len(records(spark, path)) == 10


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log.register(spark)
    rows(spark, 0, 50).write.parquet(f"file://{tmp_path}/in")

    def run():
        df = spark.readStream.schema(KIND).parquet(f"file://{tmp_path}/in")
        df.writeStream.format("log").option("path", path).option("writer", "w").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    run()
    # Spark forgets that the batch was committed: it does it again under its number.
    for name in os.listdir(f"{tmp_path}/c/commits"):
        os.remove(f"{tmp_path}/c/commits/{name}")
    run()
    assert sorted(int(r[3]) for r in records(spark, path)) == list(range(50))
    files = {f for m in log._Folder(path).manifests() for f in [x["file"].split("/")[1] for x in m["files"]]}
    assert files == set(os.listdir(f"{tmp_path}/log/files"))  # the second try's files are gone


def test_dump_after_the_acknowledgement(spark, tmp_path):
    doc = "struct<id:string>"
    events = spark.createDataFrame([("upsert", ("d1",), 1, 2, 3, "live")], f"op string, doc {doc}, version long, src_ts_ms long, emit_ts_ms long, mode string")
    sent = []

    def send(df, name):
        sent.append((name, [r.key for r in df.collect()]))
        if len(sent) == 1:
            raise OSError("no acknowledgement")

    dump = f"{tmp_path}/dump"
    with pytest.raises(OSError):
        dumps.emit(events, 4, send, f"file://{dump}")
    assert not os.path.exists(dump)
    for _ in range(2):
        dumps.emit(events, 4, send, f"file://{dump}")
    assert [r.doc.id for r in dumps.read_dump(spark, f"file://{dump}/*").collect()] == ["d1"] and sent[0] == ("emit-4", ["d1"])
