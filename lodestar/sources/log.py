"""A keyed log in a shared folder, as a Python data source: what producers write and pipelines read where no broker is at hand.

Tasks write files of their own aside and name them in their commit messages; only the commit, once all tasks are done, makes them part of the log, by one manifest that gives each record its offset. A task that fails midway, or a batch that does, leaves no record. A stream's batch has its number in its manifest's name, so a batch that is done again is written once.

Records with equal keys share a partition. produce() deals them out so that a partition comes from one task, in the order given. One writer commits at a time.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..schemas import RECORD

PARTITIONS = 6
#: Records of a file, about: a task that reads has one file.
ROWS = 500_000
_FILE = pa.schema([("key", pa.string()), ("value", pa.string()), ("ts_ms", pa.int64())])


class _Folder:
    """The log's manifests, in their order, and its files."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """Whole or not at all: under another name first."""
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        for folder in ("aside", name.rpartition("/")[0]):
            self.fs.create_dir(f"{self.path}/{folder}", recursive=True)
        with self.fs.open_output_stream(aside) as f:
            f.write(data)
        self.fs.move(aside, f"{self.path}/{name}")

    def manifests(self) -> list[dict]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        return sorted((json.loads(self.read(f"commits/{i.base_name}")) for i in found if i.base_name.endswith(".json")), key=lambda m: m["place"])

    def commit(self, messages, name: str) -> None:
        """Makes the files that messages name part of the log, unless a commit of this name is there already."""
        staged = [f for m in messages if m is not None for f in m.files]
        done = self.manifests()
        if any(m["name"] == name for m in done):
            self.drop(staged)
            return
        last, files = done[-1]["next"] if done else {}, []
        for partition, file, n in sorted(staged, key=lambda f: f[0]):
            files.append({"partition": partition, "file": file, "n": n, "base": last.get(str(partition), 0)})
            last = last | {str(partition): files[-1]["base"] + n}
        self.write(f"commits/{name}.json", json.dumps({"name": name, "place": len(done), "files": files, "next": last}).encode())

    def drop(self, files: list) -> None:
        for _, file, _ in files:
            if self.fs.get_file_info(f"{self.path}/{file}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.path}/{file}")


class _Message(WriterCommitMessage):
    def __init__(self, files: list[tuple[int, str, int]]):
        self.files = files


def _columns(batch: pa.RecordBatch) -> pa.RecordBatch:
    """key, value and ts_ms of a batch, null where it lacks them."""
    has = lambda f: batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type)
    return pa.RecordBatch.from_arrays([has(f) for f in _FILE], schema=_FILE)


def _staged(options: dict, batches) -> _Message:
    """Writes a task's records, files of about ROWS records for each partition, batch by batch."""
    folder, n = _Folder(options["path"]), int(options.get("partitions", PARTITIONS))
    out, files = {}, []
    folder.fs.create_dir(f"{folder.path}/files", recursive=True)
    try:
        for batch in map(_columns, batches):
            keys = batch.column("key").dictionary_encode()
            of = np.array([zlib.crc32(k.encode()) % n for k in keys.dictionary.to_pylist()] + [zlib.crc32(b"") % n], np.int64)
            parts = of[keys.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]
            for p in np.unique(parts).tolist():
                if p not in out:
                    name = f"files/{uuid.uuid4().hex}-{p}.arrow"
                    sink = folder.fs.open_output_stream(f"{folder.path}/{name}")
                    out[p] = [pa.ipc.new_stream(sink, _FILE, options=pa.ipc.IpcWriteOptions(compression="zstd")), sink, name, 0]
                own = batch.filter(pa.array(parts == p))
                out[p][0].write_batch(own)
                out[p][3] += own.num_rows
                if out[p][3] >= ROWS:
                    files.append(_closed(p, out.pop(p)))
    finally:
        files += [_closed(p, out[p]) for p in sorted(out)]
    return _Message(files)


def _closed(partition: int, opened: list) -> tuple[int, str, int]:
    writer, sink, name, n = opened
    writer.close()
    sink.close()
    return partition, name, n


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options, self.name = options, options.get("commit") or f"write-{uuid.uuid4().hex}"

    def write(self, iterator):
        return _staged(self.options, iterator)

    def commit(self, messages):
        _Folder(self.options["path"]).commit(messages, self.name)

    def abort(self, messages):
        _Folder(self.options["path"]).drop([f for m in messages if m is not None for f in m.files])


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        return _staged(self.options, iterator)

    def commit(self, messages, batchId):
        _Folder(self.options["path"]).commit(messages, f"{self.options.get('writer', 'stream')}-{batchId}")

    def abort(self, messages, batchId):
        _Folder(self.options["path"]).drop([f for m in messages if m is not None for f in m.files])


class _Part(InputPartition):
    def __init__(self, partition: int, file: str, base: int):
        self.partition, self.file, self.base = partition, file, base


def _records(options: dict, part: _Part):
    """The batches of a file, one at a time."""
    folder, topic, at = _Folder(options["path"]), options.get("topic", "log"), part.base
    with folder.fs.open_input_stream(f"{folder.path}/{part.file}") as f, pa.ipc.open_stream(f) as batches:
        for b in batches:
            n = b.num_rows
            same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)  # noqa: E731, B023
            places = pa.array(np.arange(at, at + n, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("value"), same(topic, pa.string()), same(part.partition, pa.int32()), places, b.column("ts_ms")], ["key", "value", "topic", "partition", "offset", "ts_ms"])
            at += n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        parts = [_Part(f["partition"], f["file"], f["base"]) for m in _Folder(self.options["path"]).manifests() for f in m["files"]]
        return parts or [InputPartition(None)]

    def read(self, partition):
        if isinstance(partition, _Part):
            yield from _records(self.options, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of commits."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(_Folder(self.options["path"]).manifests())}

    def partitions(self, start, end):
        own = _Folder(self.options["path"]).manifests()[start["commits"] : end["commits"]]
        return [_Part(f["partition"], f["file"], f["base"]) for m in own for f in m["files"]]

    def read(self, partition):
        yield from _records(self.options, partition)


class Log(DataSource):
    """Options: path; partitions (of writers); topic (that readers give); writer (a stream's name) or commit (a write's name): what bears a name is written once."""

    @classmethod
    def name(cls):
        return "log"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Log)


def dealt(records: DataFrame, order: str | Column, partitions: int = PARTITIONS) -> DataFrame:
    """records (key, value, ...) with each partition of the log in one task, by order."""
    p = F.crc32(F.coalesce("key", F.lit(""))) % partitions
    return records.withColumn("_p", p).repartition(partitions, "_p").sortWithinPartitions("_p", order).drop("_p")


def produce(records: DataFrame, path: str, order: str | Column, commit: str = "", partitions: int = PARTITIONS) -> None:
    """Appends records (key, value, and ts_ms if it is there) to a log, in one commit. commit: its name; one that is there already isn't written again."""
    writer = dealt(records, order, partitions).write.format("log").mode("append").option("path", path).option("partitions", partitions)
    (writer.option("commit", commit) if commit else writer).save()
