"""Training-order materialisation of token ids: a keyed Feistel permutation gives every sequence its global slot, shards are fixed-stride files.

1. Whole texts are tokenised (byte-level BPE) and cut into sequences of LENGTH ids, the last one padded; every sequence gets a place: its task and its number in it. Written once, in blocks of some million ids that are compressed together: ids as ranks by frequency, so that most high bytes are 0.
2. The sequences of the tasks before it (one number for each task) and its own number give a dense index; a balanced Feistel network over the next even power of two permutes it, walking the cycle until it is below the number of sequences. The same key gives the same order.
3. Each shard is a range of SHARD slots. What a task has read goes to each shard as one compressed row (ids as ranks again, by what a bounded number of blocks holds: that changes the size only), its records take their places by slot, and are written with one size: doc_id (int64), sequence number (int32), ids (int32), ids as uint16. So slot s is at byte (s % SHARD) * STRIDE of shard s // SHARD, and a reader can go on from any slot.

Files get their name when complete; a task that runs again writes the same bytes. Null and empty texts have no sequences; empty tables give no shards and an empty result; repeated rows each have sequences of their own; other columns are ignored; a null doc_id is written as the least int64 and read as null.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, PAD, KEY, ROUNDS = 256, 0xFFFF, 0x5EED, 6
SHARD = 32_768
RECORD = np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4"), ("ids", "<u2", LENGTH)])
STRIDE = RECORD.itemsize
#: Ids of a block of the table, ids that a task gathers for the shards, and the blocks whose ids rank those on their way there.
BLOCK, GATHERED, RANKING = 1 << 22, 1 << 25, 16
LEVEL = 6
_NULL = -(2**63)


@functools.lru_cache(2)
def _tokenizer(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """Ids of a whole text; a very long one is encoded in pieces that end before white space after a letter, where the pattern splits anyway."""
    encode, out, at = _tokenizer(vocabulary).encode_ordinary, [], 0
    while at < len(text):
        to = min(len(text), at + 500_000)
        while to < len(text) and not (text[to] == " " and text[to - 1].isalpha() and not text[to + 1 : to + 2].isspace()):
            to += 1
        out.append(np.array(encode(text[at:to]), np.uint16))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def permute(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slots of indices in [0, n), or the indices of slots: a keyed bijection."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        if back:
            for k in reversed(keys):
                left, right = right ^ (common.mix(left ^ k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (common.mix(right ^ k) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def _packed(*columns: np.ndarray) -> tuple[int, bytes]:
    """Size and compressed bytes of columns, one after the other."""
    raw = b"".join(c.tobytes() for c in columns)
    return len(raw), pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _unpacked(size: int, data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    """The columns again: n values of each kind, and what is left as uint16."""
    raw, out, at = pa.Codec("zstd").decompress(data, size, asbytes=True), [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, np.uint16, offset=at)]


def _by_frequency(ids: np.ndarray) -> np.ndarray:
    """All ids, the most frequent first."""
    return np.argsort(-np.bincount(ids, minlength=1 << 16), kind="stable").astype(np.uint16)


def _ranks(order: np.ndarray) -> np.ndarray:
    out = np.empty(1 << 16, np.uint16)
    out[order] = np.arange(1 << 16, dtype=np.uint16)
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours (modulo 2**64), the first value first; cumsum takes them back."""
    return np.diff(x, prepend=np.zeros(1, np.int64))


BLOCKS = "part int, first long, n long, size long, data binary, ranking binary"


def sequences(docs: DataFrame, vocabulary: str) -> DataFrame:
    """BLOCKS: of the sequences from place first on in a task, n of them, doc_ids, numbers and lengths, and their ids by ranking."""

    def block(part: int, first: int, rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([r[2] for r in rows])
        order = _by_frequency(ids)
        size, data = _packed(_steps(np.array([r[0] for r in rows], np.int64)), np.array([r[1] for r in rows], np.int32), np.array([len(r[2]) for r in rows], np.uint16), _ranks(order)[ids])
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([first]), pa.array([len(rows)]), pa.array([size]), pa.array([data], pa.binary()), pa.array([_packed(order)[1]], pa.binary())], ["part", "first", "n", "size", "data", "ranking"])

    def run(batches):
        part, place, held, rows = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                ids = token_ids(text.as_py(), vocabulary) if text.is_valid else np.zeros(0, np.uint16)
                d = doc_id.as_py() if doc_id.is_valid else _NULL
                for i in range(0, len(ids), LENGTH):
                    rows.append((d, i // LENGTH, ids[i : i + LENGTH]))
                    held += LENGTH
                    if held >= BLOCK:
                        yield block(part, place, rows)
                        place += len(rows)
                        held, rows = 0, []
        if rows:
            yield block(part, place, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def _shard_path(uri: str, shard: int) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs, f"{path}/{shard:09d}.bin"


def materialise(docs: DataFrame, uri: str, vocabulary: str | None = None, key: int = KEY) -> int:
    """Writes all sequences as shards below uri; how many there are."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    made, path = sequences(docs, vocabulary), common.scratch(docs.sparkSession, "sequences")
    made.write.option("compression", "uncompressed").parquet(path)
    seqs = docs.sparkSession.read.schema(made.schema).parquet(path)
    counts = {r.part: r.n for r in seqs.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number for each task
    n = sum(counts.values())
    if not n:
        return 0
    starts, total = np.zeros(max(counts) + 1, np.int64), 0
    for part in sorted(counts):
        starts[part] = total
        total += counts[part]
    places = np.zeros(1 << 16, np.int64)
    for r in seqs.select("ranking").limit(RANKING).collect():
        order = np.frombuffer(pa.Codec("zstd").decompress(r.ranking, 1 << 17, asbytes=True), np.uint16)
        places += _ranks(order)
    shared = docs.sparkSession.sparkContext.broadcast((starts, np.argsort(places, kind="stable").astype(np.uint16)))

    def slots(batches):
        held: list[tuple] = []
        starts, order = shared.value
        ranks = _ranks(order)

        def sent():
            index, doc_id, seq_no, ns = (np.concatenate(c) for c in zip(*(h[:4] for h in held), strict=True))
            ids = ranks[np.concatenate([h[4] for h in held])]
            held.clear()
            ends = ns.astype(np.int64).cumsum()
            slot = permute(index, n, key)
            by = np.argsort(slot // SHARD, kind="stable")
            out = []
            for rows in np.split(by, np.flatnonzero(np.diff(slot[by] // SHARD)) + 1):
                mine = np.concatenate([ids[ends[i] - ns[i] : ends[i]] for i in rows.tolist()])
                out.append((int(slot[rows[0]] // SHARD), len(rows), *_packed(_steps(doc_id[rows]), seq_no[rows], (slot[rows] % SHARD).astype(np.uint16), ns[rows], mine)))
            for lo in range(0, len(out), 64):
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 64], strict=True), kinds, strict=True)], ["shard", "records", "size", "data"])

        for batch in batches:
            for part, first, m, size, data, ranking in zip(*batch.columns, strict=True):
                m = m.as_py()
                steps, seq_no, ns, ids = _unpacked(size.as_py(), data.as_buffer(), m, ["<i8", "<i4", "<u2"])
                own = np.frombuffer(pa.Codec("zstd").decompress(ranking.as_buffer(), 1 << 17, asbytes=True), np.uint16)
                held.append((starts[part.as_py()] + first.as_py() + np.arange(m), steps.cumsum(), seq_no, ns, own[ids]))
                if sum(len(h[4]) for h in held) >= GATHERED:
                    yield from sent()
        if held:
            yield from sent()

    def write(batches):
        shard, records, filled, order = None, None, 0, shared.value[1]

        def end():
            if filled != len(records):
                raise RuntimeError(f"shard {shard} has {filled} of {len(records)} sequences")
            fs, path = _shard_path(uri, shard)
            fs.create_dir(os.path.dirname(path), recursive=True)
            unfinished = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(unfinished) as f:
                f.write(records.tobytes())
            fs.move(unfinished, path)
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([filled], pa.int64())], ["shard", "records"])

        for batch in batches:
            for at, m, size, data in zip(*(batch.column(c) for c in ("shard", "records", "size", "data")), strict=True):
                if at.as_py() != shard:
                    if shard is not None:
                        yield end()
                    shard, filled = at.as_py(), 0
                    records = np.zeros(min(SHARD, n - shard * SHARD), RECORD)
                    records["ids"] = PAD
                steps, seq_no, place, ns, ids = _unpacked(size.as_py(), data.as_buffer(), m.as_py(), ["<i8", "<i4", "<u2", "<u2"])
                records["doc_id"][place], records["seq_no"][place], records["n_tokens"][place] = steps.cumsum(), seq_no, ns
                many = ns.astype(np.int64)
                records["ids"][np.repeat(place, many), np.arange(len(ids)) - np.repeat(many.cumsum() - many, many)] = order[ids]
                filled += len(place)
        if shard is not None:
            yield end()

    placed = seqs.mapInArrow(slots, "shard int, records int, size long, data binary")
    written = placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(write, "shard int, records long")
    if (w := written.agg(F.sum("records")).first()[0]) != n:
        raise RuntimeError(f"{w} of {n} sequences were written")
    return n


def read_slots(uri: str, start: int, stop: int) -> Iterator[np.ndarray]:
    """Records of the slots from start on, a shard at a time, reading only those bytes."""
    while start < stop:
        fs, path = _shard_path(uri, start // SHARD)
        to = min(stop, (start // SHARD + 1) * SHARD)
        with fs.open_input_file(path) as f:
            yield np.frombuffer(f.read_at((to - start) * STRIDE, start % SHARD * STRIDE), RECORD)
        start = to


def read_back(spark: SparkSession, uri: str, n: int) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq_no, n_tokens, ids_sha256) of all records, from the shards."""

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                at = shard * SHARD
                for lo in range(at, min(n, at + SHARD), 4096):
                    r = next(read_slots(uri, lo, min(n, at + SHARD, lo + 4096)))
                    slot = np.arange(lo, lo + len(r))
                    digests = [hashlib.sha256(x[:k].tobytes()).hexdigest() for x, k in zip(r["ids"], r["n_tokens"].tolist(), strict=True)]
                    doc_ids = pa.array(r["doc_id"], mask=r["doc_id"] == _NULL)
                    yield pa.record_batch([pa.array(slot), pa.array(np.full(len(r), shard, np.int32)), pa.array(slot % SHARD * STRIDE), doc_ids, pa.array(np.ascontiguousarray(r["seq_no"])), pa.array(np.ascontiguousarray(r["n_tokens"])), pa.array(digests)], ["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "ids_sha256"])

    shards = -(-n // SHARD)
    return spark.range(0, shards, 1, max(1, shards)).mapInArrow(run, "slot long, shard int, byte_offset long, doc_id long, seq_no int, n_tokens int, ids_sha256 string")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = common.scratch(spark, "shards")
    return read_back(spark, uri, materialise(common.table(spark, sf_dir, "documents"), uri))
