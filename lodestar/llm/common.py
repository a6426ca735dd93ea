"""What the operators share: tables, scratch folders, and vectorised word hashing over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once; texts are cut only at separators, so results don't depend on it.
SEGMENT = 1 << 19
_R = 0x9E3779B97F4A7C15
_C = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> str:
    """A column's name as df spells it, letters in either case, as in Spark's own look-up; one spelt exactly goes first."""
    same = [c for c in df.columns if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"there is no column {name} among {df.columns}")
    return name if name in same else same[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the cluster names; a temporary one only where none is named and all is one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict]:
    """saved(), and aggregates of df that Spark gathers while it writes: no job of their own."""
    seen = Observation()
    kept = saved(df.observe(seen, *[c.alias(k) for k, c in what.items()]), name)
    return kept, seen.get


def release() -> None:
    """Hands freed memory back to the system where that can be asked for: workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a long job: the driver's Python and JVM let go of what nothing refers to any more, whereupon Spark removes broadcasts and shuffle files of tables that are written by now."""
    release()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: int | None) -> bool:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    n = max(SEGMENT, 1 << (max(n, 1) - 1).bit_length())
    if n not in _powers:
        inverse = pow(_R, -1, 1 << 64)
        _powers.clear()
        _powers[n] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, r, np.uint64))]) for r in (_R, inverse))
    return _powers[n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def byte_tables(separators: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a word; its value with A-Z lowered."""
    word, value = np.ones(256, bool), np.arange(256, dtype=np.uint64) + np.uint64(1)
    word[list(separators)] = False
    if fold:
        value[65:91] += np.uint64(32)
    return word, value


#: Words are runs of anything but ASCII white space, A-Z lowered.
PLAIN = byte_tables(b" \t\n\v\f\r")
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
ALNUM = byte_tables(bytes(x for x in range(128) if not chr(x).isalnum()))


def _segment(b: np.ndarray, bounds: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of b: hashes, starts and ends. No word crosses one of the bounds (positions in b)."""
    is_word, value = tables
    m = is_word[b]
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1]
    end[:-1] &= ~m[1:]
    cut = bounds[(bounds > 0) & (bounds < len(b))]
    start[cut] = m[cut]
    end[cut - 1] = m[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(s):
        return np.zeros(0, np.uint64), s, e
    pw, inverse = powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value[b] * pw[: len(b)], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _C), s, e


def words(data: np.ndarray, offsets: np.ndarray, tables=PLAIN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, row past the last, word hashes, first word of each row and past the last, starts, ends in bytes of data) for runs of rows.

    Short texts are hashed together, long ones in segments that end at separators.
    """
    n, row = len(offsets) - 1, 0
    while row < n:
        lo = int(offsets[row])
        last = max(row + 1, int(np.searchsorted(offsets, lo + SEGMENT, "right")) - 1)
        hi = int(offsets[last])
        if hi - lo <= SEGMENT or last > row + 1:
            h, s, e = _segment(data[lo:hi], offsets[row : last + 1] - lo, tables)
            yield row, last, h, np.searchsorted(s, offsets[row : last + 1] - lo), s + lo, e + lo
        else:
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + SEGMENT)
                while to < hi and tables[0][data[to - 1]] and tables[0][data[to]]:
                    to = min(hi, to + 1 + int(np.argmin(tables[0][data[to : to + 65536]])) if not tables[0][data[to : to + 65536]].all() else to + 65536)
                h, s, e = _segment(data[at:to], np.zeros(0, np.int64), tables)
                parts.append((h, s + at, e + at))
                at = to
            h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield row, last, h, np.array([0, len(h)]), s, e
        row = last


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k word hashes; of the whole sequence if it is shorter, of nothing if it is empty."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _C + h[i : len(h) - k + 1 + i]
    return mix(out + np.uint64(k * int(_M1) % 2**64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: Bits of the filter below: 4 MB, whatever the input.
FILTER_BITS = 1 << 25


def maybe_in(ids: DataFrame) -> np.ndarray:
    """A bit for each of FILTER_BITS remainders of the longs in ids' only column: set for all that are in it, and for few others while it isn't full."""
    bit = F.pmod(F.col(ids.columns[0]), F.lit(FILTER_BITS))
    maps = ids.groupBy((bit / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits")).collect()
    bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for bucket, b in maps:
        bits[bucket] = np.frombuffer(b, np.uint8)
    return bits.reshape(-1)
