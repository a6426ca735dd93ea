"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window has as many words as the item that it is held against (a shorter document is one window). Fingerprints of 64 bits are made of the window's five-word shingles, weighted by how often they occur; only windows that hold a shingle of an item of their size get one, as the similarity of others is 0. Each item's fingerprint is entered, in four tables by 16 bits, under all values within RADIUS // 4 bits of its own: two fingerprints within RADIUS differ by at most that in one of the blocks, so a window's four look-ups find every item within RADIUS. Those are verified: weighted Jaccard (sum of the lesser over sum of the greater counts) of at least THRESHOLD.

Benchmarks are taken in groups of about ITEMS items, each with an index of its own; GROUPS of them are held against the documents in one pass, so what a task holds is bounded.

contaminated() gives pairs of documents and items; clean() the documents that hold none, each row judged by its own text, whatever its doc_id.

Words are runs of ASCII letters and digits and of characters beyond ASCII, lower case. Items and documents without words, null or empty, match nothing; items shorter than five words are one shingle. Repeated documents each give rows; a document that holds an item several times gives its best window (the first of equals). Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 23
#: Items of an index, and indexes held against the documents in one pass.
ITEMS, GROUPS = 256, 8
SCHEMA = "doc_id long, item_id long, similarity double, distance int, word_start int, word_end int"


def _bits(h: np.ndarray) -> np.ndarray:
    """A row of 64 signs, 1 or -1, for each hash."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


class Index:
    """Of a group of items: their shingles by size and the tables of fingerprint blocks."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.sizes, self.counts, prints = [], [], [], []
        data, at = common.text_buffers(pc.utf8_lower(pa.array(texts, pa.string())))
        for first, last, h, w, _, _ in common.words(data, at, common.ALNUM):
            for i in range(last - first):
                x = common.shingles(h[w[i] : w[i + 1]], SHINGLE)
                if len(x):
                    self.ids.append(ids[first + i])
                    self.sizes.append(int(w[i + 1] - w[i]))
                    self.counts.append(np.unique(x, return_counts=True))
                    prints.append(_pack(_bits(x).sum(0, keepdims=True))[0])
        self.prints = np.array(prints, np.uint64)
        self.by_size = {k: np.flatnonzero(np.array(self.sizes) == k) for k in set(self.sizes)}
        self.shingles = {k: np.unique(np.concatenate([self.counts[i][0] for i in rows])) for k, rows in self.by_size.items()}
        every = np.unique(np.concatenate(list(self.shingles.values()))) if self.shingles else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(every >> np.uint64(44)).astype(np.int64)] = True
        self.every, self.width = every, max(1, -(-len(self.ids) // 64))
        near = np.array([sum(1 << b for b in c) for n in range(RADIUS // 4 + 1) for c in itertools.combinations(range(16), n)], np.int64)
        self.tables = np.zeros((4, 1 << 16, self.width), np.uint64)
        for i, p in enumerate(prints):
            for block in range(4):
                self.tables[block, (int(p) >> (16 * block) & 0xFFFF) ^ near, i // 64] |= np.uint64(1 << (i % 64))

    def within(self, prints: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which fingerprint, which of the items rows, distance) of all pairs within RADIUS."""
        found = np.zeros((len(prints), self.width), np.uint64)
        for block in range(4):
            found |= self.tables[block, (prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF]
        hit = (found[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
        a, b = np.nonzero(hit)
        distance = np.bitwise_count(prints[a] ^ self.prints[rows[b]]).astype(np.int64)
        ok = distance <= RADIUS
        return a[ok], rows[b[ok]], distance[ok]

    def rows(self, x: np.ndarray, w: np.ndarray) -> list[int]:
        """The rows of a run of documents that may match: those that hold a shingle of an item, or all with words if items can be shorter. x: the shingles of the run."""
        if min(self.sizes, default=SHINGLE) < SHINGLE:
            return np.flatnonzero(np.diff(w) > 0).tolist()
        p = np.flatnonzero(self.maybe[(x >> np.uint64(44)).astype(np.int64)])
        p = p[np.isin(x[p], self.every)]
        return np.unique(np.searchsorted(w, p, "right") - 1).tolist()

    def matches(self, h: np.ndarray, threshold: float) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, distance, first word, word past the last) of a document's word hashes."""
        best: dict[int, tuple[float, int, int, int]] = {}
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, rows in self.by_size.items():
            k = min(SHINGLE, size)
            if k not in by_width:
                x = common.shingles(h, k)
                p = np.flatnonzero(self.maybe[(x >> np.uint64(44)).astype(np.int64)])
                by_width[k] = x, p[np.isin(x[p], self.every)]
            x, p = by_width[k]
            p = p[np.isin(x[p], self.shingles[size])] if len(p) else p
            if not len(p):
                continue
            m = min(size - k + 1, len(x))
            open_at = np.zeros(len(x) - m + 2, np.int32)
            np.add.at(open_at, np.maximum(p - m + 1, 0), 1)
            np.add.at(open_at, np.minimum(p, len(x) - m) + 1, -1)
            starts = np.flatnonzero(np.cumsum(open_at)[:-1])
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for lo in range(0, len(run), 4096):
                    part = run[lo : lo + 4096]
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(x[part[0] : part[-1] + m]), axis=0)])
                    which, items, distances = self.within(_pack(sums[m:] - sums[:-m]), rows)
                    for a, i, d in zip(which.tolist(), items.tolist(), distances.tolist(), strict=True):
                        s = self.similarity(x[part[a] : part[a] + m], i)
                        if s >= threshold and (i not in best or s > best[i][0]):
                            best[i] = s, d, int(part[a]), min(int(part[a]) + size, len(h))
        return [(self.ids[i], *x) for i, x in sorted(best.items())]

    def similarity(self, window: np.ndarray, item: int) -> float:
        values, counts = np.unique(window, return_counts=True)
        known, weights = self.counts[item]
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        least = np.minimum(counts, weights[at])[known[at] == values].sum()
        return float(least / (counts.sum() + weights.sum() - least))


def _passes(benchmark: DataFrame) -> list[list[tuple[list, list]]]:
    """The items' ids and texts, by groups (by hash: about ITEMS in each, and an index takes any number), by passes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    groups = max(1, -(-items.count() // ITEMS))
    out = []
    for first in range(0, groups, GROUPS):
        of = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).alias("group")
        rows = items.select("item_id", "text", of).filter(F.col("group").between(first, first + GROUPS - 1)).orderBy("item_id", "text").collect()
        each = [[r for r in rows if r["group"] == g] for g in range(first, min(groups, first + GROUPS))]
        out.append([([r.item_id for r in x], [r.text for r in x]) for x in each])
    return out


def _found(indexes: list[Index], column: pa.Array, threshold: float) -> Iterator[tuple]:
    """(row, item, similarity, distance, first word, word past the last) of a column of texts."""
    data, at = common.text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    for first, last, h, w, _, _ in common.words(data, at, common.ALNUM):
        x = common.shingles(h, SHINGLE)
        for index in indexes:
            for i in index.rows(x, w):
                for m in index.matches(h[w[i] : w[i + 1]], threshold):
                    yield first + i, *m


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, distance, word_start, word_end): documents that hold an item, with the best window."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for groups in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(groups)

        def run(batches, shared=shared):
            indexes = [Index(*g) for g in shared.value]
            for batch in batches:
                doc_ids = batch.column("doc_id")
                found = list(zip(*_found(indexes, batch.column("text"), threshold), strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([doc_ids.take(pa.array(found[0], pa.int64())), *(pa.array(c, k) for c, k in zip(found[1:], kinds, strict=True))], ["doc_id", "item_id", "similarity", "distance", "word_start", "word_end"])

        part = texts.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns as they are; nothing is shuffled."""
    kinds, text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), common.named(docs, "text")
    for groups in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(groups)

        def run(batches, shared=shared):
            indexes = [Index(*g) for g in shared.value]
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in _found(indexes, batch.column(text), threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, kinds)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
