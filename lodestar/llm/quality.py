"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text becomes a row of statistics, computed in numpy over Arrow batches. The trees are fitted on the driver from a bounded sample of labelled rows (at most SAMPLE, those with the least hash of their doc_id), on histograms of quantile bins; they are flattened into arrays of features, thresholds and children, which the tasks traverse for all rows of a batch at once. Rows whose crc32(doc_id as text) modulo 5 is 0 are never used for fitting.

Null and empty texts get the score of their (zero) statistics. Without labelled rows every score is 0.5; with one class only, near that class. Repeated rows each give a row. An empty table gives an empty result. Very long texts count whole; other columns are ignored. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows used for fitting at most.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, LEAST, PENALTY = 64, 80, 4, 0.12, 10, 1.0
FEATURES = ["log_bytes", "log_words", "word_length", "word_length_spread", "upper", "lower", "digit", "beyond_ascii", "space", "line_ends", "full_stops", "other_marks", "marks_per_word", "bars", "distinct_words", "most_frequent_word", "repeated_neighbours", "distinct_lines", "words_per_line", "longest_word", "distinct_pairs", "braces", "capital_words", "control"]


def _class_table() -> np.ndarray:
    t = np.full(256, 6, np.uint8)
    t[ord("A") : ord("Z") + 1], t[ord("a") : ord("z") + 1], t[ord("0") : ord("9") + 1], t[128:] = 0, 1, 2, 3
    t[[32, 9]], t[[10, 13]], t[[46, 44]] = 4, 5, 7
    t[[ord("|")]], t[[ord(c) for c in "{}<>[]()=;"]] = 8, 9
    t[[x for x in range(32) if x not in (9, 10, 13)]] = 10
    return t


_CLASS = _class_table()
_WORDS = common.byte_tables(b" \t\n\v\f\r", fold=False)
_LINES = common.byte_tables(b"\n", fold=False)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a string column."""
    data, at = common.text_buffers(column)
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    for first, last, h, w, s, e in common.words(data, at, _WORDS):
        lo, hi = int(at[first]), int(at[last])
        classes = _CLASS[data[lo:hi]]
        length = (e - s).astype(np.float64)
        capital = _CLASS[data[s]] == 0 if len(s) else np.zeros(0, bool)
        pairs = common.mix(h[:-1] * common._C + h[1:]) if len(h) > 1 else h[:0]
        same = h[1:] == h[:-1]
        for i in range(last - first):
            a, b = int(w[i]), int(w[i + 1])
            size, k = int(at[first + i + 1] - at[first + i]), b - a
            if not size:
                continue
            c = np.bincount(classes[int(at[first + i]) - lo : int(at[first + i + 1]) - lo], minlength=11)
            marks = c[6] + c[8] + c[9]
            row = out[first + i]
            row[0], row[1] = np.log1p(size), np.log1p(k)
            row[4:13] = c[0] / size, c[1] / size, c[2] / size, c[3] / size, c[4] / size, c[5] / size, c[7] / size, marks / size, marks / max(k, 1)
            row[13], row[21], row[23] = c[8] / size, c[9] / size, c[10] / size
            if k:
                x = length[a:b]
                counts = np.unique(h[a:b], return_counts=True)[1]
                row[2], row[3], row[14], row[15], row[19] = x.mean(), x.std(), len(counts) / k, counts.max() / k, np.log1p(x.max())
                row[16] = same[a : b - 1].mean() if k > 1 else 0
                row[20] = len(np.unique(pairs[a : b - 1])) / (k - 1) if k > 1 else 1
                row[22] = capital[a:b].mean()
                row[18] = k / (c[5] + 1)
    for first, last, h, w, _, _ in common.words(data, at, _LINES):
        for i in range(last - first):
            k = int(w[i + 1] - w[i])
            out[first + i, 17] = len(np.unique(h[int(w[i]) : int(w[i + 1])])) / k if k else 0
    return out


class Trees:
    """Gradient-boosted trees as flat arrays; node i of tree t goes left where the feature is at most the threshold."""

    def __init__(self, feature, threshold, left, right, value, roots, start, depth):
        self.feature, self.threshold, self.left, self.right, self.value, self.roots, self.start, self.depth = feature, threshold, left, right, value, roots, start, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Fits the logistic loss on histograms of gradients by feature and bin."""
    n, d = x.shape
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    p = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1) if n else np.zeros((0, d), np.int64)
    total = np.full(n, start)

    def node() -> int:
        for store, v in ((feature, 0), (threshold, np.inf), (left, len(feature)), (right, len(feature)), (value, 0.0)):
            store.append(v)
        return len(feature) - 1

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, down: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        value[at] = float(-RATE * gs / (hs + PENALTY))
        total[rows] += value[at]
        if not down or len(rows) < 2 * LEAST:
            return
        flat = (binned[rows] + np.arange(d) * BINS).ravel()
        G, H, N = (np.bincount(flat, np.repeat(v, d), d * BINS).reshape(d, BINS).cumsum(1)[:, :-1] for v in (g[rows], h[rows], np.ones(len(rows))))
        gain = np.where((N >= LEAST) & (len(rows) - N >= LEAST), G**2 / (H + PENALTY) + (gs - G) ** 2 / (hs - H + PENALTY) - gs**2 / (hs + PENALTY), -1)
        j, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[j, b] <= 1e-6 or b >= len(edges[j]):
            return
        total[rows] -= value[at]
        feature[at], threshold[at] = int(j), float(edges[j][b])
        low = binned[rows, j] <= b
        left[at], right[at] = node(), node()
        grow(left[at], rows[low], g, h, down - 1)
        grow(right[at], rows[~low], g, h, down - 1)

    if 0 < y.sum() < n:
        for _ in range(trees):
            q = 1 / (1 + np.exp(-total))
            root = node()
            roots.append(root)
            grow(root, np.arange(n), q - y, q * (1 - q), depth)
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), roots, start, depth)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fits on at most sample rows of docs (doc_id, text) that have a label and aren't held out."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most sample ids of 8 bytes: small enough to send to every task, so that texts aren't shuffled.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            x = statistics(batch.column("text")).astype(np.float32)
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    found = rows.mapInArrow(run, "doc_id long, y int, x binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.x))
    x = np.frombuffer(b"".join(r.x for r in found), np.float32).reshape(len(found), len(FEATURES)).astype(np.float64)
    model = fit(x, np.array([r.y for r in found], np.float64))
    del x, found
    common.tidy(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns score and predicted; columns of docs with these names are replaced."""
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = common.named(kept, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches):
        for batch in batches:
            p = shared.value.score(statistics(batch.column(text).cast(pa.string())).astype(np.float32).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, f"{kinds}, score double, predicted int")


def kept(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least threshold, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = common.named(docs, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for batch in batches:
            p = shared.value.score(statistics(batch.column(text).cast(pa.string())).astype(np.float32).astype(np.float64))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, kinds)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
