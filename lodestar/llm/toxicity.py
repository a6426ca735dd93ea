"""Toxicity: noisy-channel deobfuscation with a character language model, then a score of the restored text.

1. Letter trigrams of all documents give the language model: its signs are the boundary, a to z, and every other letter that the documents hold (one more sign for letters that they don't), smoothed with bigrams. It grows with the distinct trigrams of the input.
2. Spans of any length that look disguised (digits or signs among letters, single letters with separators between, letters three times or more in a row) become lattices: a sign may be itself, a letter that it stands for, a repetition, or a separator that drops out or ends a word, each at a price. Viterbi finds the cheapest paths under channel and language model, of which each pair of last signs keeps BEST; the words of the BEST cheapest stand for the span.
3. The restored text's distinct words and beginnings of words are scored by logistic regression. Its words are those whose share differs most (by z-score) between the labels in a bounded sample of labelled rows (at most SAMPLE, least hash of doc_id); rows whose crc32(doc_id as text) modulo 5 is 0 are never used.

Nulls and empty texts have no words and get the score of the intercept. Without labelled rows, or with one class only, every score is the smoothed share of label 1. Repeated rows each give a row; an empty table gives an empty result; other columns are ignored. Very long texts are scored whole, in memory that follows the longest one.
"""

from __future__ import annotations

import functools
import heapq
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, WORDS, MIN_DOCS, MIN_Z = 12_000, 2000, 5, 4.0
BEST = 3
THRESHOLD = 0.5
SIGNS = 28

#: What a sign may stand for (fixed values), and the prices in natural logarithms.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou"}
SEPARATORS = " .-_*~'​­"
SUBSTITUTE, WILD, DROP, END, REPEAT = 1.5, 2.5, 0.2, 1.4, 0.7
_L, _AMONG, _BEFORE = r"[^\W\d_]", r"0-9@$!|+(<€£¡*#.\-_~​­", r"0-9@$!|+(<€£¡*#"
#: Single letters with separators between; runs of letters and signs, and what makes such a run look disguised.
SPACED = re.compile(rf"(?<!{_L})(?:{_L}[ .\-_*~'​­]+){{2,}}{_L}(?!{_L})")
RUN = re.compile(rf"(?:{_L}|[{_AMONG}])+")
ODD = re.compile(rf"{_L}[{_AMONG}]+(?={_L})|[{_BEFORE}](?={_L}{{2}})|({_L})\1\1")
#: The same roughly, for Arrow's linear-time matcher; letters beyond ASCII in a row are looked for in the bytes.
MAYBE = r"\pL[0-9@$!|+(<€£¡*#.\-_~\x{200b}\x{ad}]+\pL|[0-9@$!|+(<€£¡*#]\pL\pL|(?:\PL|^)\pL[ .\-_*~'\x{200b}\x{ad}]+\pL[ .\-_*~'\x{200b}\x{ad}]+\pL|(?i)(?:" + "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz") + ")"


def _sign_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[97:123] = range(1, 27)
    t[65:91] = range(1, 27)
    t[128:] = 27
    return t


_SIGN = _sign_table()


#: A trigram of code points is a number of three times so many bits.
POINT = 21


@functools.cache
def _letter_table() -> np.ndarray:
    """Of each code point: itself for letters, 0 for others."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)


def letter_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of letters (code points in lower case, 0 for all others) in all texts, and their counts."""

    def run(batches):
        table, counts = _letter_table(), np.zeros(SIGNS**3, np.int64)
        far, far_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            # Two line ends between texts, as many as a trigram looks back.
            text = "\n\n" + "\n\n".join(pc.fill_null(pc.utf8_lower(batch.column(0)), "").to_pylist()) + "\n"
            for lo in range(2, len(text), common.SEGMENT):
                c = table[np.frombuffer(text[lo - 2 : lo + common.SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32)]
                s = np.where(c > 122, 27, np.maximum(c - 96, 0))
                x = (s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:]
                used = s[1:-1] + s[2:] > 0
                beyond = (c[:-2] > 122) | (c[1:-1] > 122) | (c[2:] > 122)
                counts += np.bincount(x[used & ~beyond], minlength=SIGNS**3)
                y = ((c[:-2] << 2 * POINT) | (c[1:-1] << POINT) | c[2:])[used & beyond]
                if len(y):
                    new, n = np.unique(y, return_counts=True)
                    far, at = np.unique(np.concatenate([far, new]), return_inverse=True)
                    far_n = np.bincount(at, np.concatenate([far_n, n]), len(far)).astype(np.int64)
        used = np.flatnonzero(counts)
        a, b, c = (np.where(x > 0, x + 96, 0) for x in (used // SIGNS**2, used // SIGNS % SIGNS, used % SIGNS))
        yield pa.record_batch([pa.array(np.concatenate([(a << 2 * POINT) | (b << POINT) | c, far])), pa.array(np.concatenate([counts[used], far_n]))], ["place", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    return found.column("place").to_numpy(), found.column("n").to_numpy()


class Channel:
    """Lattices, and Viterbi under the language model."""

    def __init__(self, counts: np.ndarray | tuple[np.ndarray, np.ndarray]):
        """counts: trigrams of code points and their counts, or the counts of all trigrams of SIGNS signs."""
        if isinstance(counts, tuple):
            places, n = counts
            mask = (1 << POINT) - 1
            points = [places >> 2 * POINT, (places >> POINT) & mask, places & mask]
            beyond = np.unique(np.concatenate(points))
            beyond = beyond[beyond > 122]
            signs = [np.where(x > 122, SIGNS + np.searchsorted(beyond, x), np.maximum(x - 96, 0)) for x in points]
        else:
            places, beyond = np.flatnonzero(counts), np.zeros(0, np.int64)
            n, signs = counts[places], [places // SIGNS**2, places // SIGNS % SIGNS, places % SIGNS]
        self.signs = SIGNS + len(beyond)
        self.sign = {chr(c): SIGNS + i for i, c in enumerate(beyond.tolist())}
        self.three = self._sorted((signs[0] * self.signs + signs[1]) * self.signs + signs[2], n)
        self.two = self._sorted(signs[1] * self.signs + signs[2], n)
        self.rows: dict[int, tuple[dict[int, float], float]] = {}
        self.known: dict[str, tuple[str, ...]] = {}

    @staticmethod
    def _sorted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, n, len(keys)) if len(keys) else np.zeros(0)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": {}}

    def _row(self, table: tuple[np.ndarray, np.ndarray], before: int) -> dict[int, float]:
        keys, n = table
        lo, hi = np.searchsorted(keys, [before * self.signs, (before + 1) * self.signs])
        return dict(zip((keys[lo:hi] - before * self.signs).tolist(), n[lo:hi].tolist(), strict=True))

    def cost(self, a: int, b: int, s: int) -> float:
        """Of sign s after a and b: less the logarithm of its share."""
        key = a * self.signs + b
        if key not in self.rows:
            if len(self.rows) >= 100_000:
                self.rows.clear()
            three, two = self._row(self.three, key), self._row(self.two, b)
            total, over = sum(two.values()) + 0.5 * self.signs, sum(three.values()) + 20
            self.rows[key] = ({x: -math.log((three.get(x, 0) + 20 * (n + 0.5) / total) / over) for x, n in two.items()}, -math.log(20 * 0.5 / total / over))
        row, other = self.rows[key]
        return row.get(s, other)

    def restore(self, span: str) -> tuple[str, ...]:
        """The words of the cheapest paths of a span, remembered for a bounded number of spans that aren't long."""
        if span in self.known:
            return self.known[span]
        words = self._restore(span)
        if len(span) <= 64:
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known[span] = words
        return words

    @staticmethod
    def arcs(c: str, before: str) -> list[tuple[str, float]]:
        """(letter, a space that ends a word, or nothing; price) of one sign; before: the last letter of the path."""
        out = []
        low = c.lower()
        if c.isalpha():
            low = low if len(low) == 1 else c
            out.append((low, 0.0))
            if low == before:
                out.append(("", REPEAT))
        for x in STANDS_FOR.get(c, ""):
            out.append((x, WILD if c in "*#" else SUBSTITUTE))
            if x == before:
                out.append(("", REPEAT))
        if c in SEPARATORS or not out:
            out.append(("", DROP if c in SEPARATORS else WILD))
        if c in SEPARATORS and before not in ("", " "):
            out.append((" ", END))
        return out

    def _sign_of(self, letter: str) -> int:
        return 0 if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else self.sign.get(letter, 27)

    def _restore(self, span: str) -> tuple[str, ...]:
        # A path is (price, hash of its letters, (path before, letter)), so that its letters are written once.
        beam: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, 0, None)]}
        arcs: dict[tuple[str, str], list] = {}
        for c in span:
            reached: dict[tuple[int, int], dict[int, tuple]] = {}
            for (a, b), paths in beam.items():
                for price, h, path in paths:
                    key = (c, path[1] if path else "")
                    if key not in arcs:
                        arcs[key] = [(x, self._sign_of(x) if x else 0, ord(x) if x else 0, more) for x, more in self.arcs(*key)]
                    for letter, s, point, more in arcs[key]:
                        if letter:
                            to, new = (b, s), (price + more + self.cost(a, b, s), (h * 1_000_003 + point) & 0xFFFFFFFFFFFFFFFF, (path, letter))
                        else:
                            to, new = (a, b), (price + more, h, path)
                        same = reached.setdefault(to, {})
                        if new[1] not in same or new[0] < same[new[1]][0]:
                            same[new[1]] = new
            beam = {k: heapq.nsmallest(BEST, same.values(), key=lambda x: x[:2]) for k, same in reached.items()}
        ends = [(price + (self.cost(a, b, 0) if b else 0.0), h, path) for (a, b), paths in beam.items() for price, h, path in paths if path]
        words: dict[str, None] = {}
        for _, _, path in heapq.nsmallest(BEST, ends, key=lambda x: x[:2]):
            letters = []
            while path:
                path, letter = path
                letters.append(letter)
            words |= dict.fromkeys("".join(reversed(letters)).split())
        return tuple(words)


def disguised(text: str) -> list[str]:
    """Spans that look disguised, of any length."""
    spaced = [m.span() for m in SPACED.finditer(text)]
    out, i = [text[a:b] for a, b in spaced], 0
    for m in RUN.finditer(text):
        while i < len(spaced) and spaced[i][1] < m.end():
            i += 1
        if m.end() - m.start() >= 3 and not (i < len(spaced) and spaced[i][0] <= m.start()) and ODD.search(text, m.start(), m.end()):
            out.append(m[0])
    return out


def _tripled(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with a character beyond ASCII three times in a row."""
    rows = [np.zeros(0, np.int64)]
    lead = np.flatnonzero(data[int(at[0]) : int(at[-1])] >= 0xC2) + int(at[0])
    for size, low, high in ((2, 0xC2, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        x = lead[(data[lead] >= low) & (data[lead] < high) & (lead + 3 * size <= int(at[-1]))]
        for i in range(2 * size):
            x = x[data[x + i] == data[x + i + size]]
        rows.append(np.searchsorted(at, x, "right") - 1)
    return np.unique(np.concatenate(rows))


#: Besides whole words, their beginnings of so many bytes are features: languages that compound and inflect.
BEGINNINGS = range(4, 9)


def _features(data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words h and of their beginnings, and for each the place of its word."""
    parts, places = [h], [np.arange(len(h))]
    begun = np.zeros(len(h), np.uint64)
    for j in range(BEGINNINGS[-1]):
        long = np.flatnonzero(e - s > j)
        begun[long] = begun[long] * common._C + data[s[long] + j].astype(np.uint64) + np.uint64(1)
        if j + 1 in BEGINNINGS:
            parts.append(common.mix(begun[long] + np.uint64(j + 1)))
            places.append(long)
    return np.concatenate(parts), np.concatenate(places)


def restored(column: pa.Array, channel: Channel):
    """Yields (first row, row past the last, features, their rows less the first) of the restored texts; features repeat as often as they occur."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    data, at = common.text_buffers(lower)
    look = np.union1d(np.flatnonzero(pc.match_substring_regex(lower, MAYBE).to_numpy(zero_copy_only=False)), _tripled(data, at))
    for first, last, h, w, s, e in common.words(data, at, common.ALNUM):
        f, place = _features(data, h, s, e)
        rows = np.searchsorted(w, place, "right") - 1
        features, owners = [f], [rows]
        for i in look[(look >= first) & (look < last)].tolist():
            more = [x for d in disguised(lower[i].as_py()) for x in channel.restore(d)]
            if more:
                d, o = common.text_buffers(pa.array([" ".join(more)]))
                for _, _, h2, _, s2, e2 in common.words(d, o, common.ALNUM):
                    features.append(_features(d, h2, s2, e2)[0])
                    owners.append(np.full(len(features[-1]), i - first))
        yield first, last, np.concatenate(features), np.concatenate(owners)


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, start: float):
        order = np.argsort(words)
        self.words, self.weights, self.start = words[order], weights[order], start
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def scores(self, features: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Of n texts; features and the rows that they belong to, each counted once."""
        total = np.full(n, self.start)
        if len(self.words):
            hit = np.flatnonzero(self.maybe[(features >> np.uint64(48)).astype(np.int64)])
            f, r = features[hit], rows[hit]
            at = np.minimum(np.searchsorted(self.words, f), len(self.words) - 1)
            ok = self.words[at] == f
            both = np.unique(r[ok] * len(self.words) + at[ok])
            total += np.bincount(both // len(self.words), self.weights[both % len(self.words)], n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: list[list[int]], y: np.ndarray, features: int, rounds: int = 400, penalty: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic regression on lists of features, by gradient steps with momentum on the mean loss."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start, w = math.log(share / (1 - share)), np.zeros(features)
    if not features or not 0 < y.sum() < len(y):
        return w, start
    which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.array([f for r in rows for f in r], np.int64)
    scale = 1 / np.sqrt(np.bincount(what, minlength=features) + penalty)
    v, vb, move, bias = np.zeros(features), 0.0, np.zeros(features), start
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(which, (move * scale)[what], len(rows)), -30, 30)))
        g = np.bincount(what, (p - y)[which], features) * scale + penalty * scale**2 * move
        v, vb = 0.9 * v - 0.1 * g, 0.9 * vb - 0.1 * float((p - y).sum()) / math.sqrt(len(y))
        move, bias = move + v, bias + vb / math.sqrt(len(y))
    return move * scale, bias


def train(docs: DataFrame, labels: DataFrame, channel: Channel, label: str = "toxic") -> Model:
    spark = docs.sparkSession
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # At most SAMPLE ids of 8 bytes.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    shared = spark.sparkContext.broadcast(channel)

    def run(batches):
        for batch in batches:
            sets: list[list[int]] = [[]] * batch.num_rows
            for first, last, f, rows in restored(batch.column("text"), shared.value):
                order = np.argsort(rows, kind="stable")
                f, cuts = f[order], np.searchsorted(rows[order], np.arange(last - first + 1))
                for i in range(last - first):
                    sets[first + i] = common.signed(np.unique(f[cuts[i] : cuts[i + 1]])).tolist()
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "y", "words"])

    seen = common.saved(rows.mapInArrow(run, "doc_id long, y int, words array<long>"), "sample")
    n0, n1 = (seen.filter(f"y = {k}").count() for k in (0, 1))
    counts = seen.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") + F.col("b") >= MIN_DOCS)
    pa_, pb_ = (F.col("a") + 0.5) / (n1 + 1.0), (F.col("b") + 0.5) / (n0 + 1.0)
    both = (F.col("a") + F.col("b") + 1.0) / (n0 + n1 + 2.0)
    z = (pa_ - pb_) / F.sqrt(both * (1 - both) * (1.0 / (n1 + 1) + 1.0 / (n0 + 1)))
    words = [r.word for r in counts.withColumn("z", z).filter(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "word").limit(WORDS).collect()]
    place = {w: i for i, w in enumerate(words)}
    known = F.array(*[F.lit(w) for w in words]).cast("array<long>")
    found = sorted(((r.doc_id, r.y, sorted(place[w] for w in r.words)) for r in seen.select("doc_id", "y", F.array_intersect("words", known).alias("words")).collect()), key=lambda r: (r[0], r[2]))
    weights, start = fit([r[2] for r in found], np.array([r[1] for r in found], np.float64), len(words))
    return Model(np.array(words, np.int64).astype(np.uint64), weights, start)


def score(docs: DataFrame, channel: Channel, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((channel, model))

    def run(batches):
        channel, model = shared.value
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for first, last, f, rows in restored(batch.column("text"), channel):
                p[first:last] = model.scores(f, rows, last - first)
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    channel = Channel(letter_counts(docs))
    scored = score(docs, channel, train(docs, common.table(spark, sf_dir, "labels"), channel))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
