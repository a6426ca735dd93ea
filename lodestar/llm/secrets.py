"""Secret scan: fixed patterns, and a randomness test battery with length-aware control of false discoveries.

Base spans come from three patterns over every whole text. Other tokens of 16 or more characters of [A-Za-z0-9+/_=-] are tested: they are split at inner =, and where no alphabet has all characters of a part, at the signs that the alphabet that fits most of it lacks (what that leaves in pieces below 16 characters, by the other one); each part of 16 or more characters is tested. Their encoding is inferred (hex, base32, base36, base62 or base64; numbers are none), and two questions are asked:

- is the token consistent with uniformly random characters of that encoding? Chi-squared of its characters, the number of runs of character classes and the serial correlation of neighbours are compared with what uniform characters give; the battery fails if one is rejected at RANDOM_ALPHA / 3;
- is it inconsistent with ordinary text? Chi-squared and runs are compared with what text of the corpus gives at the token's length: byte and neighbour counts of all documents are the null hypothesis. The two p-values are combined by Fisher's method.

Tokens that fail the battery get p = 1. Benjamini and Hochberg's procedure then holds the share of false discoveries at FDR within each class of lengths, over all documents: p-values are counted by class and bin (a fixed number of bins, on a scale of log10), and each class gets its own limit. Random tokens found so are added as spans of kind random; base spans stay.

Null and empty texts have no spans; an empty table gives an empty result; repeated rows each give a row; other columns are ignored. Very long texts are read whole, in memory that follows the longest one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

KINDS = ["assign", "access", "hex"]
# The base patterns.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Parts of a token: = ends one, or pads the last; and what fits one of the two large alphabets.
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+$)?")
FITS = {"base64": re.compile(r"[A-Za-z0-9+/]+=*"), "base64url": re.compile(r"[A-Za-z0-9_-]+=*")}
LEAST = 16
#: The same for Arrow's linear-time matcher, which only picks the texts to look at.
ANY_ASSIGN, ANY_TOKEN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"[A-Za-z0-9+/_=-]{16}"

RANDOM_ALPHA, FDR = 0.001, 0.01
LENGTHS = [16, 20, 24, 32, 48, 80]
BIN, BINS = 0.05, 800
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_PLACES = {name: {c: i for i, c in enumerate(x)} for name, x in ALPHABETS.items()}


def base_spans(text: str) -> list[spans.Span]:
    """(start, kind, end) of the base patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def encoding(token: str) -> str | None:
    """The smallest alphabet that has all the token's characters; None for numbers and if there is none."""
    body = token.rstrip("=")
    if not body or body.isdigit():
        return None
    letters = set(body)
    return next((name for name, x in _PLACES.items() if letters <= x.keys()), None)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the tokens, and parts of tokens, that have an encoding."""
    for token in TOKEN.finditer(text):
        for m in PART.finditer(text, *token.span()):
            if len(m[0]) < LEAST:
                continue
            if encoding(m[0]):
                yield m.span()
            elif not m[0].rstrip("=").isdigit():
                yield from _pieces(text, *m.span())


def _pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Of a part that no alphabet fits: pieces by the alphabet that fits most of it, then those by the other one that don't overlap them."""
    out: list[tuple[int, int]] = []
    for name in sorted(FITS, key=lambda x: -sum(c in _PLACES[x] for c in text[start:end])):
        new = []
        for m in FITS[name].finditer(text, start, end):
            if len(m[0]) >= LEAST and encoding(m[0]):
                i = bisect.bisect_left(out, (m.end(),))
                if not i or out[i - 1][1] <= m.start():
                    new.append(m.span())
        out = sorted(out + new)
    return out


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_z(x: float, mean: float, var: float) -> float:
    return (x - mean) / math.sqrt(max(var, 1e-9))


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


class Battery:
    """The tests, with the corpus's byte counts and counts of neighbours' classes as ordinary text."""

    def __init__(self, byte_counts: np.ndarray, class_pairs: np.ndarray):
        self.text = {}
        for name, alphabet in ALPHABETS.items():
            n = byte_counts[[ord(c) for c in alphabet]] + 0.5
            q, k = n / n.sum(), len(alphabet)
            self.text[name] = float(((q - 1 / k) ** 2 * k).sum())
        changes = class_pairs.sum() - np.trace(class_pairs)
        self.change = float(min(0.5, max(0.01, (changes + 1) / (class_pairs.sum() + 2))))

    def p(self, token: str) -> float:
        """How likely ordinary text is to look as random as this token; 1 if it doesn't look random."""
        name = encoding(token)
        if name is None:
            return 1.0
        body = token.rstrip("=")
        places = np.array([_PLACES[name][c] for c in body])
        n, k = len(body), len(ALPHABETS[name])
        counts = np.bincount(places, minlength=k)
        chi = float(((counts - n / k) ** 2).sum() * k / n)
        # Under uniform characters chi has this variance exactly, also where few are expected.
        uniform = _upper(_chi_z(chi, k - 1, 2 * (k - 1) * (n - 1) / n))
        kinds = [_kind(c) for c in ALPHABETS[name]]
        share = np.bincount(kinds, minlength=4) / k
        tau = 1 - float((share**2).sum())
        classes = [_kind(c) for c in body]
        changes = sum(a != b for a, b in zip(classes, classes[1:]))
        runs = math.erfc(abs(_chi_z(changes, (n - 1) * tau, (n - 1) * (tau * (1 - tau) + 2 * max(0.0, float((share**3).sum() - (share**2).sum() ** 2))))) / math.sqrt(2)) if 0 < tau else 1.0
        x = places - places.mean()
        spread = float((x * x).sum())
        serial = math.erfc(abs(float((x[1:] * x[:-1]).sum()) / spread + 1 / n) * math.sqrt(n) / math.sqrt(2)) if spread else 0.0
        if min(uniform, runs, serial) < RANDOM_ALPHA / 3:
            return 1.0
        extra = self.text[name] * n
        p1 = 1 - _upper(_chi_z(chi, k - 1 + extra, 2 * (k - 1) + 4 * extra))
        p2 = self._at_least(changes, n - 1)
        combined = -2 * (math.log(max(p1, 1e-300)) + math.log(max(p2, 1e-300)))
        return min(1.0, math.exp(-combined / 2) * (1 + combined / 2))  # chi-squared with four degrees

    def _at_least(self, changes: int, n: int) -> float:
        """That ordinary text of n neighbours has so many changes of class."""
        q = self.change
        term = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log(1 - q) for i in range(changes, n + 1)]
        top = max(term)
        return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in term))


def ordinary_text(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: counts of bytes, and of the classes (digit, lower, upper, other sign of a token) of neighbours within tokens."""
    kinds = np.full(256, 4, np.int64)
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
        kinds[b] = _kind(chr(b))

    def run(batches):
        bytes_, pairs = np.zeros(256, np.int64), np.zeros(25, np.int64)
        for batch in batches:
            data, at = common.text_buffers(batch.column(0))
            start, end = int(at[0]), int(at[-1])
            for lo in range(start, end, common.SEGMENT):
                b = data[lo : min(lo + common.SEGMENT + 1, end)]
                bytes_ += np.bincount(b[: common.SEGMENT], minlength=256)
                k = kinds[b]
                pairs += np.bincount(k[:-1] * 5 + k[1:], minlength=25)
            # The last byte of a text and the first of the next are no neighbours.
            cut = np.unique(at[(at > start) & (at < end)])
            pairs -= np.bincount(kinds[data[cut - 1]] * 5 + kinds[data[cut]], minlength=25)
        yield pa.record_batch([pa.array(range(281)), pa.array(np.concatenate([bytes_, pairs]))], ["place", "n"])

    total = np.zeros(281)
    for place, n in docs.select(F.col("text").cast("string")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        total[place] = n
    return total[:256], total[256:].reshape(5, 5)[:4, :4]


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) / BIN))


def _length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def candidates(docs: DataFrame, battery: Battery) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, base, tested): base spans, and the tested tokens with their class of length and bin of -log10 p."""
    shared = docs.sparkSession.sparkContext.broadcast(battery)
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    test = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("bin", pa.int32())])
    empty = spans.digest([], KINDS)

    def run(batches):
        tests = shared.value
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            look = pc.or_(pc.or_(pc.match_substring_regex(column, ANY_ASSIGN), pc.match_substring_regex(column, ANY_TOKEN)), pc.match_substring(column, "AKIA"))
            n = batch.num_rows
            counts, digests, base, tested = [[0] * n for _ in KINDS], [empty] * n, [[]] * n, [[]] * n
            for i in np.flatnonzero(look.to_numpy(zero_copy_only=False)).tolist():
                text = column[i].as_py()
                found = base_spans(text)
                for k in range(3):
                    counts[k][i] = sum(x[1] == k for x in found)
                digests[i] = spans.digest(found, KINDS)
                base[i] = [{"start": a, "kind": k, "end": b} for a, k, b in found]
                cover = spans.Cover(found)
                tested[i] = [
                    {"start": a, "end": b, "class": _length_class(b - a), "bin": _bin(tests.p(text[a:b]))}
                    for a, b in tokens(text) if not cover.meets(a, b)
                ]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(base, pa.list_(span)), pa.array(tested, pa.list_(test))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tested"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, tested array<struct<start:int,end:int,class:int,bin:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def limits(tested: DataFrame, fdr: float = FDR) -> list[int]:
    """The least bin that counts as found, for each class of lengths (Benjamini and Hochberg)."""
    rows = tested.select(F.explode("tested").alias("t")).groupBy("t.class", "t.bin").count().collect()
    out = []
    for c in range(len(LENGTHS)):
        n = np.zeros(BINS, np.int64)
        for r in rows:
            if r["class"] == c:
                n[r["bin"]] = r["count"]
        above = n[::-1].cumsum()[::-1]
        p = 10.0 ** (-np.arange(BINS) * BIN)  # the greatest p of each bin
        good = np.flatnonzero((p * max(n.sum(), 1) <= fdr * above) & (above > 0))
        out.append(int(good.min()) if len(good) else BINS)
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random): see above."""
    found = common.saved(candidates(docs, Battery(*ordinary_text(docs))), "secrets")
    least = F.array(*[F.lit(x) for x in limits(found)])
    added = F.filter("tested", lambda t: t["bin"] >= F.element_at(least, t["class"] + 1))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.all_written(F.col("base"), added, KINDS, "random").alias("spans"), F.size(added).cast("long").alias("n_random"))


def redact(docs: DataFrame, sign: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by sign (overlapping spans by one), and n_chars, where there is such a column, counted anew."""
    battery = Battery(*ordinary_text(docs))
    least = limits(common.saved(candidates(docs, battery).select("tested"), "secrets"))
    shared = docs.sparkSession.sparkContext.broadcast(battery)
    kinds, name = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), common.named(docs, "text")

    def run(batches):
        for batch in batches:
            text = batch.column(name)
            column = pc.fill_null(text, "")
            look = pc.or_(pc.or_(pc.match_substring_regex(column, ANY_ASSIGN), pc.match_substring_regex(column, ANY_TOKEN)), pc.match_substring(column, "AKIA"))
            new = {i: _redacted(column[i].as_py(), shared.value, least, sign) for i in np.flatnonzero(look.to_numpy(zero_copy_only=False)).tolist()}
            columns = list(batch.columns)
            if new:
                at = batch.schema.get_field_index(name)
                columns[at] = pc.replace_with_mask(text, pa.array([i in new for i in range(len(text))]), pa.array(list(new.values()), text.type))
                if (n := batch.schema.get_field_index("n_chars")) >= 0:
                    mask = pa.array([i in new and new[i] != column[i].as_py() for i in range(len(text))])
                    columns[n] = pc.if_else(mask, pc.utf8_length(columns[at]).cast(columns[n].type), columns[n])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, kinds)


def _redacted(text: str, battery: Battery, least: list[int], sign: str) -> str:
    found = base_spans(text)
    cover = spans.Cover(found)
    found += [(a, 3, b) for a, b in tokens(text) if not cover.meets(a, b) and _bin(battery.p(text[a:b])) >= least[_length_class(b - a)]]
    out, at = [], 0
    for a, _, b in sorted(found):
        if a >= at:
            out += [text[at:a], sign]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))
