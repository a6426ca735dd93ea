"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from patterns over every whole text. They are the seeds of a bootstrap: each occurrence of a seed, and of any other candidate outside base spans, has two lexical patterns: the two words before it, and the word before with the word after. Candidates are identifier-like tokens (four digits or more), and the slots that patterns point at: between two words before and a word after, both of patterns of SUPPORT distinct seeds, a run of groups of letters or digits joined by spaces, dots, dashes, brackets and the like, whatever its length. Two words before point only if a seed follows SHARE of all their occurrences in the corpus or more: with two patterns of a smaller share s no instance could come to CONFIDENCE, as after three rounds it has 1 - (1 - s)^14; so common words point at nothing, however much text there is. Spark scores the graph of patterns and instances in ROUNDS rounds: a pattern's score is the mean score of its distinct instances (seeds: 1, others: what they have so far) with a prior of PRIOR instances that are none; it counts from SUPPORT distinct seeds on; an instance's score is that of a noisy or of its patterns. Instances of at least CONFIDENCE with two patterns or more are added as spans of kind found, but for those within another one; base spans stay.

Words are what ASCII white space leaves between, A-Z lowered. Nulls and empty texts have no spans; very long texts are read whole; an empty table gives an empty result; repeated rows each give a row (copies are one instance with one pattern, so they add no confidence); other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, spans

KINDS = ["email", "ip", "card", "phone"]
# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no match starts within a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-like tokens.
TOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._/@+-]*[A-Za-z0-9])?")
#: Words, and one of the groups of a slot.
SPACE = " \t\n\v\f\r"
WORD = re.compile(r"[^ \t\n\v\f\r]+")
NEXT = re.compile(r"[ \t\n\v\f\r]*([^ \t\n\v\f\r]*)")
LOWER = {c: c + 32 for c in range(65, 91)}
GROUP = re.compile(r"[\w.:()\[\]@+/*#-]+")
#: Texts that can hold any of them, for Arrow's linear-time matcher.
ANY = r"@|[0-9] ?[0-9]|[0-9][^\s]*[0-9]|\+[0-9]"

ROUNDS, SUPPORT, PRIOR, CONFIDENCE, SHARE = 3, 5, 2.0, 0.8, 0.1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each @ outward, so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[spans.Span]:
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def _contexts(text: str, places: list[tuple[int, int]]) -> list[list[str]]:
    """The two patterns of each place: whole neighbouring words, but for what another place holds of the same run of characters (that is _): so all of them together aren't much longer than the text."""
    starts, ends = sorted(a for a, _ in places), sorted(b for _, b in places)
    out = []
    for a, b in places:
        i, j = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        least, most = ends[i - 1] if i else 0, starts[j] if j < len(starts) else len(text)
        last, at, cut = _word_before(text, a, least)
        before = "_" if cut and i else _word_before(text, at, 0)[0] or "^"
        after = NEXT.match(text, b, most)[1].translate(LOWER) or ("_" if j < len(starts) else "$")
        last = last or ("_" if i else "^")
        out.append([f"{before} {last} _", f"{last} _ {after}"])
    return out


def _word_before(text: str, at: int, least: int) -> tuple[str, int, bool]:
    """The word that ends before at, as far as it lies beyond least; where it begins, and whether least was reached."""
    end = at
    while end > least and text[end - 1] in SPACE:
        end -= 1
    start = end
    while start > least and text[start - 1] not in SPACE:
        start -= 1
    return text[start:end].translate(LOWER), start, start == least


def _two_before(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of runs of rows: (first row, first word of each row and past the last, hashes of the two words before each word)."""
    (_, _, none, _, _, _) = next(common.words(np.frombuffer(b"^", np.uint8), np.array([0, 1])))
    for row, last, h, first, _, _ in common.words(data, offsets):
        one, two = (np.concatenate([np.repeat(none, k), h])[: len(h)] for k in (1, 2))
        at = first[:-1][first[:-1] < first[1:]]
        one[at] = two[at] = none
        two[(at + 1)[np.isin(at + 1, first, invert=True)]] = none
        yield row, first, _pair(two, one)


def _pair(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return common.mix(before * np.uint64(0x9E3779B97F4A7C15) + last)


def _known(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = (places % np.uint64(common.FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def slots_of(text: str, hits: list[int], patterns: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the slots that begin with the words of these places, up to the next word (or sign) that a pattern of patterns (a filter of crc32) ends with after the word before."""

    def known(pattern: str) -> int:
        at = zlib.crc32(pattern.encode("utf-8", "surrogatepass")) % common.FILTER_BITS
        return int(patterns[at >> 3]) >> (at & 7) & 1

    words = [(m[0].translate(LOWER), m.start(), m.end()) for m in WORD.finditer(text)]
    out, ends = [], {}
    # From right to left: what was walked after a word before isn't walked again.
    for i in reversed(hits):
        last = words[i - 1][0] if i else "^"
        at, end = ends.get(last, (len(words), None))
        j, found = i, None
        while j < len(words):
            if j == at:
                found = end
                break
            stop = words[j][2]
            while stop > words[j][1] and not (text[stop - 1].isalnum() or text[stop - 1] in "_)]*#"):
                stop -= 1
            if not GROUP.fullmatch(text, words[j][1], stop):
                break
            tail = text[stop : words[j][2]]
            right = tail.translate(LOWER) or (words[j + 1][0] if j + 1 < len(words) else "$")
            if known(f"{last} _ {right}"):
                found = stop
                break
            if tail or j + 1 < len(words) and text[words[j][2] : words[j + 1][1]].strip(" "):
                break
            j += 1
        ends[last] = (i, found)
        if found:
            out.append((words[i][1], found))
    return out


def occurrences(docs: DataFrame, pointing: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """pointing: see there. (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, slots): slots are the occurrences of seeds and other identifiers with their patterns."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    slot = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    empty = spans.digest([], KINDS)
    shared = docs.sparkSession.sparkContext.broadcast(pointing) if pointing else None

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column("text"), "")
            n = batch.num_rows
            look = pc.match_substring_regex(column, ANY).to_numpy(zero_copy_only=False)
            counts, digests, base, slots = [[0] * n for _ in KINDS], [empty] * n, [[]] * n, [[]] * n
            hits = _hits(column, shared.value[0]) if shared is not None else {}
            for i in sorted({*np.flatnonzero(look).tolist(), *hits}):
                text = column[i].as_py()
                found = base_spans(text) if look[i] else []
                for k in range(4):
                    counts[k][i] = sum(x[1] == k for x in found)
                digests[i] = spans.digest(found, KINDS)
                base[i] = [{"start": a, "kind": k, "end": b} for a, k, b in found]
                cover = spans.Cover(found)
                others = [(m.start(), m.end()) for m in TOKEN.finditer(text) if m.end() - m.start() >= 6 and sum(c.isdigit() for c in m[0]) >= 4 and not cover.meets(m.start(), m.end())] if look[i] else []
                if i in hits:
                    others = sorted({*others, *((a, b) for a, b in slots_of(text, hits[i], shared.value[1]) if not cover.meets(a, b))})
                places = [(a, b) for a, _, b in found] + others
                slots[i] = [
                    {"start": a, "end": b, "seed": k < len(found), "instance": hashlib.sha256(text[a:b].lower().encode("utf-8", "surrogatepass")).hexdigest(), "patterns": patterns_}
                    for k, ((a, b), patterns_) in enumerate(zip(places, _contexts(text, places), strict=True))
                ]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(base, pa.list_(span)), pa.array(slots, pa.list_(slot))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "slots"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, slots array<struct<start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _hits(column: pa.Array, bits: np.ndarray) -> dict[int, list[int]]:
    """Of each row the places of the words that one of the pairs in bits comes before, rows without any left out."""
    out = {}
    for row, first, pairs in _two_before(*common.text_buffers(column)):
        found = np.flatnonzero(_known(bits, pairs))
        rows = np.searchsorted(first, found, "right") - 1
        for r, place in zip(rows.tolist(), (found - first[rows]).tolist(), strict=True):
            out.setdefault(row + r, []).append(place)
    return out


def _pairs_of(patterns: DataFrame) -> DataFrame:
    """patterns (pattern, times), two words before a slot each: with the hash of the two as pair."""

    def run(batches):
        for batch in batches:
            pairs = [np.zeros(0, np.uint64)] + [_pair(h[first[:-1]], h[first[:-1] + 1]) for _, _, h, first, _, _ in common.words(*common.text_buffers(batch.column("pattern")))]
            yield pa.record_batch([pa.array(common.signed(np.concatenate(pairs))), batch.column("times")], ["pair", "times"])

    return patterns.select("pattern", "times").mapInArrow(run, "pair long, times long")


def _counted(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(pair, n): how often the pairs in bits (and few others) come before a word, over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            parts = [p[_known(shared.value, p)] for _, _, p in _two_before(*common.text_buffers(batch.column("text")))]
            pairs, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            yield pa.record_batch([pa.array(common.signed(pairs)), pa.array(n.astype(np.int64))], ["pair", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pair long, n long")
    return counts.groupBy("pair").agg(F.sum("n").alias("n"))


def pointing(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Two filters of fixed size: of the pairs of words before a slot that point, and of the patterns with SUPPORT distinct seeds; None without any."""
    seeds = occurrences(docs).select(F.explode("slots").alias("s")).filter("s.seed").select("s.instance", F.explode("s.patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("times"))
    patterns = common.saved(seeds.groupBy("pattern").agg(F.count("*").alias("seeds"), F.sum("times").alias("times")).filter(F.col("seeds") >= SUPPORT), "supported")
    left = common.saved(_pairs_of(patterns.filter(F.col("pattern").endswith(" _"))), "pairs")
    if left.isEmpty():
        return None
    often = _counted(docs, common.maybe_in(left.select("pair"))).join(left, "pair").filter(F.col("times") >= F.lit(SHARE) * F.col("n"))
    pairs = common.saved(often.select("pair"), "pointing")
    return None if pairs.isEmpty() else (common.maybe_in(pairs), common.maybe_in(patterns.select(F.crc32("pattern"))))


def bootstrap(found: DataFrame) -> DataFrame:
    """Scored instances that are no seeds: (instance, score), confident ones only."""
    slots = found.select(F.explode("slots").alias("s")).select("s.instance", "s.seed", F.explode("s.patterns").alias("pattern"))
    edges = slots.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # A pattern of too few seeds never counts, so its edges are left out before the rounds.
    seeds = edges.filter("seed").groupBy("pattern").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= SUPPORT)
    edges = common.saved(edges.join(seeds.select("pattern"), "pattern"), "patterns")
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"), F.lit(0).cast("long").alias("patterns"))
    for _ in range(ROUNDS):
        patterns = edges.join(scores, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(PRIOR))).alias("p"))
        scored = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("score"), F.count("*").alias("patterns"))
        scores = common.saved(scored.select("instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("score")).alias("score"), "patterns", "seed"), "instances")
    return scores.filter(~F.col("seed") & (F.col("score") >= CONFIDENCE) & (F.col("patterns") >= 2)).select("instance", "score")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): see above."""
    # Rows are numbered by their place in the written table only to bring each one's found spans back to it.
    found = common.saved(occurrences(docs, pointing(docs)).withColumn("row", F.monotonically_increasing_id()), "personal")
    confident = bootstrap(found)
    slots = found.select("row", F.explode("slots").alias("s")).filter(~F.col("s.seed"))
    added = slots.withColumn("instance", F.col("s.instance")).join(confident, "instance")
    # A span within another one ends no later than those that begin before it, or with it and are longer.
    earlier = Window.partitionBy("row").orderBy("s.start", F.desc("s.end")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("before", F.max("s.end").over(earlier)).filter("before is null or s.end > before").groupBy("row").agg(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = found.drop("slots").join(added, "row", "left").withColumn("added", F.coalesce("added", none))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.all_written(F.col("base"), F.col("added"), KINDS, "found").alias("spans"), F.size("added").cast("long").alias("n_found"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(common.table(spark, sf_dir, "documents"))
