"""Ranked lexical search: postings of documents in shards, integer impacts computed once, one term at a time, and a merge of the shards' best.

1. The searches' terms get numbers. A pass over the documents hashes the words of each whole text and keeps the postings of those terms: a row for each shard of at most SHARD documents, with the documents' ids and lengths and the postings by term in compressed rows (term, where it starts, documents, counts). The number of documents with terms and of all their terms is gathered while the shards are written.
2. How many documents hold a term is summed over the shards, so weights are those of the whole table.
3. Each shard's impacts (weight times saturated count, in 64-bit integers) are computed once. Each search adds the impacts of its terms, one after the other, in a dense array of the shard's documents; a partition by score finds the k best, all that score more than the last of them and of its equals those with the smallest ids. A task keeps the best of all its shards, and these are merged in two steps, first within parts of the documents.

Terms are runs of ASCII letters and digits and of all beyond ASCII, A-Z lowered; the arithmetic is that of score(). Null and empty texts have no terms: they count nowhere. Rows without doc_id count in the statistics but can't be hits; repeated rows count and rank each for itself. Rows of one item_id are one search for the terms of all its texts; items without item_id, text or known terms give no rows, and empty tables give none. Very long texts are read whole. Other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Documents of a shard, terms of a pass over the documents, and searches of a pass over the shards, at most.
SHARD, TERMS, ITEMS = 4096, 1_000_000, 4096
#: Parts of the documents within which the tasks' best are merged first.
PARTS = 32
SHARDS = "ids binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the terms of texts, the first of each text and past the last of all, and how many each text has."""
    data, at = common.text_buffers(column)
    found, many = [np.zeros(0, np.uint64)], np.zeros(len(at) - 1, np.int64)
    for first, last, h, w, _, _ in common.words(data, at, common.ALNUM):
        found.append(h)
        many[first:last] = np.diff(w)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(many)]), many


def asked_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct: the hashes of the terms of each item."""

    def run(batches):
        for batch in batches:
            h, _, many = terms_of(batch.column("text"))
            yield pa.record_batch([batch.column("item_id").take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(common.signed(h))], ["item_id", "term"])

    kept = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    return kept.mapInArrow(run, "item_id long, term long").distinct()


def build(docs: DataFrame, terms: np.ndarray) -> tuple[DataFrame, int, int]:
    """The shards of docs (doc_id, text) for terms (sorted distinct hashes), written; the number of documents with terms, and of their terms."""
    spark, seen = docs.sparkSession, Observation()
    shared = spark.sparkContext.broadcast(terms)

    def run(batches):
        terms = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(terms >> np.uint64(44)).astype(np.int64)] = True
        for whole in batches:
            for lo in range(0, whole.num_rows, SHARD):
                batch = whole.slice(lo, SHARD)
                # A row without id is a document all the same: its id is marked as missing.
                ids, missing = pc.fill_null(batch.column("doc_id"), 0).to_numpy(), pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False)
                h, _, many = terms_of(batch.column("text"))
                doc = np.repeat(np.arange(len(many)), many)
                on = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(terms, h[on]), max(0, len(terms) - 1))
                hit = terms[place] == h[on] if len(terms) else np.zeros(len(on), bool)
                key, count = np.unique(place[hit] * len(many) + doc[on[hit]], return_counts=True)
                term, starts = np.unique(key // max(1, len(many)), return_index=True)
                blobs = [np.concatenate([ids, missing.astype(np.int64)]), many, term.astype(np.int32), np.append(starts, len(key)).astype(np.int32), (key % max(1, len(many))).astype(np.int32), count.astype(np.int32)]
                yield pa.record_batch([*[pa.array([b.tobytes()], pa.binary()) for b in blobs], pa.array([int((many > 0).sum())]), pa.array([int(many.sum())])], ["ids", "lengths", "terms", "starts", "places", "counts", "n", "total"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{SHARDS}, n long, total long")
    kept = common.saved(rows.observe(seen, F.sum("n").alias("n"), F.sum("total").alias("total")).drop("n", "total"), "shards")
    got = seen.get
    return kept, got["n"] or 0, got["total"] or 0


def frequencies(shards: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of size terms."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                total[np.frombuffer(terms.as_py(), np.int32)] += np.diff(np.frombuffer(starts.as_py(), np.int32))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["term", "n"])

    # A row for each term that is asked for.
    found = shards.select("terms", "starts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2n + 2) / (2df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """weight * (10**9 tf div (1000 tf + 8 m)), where m = 10 + 90 length n div total; all in 64-bit integers, rounded down."""
    m = 10 + (90 * length * n) // max(1, total)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def selected(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores above 0, of equal ones those with the smallest ids, the best first."""
    on = np.flatnonzero(score > 0)
    if len(on) > k:
        least = score[on[np.argpartition(score[on], len(on) - k)[len(on) - k]]]
        sure, equal = on[score[on] > least], on[score[on] == least]
        if len(equal) > k - len(sure):
            equal = equal[np.argpartition(ids[equal], k - len(sure) - 1)[: k - len(sure)]]
        on = np.concatenate([sure, equal])
    return on[np.lexsort((ids[on], -score[on]))]


def search(shards: DataFrame, n: int, total: int, weight: np.ndarray, items: list[tuple[int, np.ndarray]], k: int = K) -> DataFrame:
    """(item_id, doc_id, score): of each item (its terms' places) the best k of each task's shards."""
    shared = shards.sparkSession.sparkContext.broadcast((weight, items))

    def run(batches):
        weight, items = shared.value
        best = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item, _ in items}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, length, terms, starts, places, counts = (np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in (("ids", np.int64), ("lengths", np.int64), ("terms", np.int32), ("starts", np.int32), ("places", np.int32), ("counts", np.int32)))
                ids, missing = ids[: len(length)], ids[len(length) :] > 0
                impact = impacts(np.repeat(weight[terms], np.diff(starts)), counts.astype(np.int64), length[places], n, total)
                score = np.zeros(len(length), np.int64)
                for item, own in items:
                    score[:] = 0
                    at = np.searchsorted(terms, own)
                    at = at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == own)] if len(terms) else at[:0]
                    for t in at.tolist():
                        score[places[starts[t] : starts[t + 1]]] += impact[starts[t] : starts[t + 1]]
                    score[missing] = 0
                    top = selected(score, ids, k)
                    if len(top):
                        both = np.concatenate([best[item][0], score[top]]), np.concatenate([best[item][1], ids[top]])
                        keep = selected(*both, k)
                        best[item] = both[0][keep], both[1][keep]
        sizes = [len(best[item][0]) for item, _ in items]
        yield pa.record_batch([pa.array(np.repeat(np.array([x for x, _ in items], np.int64), sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *[best[x][1] for x, _ in items]])), pa.array(np.concatenate([np.zeros(0, np.int64), *[best[x][0] for x, _ in items]]))], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id long, doc_id long, score long")


def merged(hits: DataFrame, k: int = K) -> DataFrame:
    """The k best of each item with their ranks: within PARTS parts of the documents first, so that no task holds all tasks' best of an item."""
    order = (F.desc("score"), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    first = hits.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, terms: int = TERMS, group: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each of items (item_id, text).

    Items go in groups of about terms distinct terms, each a pass over the documents, and of group items, each a pass over the shards.
    """
    asked = common.saved(asked_terms(items), "asked")
    passes = max(1, -(-asked.select("term").distinct().count() // terms))
    out = None
    for p in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toArrow()
        known, place = np.unique(mine.column("term").to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
        if not len(known) and out is not None:
            continue
        ids, own = np.unique(mine.column("item_id").to_numpy(), return_inverse=True)
        order = np.lexsort((place, own))
        lists = np.split(place[order].astype(np.int32), np.searchsorted(own[order], np.arange(1, len(ids)))) if len(ids) else []
        shards, n, total = build(docs, known)
        weight = weights(frequencies(shards, len(known)), n)
        searches = list(zip(ids.tolist(), lists, strict=True))
        for lo in range(0, max(1, len(searches)), group):
            hits = search(shards, n, total, weight, searches[lo : lo + group], k)
            out = hits if out is None else out.unionByName(hits)
    return merged(out, k)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs WHERE len(w) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
impacts AS (
  SELECT d.doc_id, p.r, p.term, x.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * len(d.w) * t.n) // t.l))) AS s
  FROM postings p JOIN docs d ON d.r = p.r JOIN weights x ON x.term = p.term, totals t WHERE d.doc_id IS NOT NULL),
scores AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, r HAVING sum(s) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores) WHERE rank <= 10"""
