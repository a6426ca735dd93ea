"""Filter interaction audit: what each order of five filters removes of each part of the corpus, and each filter's share by the multilinear extension.

1. Each whole text fails some of the filters A to E: a mask of five bits. A to D judge the text alone. E, identity with the text of a smaller doc_id, is decided by SHA-256 of the text: of each text the rows of its smallest doc_id pass, wherever they are; copies are counted, never listed.
2. Of each part 32 counts are left, by mask: of all documents, of good and of toxic ones.
3. A part's removal polynomial is multilinear in five unknowns, the chance that a filter is in force: the sum over masks of count * (1 - product over the mask of (1 - x)), with exact integer coefficients. At corners it says how many documents a set of filters removes, whence the survivors of each step of each order. The integral of its partial derivative along the diagonal, in exact fractions, is the filter's Shapley value; 120 times that is what the filter removes in all 120 orders together.

The good and toxic ones are those that labels (doc_id, quality, toxic) marks with 1; of several labels of a doc_id the greatest counts. Null texts are empty ones, and all empty texts are identical. A null source is the part ''. Rows without doc_id never fail E and are nobody's copy's origin. Repeated rows of the smallest doc_id of a text all pass E; other repeated rows count each. An empty table gives no parts. Other columns aren't read.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 2, "#$%&*|"
COPY = 1 << FILTERS.index("E")
COUNTS = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """The bits of A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    said = F.length(text) - F.length(F.translate(text, SIGNS, ""))
    # The words are split once.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    tests = [counts["all"] < LEAST_WORDS, 100 * counts["distinct"] < DISTINCT_PERCENT * counts["all"], 100 * capitals > CAPITAL_PERCENT * F.length(text), said > 0]
    mask = F.lit(0)
    for i, test in enumerate(tests):
        mask = mask + F.when(test, 1 << i).otherwise(0)
    return mask.cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many of docs (doc_id, text, source) fail just the filters of mask, a row for each part and mask that occurs."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("hash"))
    # Repeated rows are counted here, before any join.
    rows = rows.groupBy("hash", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    one = lambda c: F.when(F.col(c) == 1, F.col("n")).otherwise(0)
    rows = common.saved(rows.join(marks, "doc_id", "left").select("hash", "doc_id", "part", "mask", "n", one("quality").alias("good"), one("toxic").alias("toxic")), "failures")
    least = rows.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least, ["hash", "doc_id"], "left_semi").unionByName(rows.filter("doc_id is null"))
    # All are copies, but for the first ones.
    signed = lambda df, mask, sign: df.select("part", mask.alias("mask"), *[(sign * F.col(c)).alias(c) for c in COUNTS])
    parts = signed(rows, F.col("mask") + COPY, 1).unionByName(signed(first, F.col("mask") + COPY, -1)).unionByName(signed(first, F.col("mask"), 1))
    return parts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter("n > 0")


class Removal:
    """The polynomial of what filters remove: coefficients by set of unknowns, as bits."""

    def __init__(self, counts: list[int], size: int = len(FILTERS)):
        """counts: documents by the mask of filters that they fail."""
        self.size = size
        # Of each set, the documents that fail all of it; 1 - product(1 - x) has the coefficient 1 or -1 for each subset of a mask.
        holding = list(counts)
        for i in range(size):
            for s in range(1 << size):
                if not s >> i & 1:
                    holding[s] += holding[s | 1 << i]
        self.coefficients = [0 if not s else holding[s] * (-1) ** (s.bit_count() + 1) for s in range(1 << size)]

    def corner(self, on: int) -> int:
        """Its value where the unknowns of on are 1 and the others 0: what these filters remove."""
        return sum(c for s, c in enumerate(self.coefficients) if s & on == s)

    def corners(self) -> np.ndarray:
        """All corners' values, by set."""
        v = np.array(self.coefficients, np.int64)
        for i in range(self.size):
            s = np.arange(len(v))
            v = v + np.where(s >> i & 1, v[s & ~(1 << i)], 0)
        return v

    def shapley(self, i: int) -> Fraction:
        """The integral from 0 to 1 of the partial derivative by unknown i where all unknowns are equal: a term of degree d gives its coefficient / d."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coefficients) if c and s >> i & 1), Fraction(0))


ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the 5 steps of each of the 120 orders: the filter, the set of filters before it and with it."""
    at = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    with_it = np.cumsum(1 << at, 1)
    return at.ravel(), (with_it - (1 << at)).ravel(), with_it.ravel()


def report(part: str, counts: dict[str, list[int]]) -> pa.RecordBatch:
    """The 600 rows of a part."""
    at, before, after = _steps()
    polynomials = {c: Removal(counts[c]) for c in COUNTS}
    values = {c: p.corners() for c, p in polynomials.items()}
    removed = {c: v[after] - v[before] for c, v in values.items()}
    n, every = sum(counts["n"]), (1 << len(FILTERS)) - 1
    alone = values["n"][1 << at]
    fractions = [polynomials["n"].shapley(i) * len(ORDERS) for i in range(len(FILTERS))]
    assert all(x.denominator == 1 for x in fractions)
    shapley = np.array([int(x) for x in fractions], np.int64)[at]
    columns = [n - values["n"][after], removed["n"], alone - removed["n"], values["n"][every] - values["n"][every - (1 << at)], removed["good"], removed["toxic"], shapley]
    size = len(FILTERS)
    return pa.record_batch([pa.array([part] * len(at)), pa.array(np.repeat(ORDERS, size)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(ORDERS))), *[pa.array(c.astype(np.int64)) for c in columns]], [c.split()[0] for c in SCHEMA.split(", ")])


def audited(counts: DataFrame) -> DataFrame:
    """The rows of report() for each part of mask_counts()."""
    # 32 entries a part at most.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("entries"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lists = {c: [0] * (1 << len(FILTERS)) for c in COUNTS}
                for e in row["entries"]:
                    for c in COUNTS:
                        lists[c][e["mask"]] = e[c]
                yield report(row["part"], lists)

    return parts.mapInArrow(run, SCHEMA)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(mask_counts(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")))


#: Every order is played step by step.
OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_ids AS (SELECT text, min(doc_id) AS least_id FROM texts GROUP BY text),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT t.part, coalesce(m.quality = 1, false) AS good, coalesce(m.toxic = 1, false) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 2 * length(t.text) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN t.doc_id > l.least_id THEN 'E' ELSE '' END) AS fails
  FROM texts t JOIN least_ids l ON l.text = t.text LEFT JOIN marks m ON m.doc_id = t.doc_id),
classes AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, CAST(s AS INT), 1) AS f, substr(filter_order, 1, CAST(s AS INT) - 1) AS earlier FROM orders, range(1, 6) r(s)),
played AS (
  SELECT c.part, s.filter_order, s.step, s.f,
    sum(CASE WHEN translate(c.fails, s.earlier || s.f, '') = c.fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(c.fails, s.earlier, '') = c.fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(c.fails, s.earlier, '') <> c.fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN c.fails = s.f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(c.fails, s.earlier, '') = c.fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(c.fails, s.earlier, '') = c.fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM classes c, steps s GROUP BY c.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM played"""
