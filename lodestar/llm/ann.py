"""Approximate nearest neighbours by largest inner product: inverted lists and an adaptive dimension scan.

Inner products become distances by one more coordinate, sqrt(M - |x|^2) with M the largest squared length. Lists, as many as the root of the rows but at most an eighth of the sample, come from k-means on a bounded sample (SAMPLE rows, least hash of vec_id); every vector is entered in the list of its nearest centre. How many lists a query probes is measured on the sample: enough for RECALL of the true neighbours there.

A query first scans its nearest list; what it finds there is its limit in the next seven, and what it has then in the rest (in waves, WIDER times as many lists after each), so these give only what is better. In a list vectors are rotated at random and scanned in blocks of COLUMNS columns, PART vectors at a time. After each block of columns a hypothesis test asks, from the partial distance over t of d rotated columns, whether the whole one can still be below the query's k-th best so far; pairs that it rejects are abandoned. What is left gets its exact inner product on the original vectors, in double precision, and lowers the limit.

Vectors go to the lists' tasks in blocks of about BLOCK against blocks of about BLOCK queries that probe the list, whatever a list's size; each block sends on its best k of each query below its limit.

Vectors that are null, zero, hold null or non-finite components or haven't the commonest length take no part, nor do rows without vec_id. Of rows with the same vec_id the greatest vector counts. Ties go to the smaller vec_id. Fewer candidates than k: all. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY = 20, 20
SAMPLE, RECALL = 16_384, 0.97
BLOCK, PART, COLUMNS, EPSILON = 4096, 1024, 16, 2.5
#: Growth, from wave to wave, of the lists that a query has probed.
WIDER = 8


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): usable vectors as arrays of doubles (of floats, if they are given as such), one for each id."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~bad & F.exists("v", lambda x: x != 0))
    common_size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("v") == (common_size.n if common_size else 0)).groupBy("vec_id").agg(F.max("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres, from evenly spaced rows; empty ones stay where they are."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_lists(x, centres, 1)[:, 0]
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres**2).sum(1)[None] - 2 * x @ centres.T
    return d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))])


class Lists:
    """Centres (augmented), the rotation, the largest squared length and how many lists to probe."""

    def __init__(self, sample: np.ndarray, most: float, total: int):
        d = sample.shape[1]
        self.most, self.rotation = most, np.linalg.qr(np.random.default_rng(7).normal(size=(d, d)))[0]
        n = int(max(1, min(np.sqrt(total), len(sample) // 8)))
        a = augmented(sample, most)
        self.centres = kmeans(a, n)
        self.probes = self._probes(sample, a)

    def _probes(self, sample: np.ndarray, a: np.ndarray) -> int:
        q = np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int)
        order = self.order(sample[q])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        own = nearest_lists(a, self.centres, 1)[:, 0]
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -np.inf
        best = np.argsort(-score, axis=1)[:, : min(K, len(sample) - 1)]
        ranks = np.take_along_axis(place, own[best], 1).ravel()
        return int(np.quantile(ranks, RECALL, method="higher")) + 1 if len(ranks) else 1

    def order(self, q: np.ndarray) -> np.ndarray:
        """Of each query the lists from near to far."""
        return nearest_lists(np.column_stack([q, np.zeros(len(q))]), self.centres, len(self.centres))


def scan(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, lists: Lists, k: int = K, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the best k of each query among the vectors, by the adaptive scan. least: scores below which a query needs none (-inf: any)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rx, rq = x @ lists.rotation, q @ lists.rotation
    extra = np.maximum(0, lists.most - (x * x).sum(1))
    length = (q * q).sum(1)
    d, out = x.shape[1], []
    for lo in range(0, len(q), 128):
        part = slice(lo, lo + 128)
        m = len(q[part])
        # The best so far of each query: scores and places of vectors, the least last.
        best, place = np.full((m, k), -np.inf), np.full((m, k), -1)
        floor = np.full(m, -np.inf) if least is None else least[part].copy()
        for x0 in range(0, len(x), PART):
            xs = slice(x0, x0 + PART)
            # As a distance: |q|^2 + M - 2 qx.
            limit = np.where(np.isfinite(floor), length[part] + lists.most - 2 * floor, np.inf)
            qi, xi = _survivors(rq[part], rx[xs], extra[xs], limit)
            ok = query_ids[part][qi] != ids[xs][xi]
            qi, xi = qi[ok], xi[ok]
            score = np.einsum("ij,ij->i", q[part][qi], x[xs][xi])
            ok = score >= floor[qi]
            qi, xi, score = qi[ok], xi[ok] + x0, score[ok]
            if not len(qi):
                continue
            some = np.unique(qi)
            a = np.concatenate([np.repeat(some, k), qi])
            s = np.concatenate([best[some].ravel(), score])
            p = np.concatenate([place[some].ravel(), xi])
            by = np.lexsort((np.where(p < 0, len(x), p), -s, a))
            a, s, p = a[by], s[by], p[by]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            best[some], place[some] = s[keep].reshape(-1, k), p[keep].reshape(-1, k)
            floor = np.maximum(floor, best[:, -1])
        a, r = np.nonzero(place >= 0)
        out.append((query_ids[part][a], ids[place[a, r]], best[a, r]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _survivors(rq: np.ndarray, rx: np.ndarray, extra: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that the hypothesis test leaves, block of columns by block: the partial distance over t of d rotated columns, scaled by d / t, has to be within the room that the limit leaves, with a slack that shrinks with the root of t."""
    if np.isinf(limit).all():
        return tuple(x.ravel() for x in np.indices((len(rq), len(rx))))
    d = rx.shape[1]
    room = limit[:, None] - extra[None]
    partial, qi, xi, alive = np.zeros(room.shape), None, None, None
    for t0 in range(0, d, COLUMNS):
        t1 = min(d, t0 + COLUMNS)
        bq, bx = rq[:, t0:t1], rx[:, t0:t1]
        if qi is None:
            partial += (bq**2).sum(1)[:, None] + (bx**2).sum(1)[None] - 2 * bq @ bx.T
            now, left = partial, room
        else:
            diff = bq[qi] - bx[xi]
            now, left = alive + np.einsum("ij,ij->i", diff, diff), room[qi, xi]
        slack = 1 + EPSILON / np.sqrt(t1) if t1 < d else 1
        keep = np.maximum(now, 0) * (d / t1) <= left * slack**2 + 1e-9 * (1 + np.abs(left))
        if qi is not None:
            qi, xi, alive = qi[keep], xi[keep], now[keep]
        elif t1 == d or keep.mean() < 0.3:
            qi, xi = np.nonzero(keep)
            alive = partial[qi, xi]
    return qi, xi


def search(vectors: DataFrame, queries, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each of the vectors that the condition queries (on vec_id) picks."""
    spark = vectors.sparkSession
    all_ = common.saved(valid(vectors), "vectors")
    square = lambda x: x.cast("double") * x.cast("double")
    total, most = all_.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + square(x)))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.v for r in all_.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()], np.float64)
    lists = Lists(sample, most, total)
    shared = spark.sparkContext.broadcast(lists)
    kind = all_.schema["v"].dataType.simpleString()
    stacked = lambda v: np.stack(v).astype(np.float64)

    def entered(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"list": nearest_lists(augmented(stacked(f.v), shared.value.most), shared.value.centres, 1)[:, 0].astype(np.int32), "vec_id": f.vec_id, "v": f.v})

    def probing(frames):
        for f in frames:
            if len(f):
                order = shared.value.order(stacked(f.v))[:, : shared.value.probes]
                yield pd.DataFrame({"query_id": f.vec_id, "lists": list(order.astype(np.int32)), "q": f.v})

    index = common.saved(all_.mapInPandas(entered, f"list int, vec_id long, v {kind}"), "lists")
    probes = common.saved(all_.filter(queries).mapInPandas(probing, f"query_id long, lists array<int>, q {kind}"), "probes")
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    schema = "query_id long, vec_id long, score double"

    def found_in(asked: DataFrame) -> DataFrame:
        """asked (query_id, list, q, least): what the lists give."""
        # A row for each list, of which there are at most an eighth of the sample: small enough to send to every task.
        grid = F.broadcast(sizes.join(asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")), "list"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        x = index.join(grid, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("q_block", spread("q_blocks")).select("list", "block", "q_block", "vec_id", "v")
        q = asked.join(grid, "list").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int")).withColumn("block", spread("blocks")).select("list", "block", "q_block", "query_id", "least", "q")

        def block(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            a, b, s = scan(left.vec_id.to_numpy(), stacked(left.v), right.query_id.to_numpy(), stacked(right.q), shared.value, k, right.least.to_numpy())
            return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

        key = ["list", "block", "q_block"]
        return common.saved(x.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(block, schema), "found")

    found, done = found_in(probes.select("query_id", F.col("lists")[0].alias("list"), "q", F.lit(float("-inf")).alias("least"))), 1
    # The rest in waves: what a query has found so far, k rows of each list and block at most, is its limit in the next.
    while done < lists.probes:
        limits = found.groupBy("query_id").agg(F.expr(f"try_element_at(sort_array(collect_list(score), false), {k})").alias("least"))
        wave = probes.select("query_id", F.explode(F.slice("lists", done + 1, done * (WIDER - 1))).alias("list"), "q").join(limits, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found, done = found.union(found_in(wave)), done * WIDER
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0)
