"""Approximate nearest neighbours by cosine over written graphs: layered small-world graphs, one for each segment of the documents.

Documents with a vector fall into segments by the hash of their id, of some thousands where that keeps all tasks busy; a task builds a segment's graph (Malkov and Yashunin, 2016: M links a node, twice as many in the lowest layer, EF candidates looked at for each node) and writes it as one row: ids, vectors, links and what permissions need. Tasks that search take the row's bytes as arrays, without a copy.

Nodes are ordered by layer, so each layer is a beginning of the arrays; they are added in rounds that double, all of a round walking at once, as searches do. What a user may not see is walked through but isn't a hit, with a beam that grows as fewer documents can be seen; where so few can be seen that the walk would look at more vectors than there are hits to be had, these are scored one by one instead. Scores are exact: those of the original vectors, in double precision.

Batches, replaced documents and filters are those of postings.Index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .postings import MARKS, Written, marks_of, visible_marks
from .retrieval import DEPTH, _best_of, _holders, _passes, best

#: Links of a node, candidates looked at when it is added, and those kept in the beam of a search.
M, EF, BEAM = 16, 128, 128
#: Cells of the table of visited nodes, and candidates that links are chosen from.
CELLS, CHOICE = 1 << 26, 64
#: Documents of a segment, at the least, before there are as many segments as tasks that run at once.
SMALL = 4096
#: A beam is so many times as wide as the nodes that a step of its walk opens.
STEPS = 32


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in single precision; zero vectors stay."""
    v = vectors.astype(np.float64)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return (v / np.where(n > 0, n, 1)).astype(np.float32)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest nodes that walks of all queries find from their entries, the nearest first, and their similarities; -1 where there are fewer."""
    n, q = len(links), len(queries)
    ef = max(1, min(ef, n))
    ids, sims = np.full((q, ef), -1, np.int64), np.full((q, ef), -np.inf, np.float32)
    done, seen = np.zeros((q, ef), bool), np.zeros((q, n), bool)
    ids[:, 0], sims[:, 0] = entry, np.einsum("qd,qd->q", vectors[entry], queries)
    seen[np.arange(q), entry] = True
    # So many nodes of each walk are opened together that the steps don't grow in number with the beam.
    active, together = np.arange(q), max(1, ef // STEPS)
    while len(active):
        waiting = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        at = waiting.argmax(1)[:, None] if together == 1 else np.argpartition(-waiting, together - 1, 1)[:, :together]
        ok = np.isfinite(np.take_along_axis(waiting, at, 1))
        on = ok.any(1)
        active, at, ok = active[on], at[on], ok[on]
        if not len(active):
            break
        row = active[:, None]
        done[row, at] = True
        near = np.where(ok[:, :, None], links[ids[row, at]], -1).reshape(len(active), -1)
        new = (near >= 0) & ~seen[row, np.maximum(near, 0)]
        row, column = np.nonzero(new)
        if together > 1:
            # A node that several of them lead to is new once.
            first = np.unique(row * n + near[row, column], return_index=True)[1]
            row, column = row[first], column[first]
            new[:] = False
            new[row, column] = True
        seen[active[row], near[row, column]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[row, column] = np.einsum("kd,kd->k", vectors[near[row, column]], queries[active[row]])
        all_s = np.concatenate([sims[active], s], 1)
        top = np.argpartition(-all_s, ef - 1, 1)[:, :ef] if all_s.shape[1] > ef else np.broadcast_to(np.arange(ef), (len(active), ef))
        take = lambda x, y: np.take_along_axis(np.concatenate([x, y], 1), top, 1)
        sims[active], ids[active], done[active] = take(sims[active], s), take(ids[active], np.where(new, near, -1)), take(done[active], np.zeros(near.shape, bool))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (the nearest first, -1 for none) at most `most`: those nearer to the row's node than to any chosen before them, then the others by nearness."""
    ids, sims = ids[:, :CHOICE], sims[:, :CHOICE]
    out = np.full((len(ids), most), -1, np.int64)
    for lo in range(0, len(ids), 512):
        i, s = ids[lo : lo + 512], sims[lo : lo + 512]
        v = vectors[np.maximum(i, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(i.shape, bool)
        for j in range(i.shape[1]):
            kept[:, j] = (i[:, j] >= 0) & ~((between[:, :j, j] >= s[:, j, None]) & kept[:, :j]).any(1)
        rank = np.argsort(np.where(i < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :most]
        out[lo : lo + 512, : rank.shape[1]] = np.take_along_axis(i, rank, 1)
    return out


def _linked(vectors: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds links from source to target (pairs, distinct); full nodes choose anew."""
    order = np.lexsort((target, source))
    source, target = source[order], target[order]
    nodes, first, many = np.unique(source, return_index=True, return_counts=True)
    cap = links.shape[1]
    for lo in range(0, len(nodes), 2048):
        own, n = nodes[lo : lo + 2048], many[lo : lo + 2048]
        more = np.full((len(own), n.max()), -1, np.int64)
        row = np.repeat(np.arange(len(own)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        more[row, place] = target[first[lo] : first[lo] + n.sum()]
        ids = np.concatenate([links[own], more], 1)
        s = np.where(ids >= 0, np.einsum("nkd,nd->nk", vectors[np.maximum(ids, 0)], vectors[own]), -np.inf)
        by = np.argsort(-s, axis=1, kind="stable")
        ids, s = np.take_along_axis(ids, by, 1), np.take_along_axis(s, by, 1)
        full = (ids >= 0).sum(1) > cap
        links[own[~full]] = ids[~full][:, :cap]
        if full.any():
            links[own[full]] = choose(vectors, ids[full], s[full], cap)


class Graph:
    """Layers of links, the highest first; layer l links the first len(layers[l]) nodes."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def sizes(n: int, m: int = M) -> list[int]:
        """How many nodes each layer holds: all, and an m-th of those below while that is several."""
        out = [n]
        while out[-1] >= 2 * m:
            out.append(out[-1] // m)
        return out[::-1]

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = M, ef: int = EF) -> Graph:
        """vectors: of length 1, in an order that has nothing to do with where they lie."""
        graph = cls(vectors, [])
        sizes = cls.sizes(len(vectors), m)
        for layer, n in enumerate(sizes):
            links = np.full((n, m if layer + 1 < len(sizes) else 2 * m), -1, np.int64)
            lo = 0
            while lo < n:
                hi = min(n, max(2 * lo, 2 * m), lo + 1024)
                new, inside = vectors[lo:hi], vectors[lo:hi] @ vectors[lo:hi].T
                np.fill_diagonal(inside, -np.inf)
                near = np.argsort(-inside, axis=1, kind="stable")[:, : min(m * 2, hi - lo - 1)]
                ids, sims = near + lo, np.take_along_axis(inside, near, 1)
                if lo:
                    entry = graph.entries(new)
                    found, s = beam(vectors, links[:lo], new, np.where(entry < lo, entry, 0), ef)
                    ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, s], 1)
                    by = np.argsort(-sims, axis=1, kind="stable")
                    ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
                chosen = choose(vectors, ids, sims, m)
                links[lo:hi, :m] = chosen
                row, column = np.nonzero(chosen >= 0)
                a, b = row + lo, chosen[row, column]
                # Links back, but for those that are there already.
                there = (links[b] == a[:, None]).any(1)
                _linked(vectors, links, b[~there], a[~there])
                lo = hi
            graph.layers.append(links)
        return graph

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """The nearest node that each query finds in the layers that are there, down to the lowest of them."""
        at = np.zeros(len(queries), np.int64)
        for links in self.layers:
            at = beam(self.vectors, links, queries, at, 4)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """A row of at most ef nodes for each query, -1 where there are fewer."""
        out, chunk = [], max(1, min(CELLS // max(1, len(self.vectors)), CELLS // (16 * max(1, ef))))
        upper = Graph(self.vectors, self.layers[:-1])
        for lo in range(0, len(queries), chunk):
            own = queries[lo : lo + chunk]
            out.append(beam(self.vectors, self.layers[-1], own, upper.entries(own), ef)[0])
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def _grown(m: int, ef: int, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, v = table.column("doc_id").combine_chunks(), table.column("v").combine_chunks()
        d = len(v[0])
        vectors = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
        segment = table.column("segment")[0].as_py()
        order = np.random.default_rng(segment).permutation(len(vectors))
        ids, vectors = ids.take(pa.array(order)), np.ascontiguousarray(vectors[order])
        graph = Graph.build(unit(vectors), m, ef)
        marks = table.column("marks").combine_chunks().take(pa.array(order))
        seen: dict = {}
        mark = np.array([seen.setdefault(repr(x), len(seen)) for x in marks.to_pylist()], np.int32)
        distinct = marks.take(pa.array(np.unique(mark, return_index=True)[1]))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        links = pa.array([x.astype(np.int32).tobytes() for x in graph.layers], pa.binary())
        caps = pa.array([x.shape[1] for x in graph.layers], pa.int32())
        columns = [pa.array([segment]), one(ids), pa.array([vectors.tobytes()], pa.binary()), one(links), one(caps), one(pa.array(mark)), one(distinct)]
        return pa.Table.from_arrays(columns, schema.names).cast(schema)

    return run


class VectorIndex(Written):
    """Graphs of documents' vectors below a folder that all executors reach, by batch."""

    KIND = "graphs"

    def __init__(self, spark: SparkSession, path: str, m: int = M, ef: int = EF, segment: int = 16_384):
        super().__init__(spark, path)
        self.m, self.ef, self.segment = m, ef, segment

    def _schema(self, doc: str) -> str:
        return f"segment long, docs array<{doc}>, vectors binary, links array<binary>, caps array<int>, mark array<int>, marks array<{MARKS}>"

    def entries(self, before: int | None = None) -> DataFrame | None:
        """(segment, doc_id): the documents that segments hold, replaced ones too."""
        rows = self._read(self.KIND, self._schema(self._doc()), before) if self.batches() else None
        return None if rows is None else rows.select("segment", F.explode("docs").alias("doc_id"))

    def update(self, changed: DataFrame, batch: int | None = None) -> None:
        """Adds the newest rows of changed documents (doc_id or id, embedding, deleted, quarantined, and allowed, datasource, container and kind where they are there). Vectors with nulls or of another length than the commonest of the batch aren't taken. batch: its number, by default the next; the highest may be done again."""
        changed = changed if "doc_id" in changed.columns else changed.withColumnRenamed("id", "doc_id")
        number = self._number(batch)
        doc = changed.schema["doc_id"].dataType.simpleString()
        whole = changed.filter("not deleted and embedding is not null and size(embedding) > 0").filter(~F.exists("embedding", lambda x: x.isNull()))
        lengths = whole.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
        n = lengths[0].n if lengths else 0
        if n:
            segments = max(-(-n // self.segment), min(self.spark.sparkContext.defaultParallelism, n // SMALL))
            of = F.lit(number << 32) + F.pmod(F.xxhash64("doc_id"), F.lit(segments))
            rows = whole.filter(F.size("embedding") == lengths[0].d).select(of.alias("segment"), "doc_id", F.col("embedding").cast("array<float>").alias("v"), marks_of(changed).alias("marks"))
            schema = to_arrow_schema(self.spark.createDataFrame([], self._schema(doc)).schema)
            rows.groupBy("segment").applyInArrow(_grown(self.m, self.ef, schema), self._schema(doc)).write.mode("overwrite").parquet(f"{self.path}/{self.KIND}/{number}")
        else:
            self.spark.createDataFrame([], self._schema(doc)).write.mode("overwrite").parquet(f"{self.path}/{self.KIND}/{number}")
        self._replace(changed, number, ["segment", "doc_id"], f"segment long, doc_id {doc}")
        self._finish(self.spark.createDataFrame([(n,)], "n long"), number)

    def replaced(self, before: int | None = None) -> DataFrame | None:
        return self._read("replaced", f"segment long, doc_id {self._doc()}", before) if self.batches() else None

    def search(self, searches: DataFrame, held: DataFrame | None, k: int = DEPTH, wanted: dict[str, list[str]] | None = None, ef: int = BEAM, scan: bool = True) -> DataFrame:
        """(query_id, doc_id, score, rank), as retrieval.knn gives them but for what the walk misses. scan: whether few visible documents are scored one by one."""
        if not self.batches():
            raise ValueError(f"there is no index at {self.path}")
        doc = self._doc()
        graphs, gone, out = self._read(self.KIND, self._schema(doc)), self.replaced(), None
        # As many ids as a segment holds.
        gone = gone.groupBy("segment").agg(F.collect_list("doc_id").alias("gone"))
        rows = graphs.join(gone, "segment", "left")
        asked = searches.filter("vector is not null").select("query_id", "user", F.col("vector").cast("array<double>").alias("vector"))
        for mine, pairs in _passes(asked, held):
            part = rows.mapInArrow(_walked(self.spark, mine.orderBy("query_id").collect(), pairs, k, wanted or {}, ef, scan), f"query_id long, doc_id {doc}, score double")
            out = part if out is None else out.unionByName(part)
        return best(out, k).select("query_id", "doc_id", "score", "rank")


def _walked(spark, searches, pairs, k: int, wanted: dict[str, list[str]], ef: int, scan: bool):
    users = {u: i for i, u in enumerate(sorted({r.user for r in searches}))}
    asked = [(r.query_id, users[r.user], np.array(r.vector, np.float64)) for r in searches if all(x is not None for x in r.vector) and any(r.vector)]
    shared = spark.sparkContext.broadcast((asked, _holders(users, pairs), len(users)))

    def one(batch: pa.RecordBatch, row: int):
        asked, holders, n_users = shared.value
        cell = lambda c: batch.column(c)[row]
        docs = cell("docs").values
        raw = np.frombuffer(cell("vectors").as_buffer(), np.float32).reshape(len(docs), -1)
        mine = [x for x in asked if len(x[2]) == raw.shape[1]]
        if not mine:
            return
        layers = [np.frombuffer(b.as_buffer(), np.int32).reshape(-1, c.as_py()) for b, c in zip(cell("links").values, cell("caps").values, strict=True)]
        graph = Graph(unit(raw), layers)
        see = visible_marks(cell("marks").values, holders, n_users, wanted)[cell("mark").values.to_numpy()]
        if cell("gone").is_valid:
            see[pc.drop_null(pc.index_in(cell("gone").values, docs)).to_numpy()] = False
        ids, user = np.array([x[0] for x in mine], np.int64), np.array([x[1] for x in mine])
        q = np.stack([x[2] for x in mine])
        many = see.sum(0)[user]
        norms = np.sqrt((q * q).sum(1))
        length = np.sqrt((raw.astype(np.float64) ** 2).sum(1))
        n, cap = len(docs), layers[-1].shape[1]
        # A walk for ef visible nodes looks at about cap * ef * n / many vectors.
        alone = (many.astype(np.float64) ** 2 <= cap * ef * n) & scan
        groups = {u: np.flatnonzero(alone & (user == u) & (many > 0)) for u in np.unique(user[alone & (many > 0)])}
        for u, own in groups.items():
            at = np.flatnonzero(see[:, u])
            yield _scored(docs, raw, length, at[None].repeat(len(own), 0), q[own], norms[own], ids[own], k)
        walking = np.flatnonzero(~alone & (many > 0))
        size = np.minimum(n, 2 ** np.ceil(np.log2(np.maximum(ef, k) * n / np.maximum(many[walking], 1)))).astype(np.int64)
        for width in np.unique(size):
            own = walking[size == width]
            found = graph.search((q[own] / norms[own, None]).astype(np.float32), int(width))
            found = np.where((found >= 0) & see[np.maximum(found, 0), user[own][:, None]], found, -1)
            yield _scored(docs, raw, length, found, q[own], norms[own], ids[own], k)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield from one(batch, row)

    return run


def _scored(docs: pa.Array, raw: np.ndarray, length: np.ndarray, found: np.ndarray, q: np.ndarray, norms: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each search (row) among its found nodes, -1 for none, by exact cosine."""
    at, place = np.unique(found, return_inverse=True)
    place = place.reshape(found.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.round((raw[np.maximum(at, 0)].astype(np.float64) @ q.T) / (length[np.maximum(at, 0), None] * norms[None]), 6)
    own = np.zeros(s.shape, bool)
    own[place, np.arange(len(found))[:, None]] = True
    s[~own | (at < 0)[:, None] | ~np.isfinite(s)] = -np.inf
    return _best_of(s, docs.take(pa.array(np.maximum(at, 0))).to_numpy(zero_copy_only=False), ids, k)
