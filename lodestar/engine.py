"""The engine as one object: searches, explanations, principals and statistics over a state table and a graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.analysis import english, passages, tokens
from .operators import graph, reports, retrieval
from .operators.postings import Index
from .operators.proximity import VectorIndex
from .schemas import USER
from .session import cut


class Engine:
    """docs: the state (id or doc_id, ...), or a function that reads it (a stream's table, for one): each search reads it then, and its hits are checked against yet another reading, so what was deleted or hidden meanwhile isn't shown. edges: the graph's newest edges, or a function that reads them; epoch: a function that gives their number (the identity stream's, for one), which changes with every applied edge: expansions are kept as long as it stays, and a revoke is seen by the next search. Without it edges are taken as they are. embedder: a function of texts to vectors, for k-NN and hybrid. stems: match inflected English words and fold accents. index: written postings of the same analysis, else texts are read. vectors: written graphs, else all vectors are read."""

    def __init__(self, docs: DataFrame | Callable[[], DataFrame], edges: DataFrame | Callable[[], DataFrame], embedder: Callable[[Sequence[str]], list[list[float]]] | None = None, stems: bool = True, index: Index | None = None, epoch: Callable[[], int] | None = None, vectors: VectorIndex | None = None):
        self._state = docs if callable(docs) else lambda: docs
        self._read, self._epoch = (edges if callable(edges) else lambda: edges), epoch
        self.embedder, self.analyse, self.index, self.vectors = embedder, (english if stems else tokens), index, vectors
        self.spark = self._state().sparkSession
        self._vectors: dict[str, list[float]] = {}
        self._held: dict[str, DataFrame] = {}
        self._at: tuple[int, DataFrame] | None = None

    @property
    def docs(self) -> DataFrame:
        """The documents as they are now."""
        docs = self._state()
        docs = docs if "doc_id" in docs.columns else docs.withColumnRenamed("id", "doc_id")
        return docs if "updated_ms" in docs.columns else docs.withColumn("updated_ms", F.unix_millis("updated_at"))

    def _vector(self, text: str) -> list[float]:
        if text not in self._vectors:
            if len(self._vectors) >= 10_000:
                self._vectors.clear()
            self._vectors[text] = self.embedder([text])[0]
        return self._vectors[text]

    @property
    def edges(self) -> DataFrame:
        """The newest edges; of a new epoch they are read anew and what was expanded before is forgotten."""
        now = self._epoch() if self._epoch else 0
        if self._at is None or self._at[0] != now:
            self._at, self._held = (now, self._read()), {}
        return self._at[1]

    def expansion(self, user: str) -> DataFrame:
        """(user, principal, depth, path) of one user."""
        edges = self.edges
        if user not in self._held:
            if len(self._held) >= 10_000:
                self._held.clear()
            self._held[user] = graph.expand(edges, self.spark.createDataFrame([(user,)], "user string"))
        return self._held[user]

    def search(self, user: str, query: str = "", mode: str = "", datasources: Sequence[str] = (), kinds: Sequence[str] = (), limit: int = 10) -> DataFrame:
        """(doc_id, rank, score, ranks, title, url, matched, fresh_ms, snippet), the best first; what lost its permission meanwhile is dropped."""
        user = user if user.startswith(USER) else USER + user
        k, mode = retrieval.limit_of(limit), retrieval.mode_of(mode, query, self.embedder is not None)
        vector = self._vector(query) if mode in ("knn", "hybrid") else None
        one = self.spark.createDataFrame([(0, user, query, vector)], "query_id long, user string, query string, vector array<double>")
        expansion = self.expansion(user)
        wanted = {c: list(values) for c, values in (("datasource", datasources), ("kind", kinds)) if values}
        state = self.docs
        docs = retrieval.of_kinds(state, wanted)
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
        if not query.strip():
            hits = retrieval.browse(docs, one, expansion, k).select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank", none.alias("ranks"))
        else:
            depth = retrieval.DEPTH if mode == "hybrid" else k
            lists = {}
            if mode in ("bm25", "hybrid"):
                lists["bm25"] = retrieval.bm25(state, one, expansion, depth, self.index, self.analyse, wanted)
            if mode in ("knn", "hybrid"):
                lists["knn"] = retrieval.knn(state, one, expansion, depth, wanted, self.vectors)
            hits = retrieval.fuse(lists, k) if mode == "hybrid" else next(iter(lists.values())).withColumn("ranks", F.create_map(F.lit(mode), "rank"))
        # The hits are found; what holds now decides, of documents and of permissions.
        hits = cut(hits, "hits")
        now = self.docs
        ok = retrieval.checked(hits, now, one, graph.held(self.expansion(user))).filter("status = 'ok'")
        text = now.select("doc_id", "title", "url", "body")
        words = tokens(F.lit(query))
        return ok.join(text, "doc_id").select("doc_id", "rank", "score", "ranks", "title", "url", "matched", "fresh_ms", passages()(F.col("body"), words).alias("snippet")).orderBy("rank")

    def explain(self, user: str, doc_id) -> DataFrame:
        user = user if user.startswith(USER) else USER + user
        pair = self.spark.createDataFrame([(user, doc_id)], f"user string, doc_id {self.docs.schema['doc_id'].dataType.simpleString()}")
        return retrieval.explain(pair, self.docs, self.expansion(user))

    def principals(self, user: str) -> DataFrame:
        """(principals, truth, consistent) of one user: what searches use against the plain closure."""
        user = user if user.startswith(USER) else USER + user
        one = self.spark.createDataFrame([(user,)], "user string")
        true = graph.truth(self.edges, one).groupBy("user").agg(F.array_sort(F.collect_set("principal")).alias("truth"))
        return graph.held(self.expansion(user)).join(true, "user").select("principals", "truth", (F.col("principals") == F.col("truth")).alias("consistent"))

    def stats(self) -> DataFrame:
        """One row: live documents, hidden ones and those that wait for a vector."""
        d = self.docs.filter("not deleted")
        return d.agg(F.count("*").alias("docs"), F.count_if("quarantined").alias("quarantined"), F.count_if("needs_embed").alias("backlog"))

    def by_source(self) -> DataFrame:
        return retrieval.by_source(self.docs)

    def freshness(self) -> DataFrame:
        return reports.percentiles(retrieval.live(self.docs).withColumn("ms", retrieval.fresh_ms()).filter("ms > 0"), "ms")
