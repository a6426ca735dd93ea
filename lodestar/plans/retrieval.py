"""Queries on permission-aware retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import first_tokens, passages, standard, tokens
from ..functions.scalar import seeded
from ..operators import fold, graph, reports, retrieval, trials
from ..operators.closure import Closure
from ..operators.postings import Index
from ..operators.proximity import VectorIndex
from ..session import cut, scratch, table
from . import fixtures as fx
from .changelog import STATE_SQL
from .fixtures import with_
from .permissions import edges_of


def _inputs(spark: SparkSession, sf_dir: str, vectors: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs, searches, what the searching users hold, and the graph. vectors: as of fixtures.docs; where words alone are read, texts needn't move to be joined with them."""
    edges = cut(edges_of(spark, sf_dir), "edges")
    searches = fx.searches(spark, sf_dir)
    return fx.docs(spark, sf_dir, vectors), searches, cut(graph.expand(edges, searches.select("user")), "expansion"), edges


#: Postings and statistics of title and body, over documents that aren't deleted.
INDEX = r"""
words AS (
  SELECT doc_id, 'title' AS field, regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}]+') AS w FROM docs WHERE NOT deleted
  UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(coalesce(body, '')), '[\p{L}\p{N}]+') FROM docs WHERE NOT deleted),
stats AS (SELECT field, count(*) AS n, sum(len(w)) / count(*) AS avg_len FROM words WHERE len(w) > 0 GROUP BY field),
postings AS (SELECT field, doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT field, doc_id, len(w) AS l, unnest(w) AS term FROM words) GROUP BY field, doc_id, term),
freq AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term)"""

VISIBLE = """
acl AS (SELECT doc_id, unnest(allowed) AS principal FROM docs WHERE NOT deleted AND NOT quarantined),
seen AS (SELECT DISTINCT s.usr, a.doc_id FROM (SELECT DISTINCT usr FROM searches) s JOIN held h ON h.usr = s.usr JOIN acl a ON a.principal = h.principal)"""


def _bm25_sql(visible: str, name: str = "bm25", own: str = "searches") -> str:
    return f"""
{name}_terms AS (SELECT query_id, usr, term, count(*) AS qtf FROM (SELECT query_id, usr, unnest(words) AS term FROM {own}) GROUP BY query_id, usr, term),
{name}_parts AS (
  SELECT t.query_id, t.usr, p.doc_id, p.field,
    sum(qtf * CASE WHEN p.field = 'title' THEN 3.0 ELSE 1.0 END * ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.l / s.avg_len))) AS w
  FROM {name}_terms t JOIN postings p ON p.term = t.term JOIN freq f ON f.field = p.field AND f.term = p.term JOIN stats s ON s.field = p.field GROUP BY t.query_id, t.usr, p.doc_id, p.field),
{name}_scores AS (
  SELECT query_id, usr, doc_id, round(max(w) + 0.2 * (sum(w) - max(w)), 6) AS score FROM {name}_parts GROUP BY query_id, usr, doc_id),
{name} AS (
  SELECT query_id, doc_id, score, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c.doc_id) AS rank FROM {name}_scores c {visible}) WHERE rank <= 50)"""


_SEEN = "JOIN seen v ON v.usr = c.usr AND v.doc_id = c.doc_id"
_LIVE = "JOIN (SELECT doc_id FROM docs WHERE NOT deleted AND NOT quarantined) v ON v.doc_id = c.doc_id"


def _knn_sql(visible: str, name: str = "knn", own: str = "searches") -> str:
    return f"""
{name}_scores AS (
  SELECT s.query_id, s.usr, d.doc_id, round(list_cosine_similarity(CAST(s.vector AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
  FROM {own} s, docs d WHERE s.vector IS NOT NULL AND d.embedding IS NOT NULL),
{name} AS (
  SELECT query_id, doc_id, score, rank FROM (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c.doc_id) AS rank FROM {name}_scores c {visible}) WHERE rank <= 50)"""


RRF = """
fused AS (
  SELECT query_id, doc_id, round(sum(1 / (60 + CAST(rank AS DOUBLE))), 6) AS score, min(rank) AS top, string_agg(list || '=' || rank, ',' ORDER BY list) AS ranks
  FROM (SELECT 'bm25' AS list, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'knn', query_id, doc_id, rank FROM knn) GROUP BY query_id, doc_id),
hybrid AS (SELECT query_id, doc_id, score, rank, ranks FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, top, doc_id) AS rank FROM fused) WHERE rank <= 10)"""

BASE = with_(fx.PRINCIPALS, fx.DOCS, fx.SEARCHES, INDEX, VISIBLE, recursive=True).rstrip()


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, searches, held, _ = _inputs(spark, sf_dir, vectors=False)
    return retrieval.bm25(docs, searches, held)


BM25_SQL = BASE + "," + _bm25_sql(_SEEN) + " SELECT * FROM bm25"


_indexes: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The written index of the documents of a folder: built by the first query of a session that asks for it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        index = Index(spark, scratch(spark, "index"))
        index.update(fx.docs(spark, sf_dir, vectors=False), 0)
        _indexes[key] = index
    return _indexes[key]


_closures: dict[tuple[str, str], Closure] = {}


def closure_of(spark: SparkSession, sf_dir: str) -> Closure:
    """The kept expansions of a folder's graph: built by the first query of a session that asks for them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _closures:
        kept = Closure(spark, scratch(spark, "closure"), buckets=16)
        kept.apply(edges_of(spark, sf_dir), 0)
        _closures[key] = kept
    return _closures[key]


def _kept_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Searches, and what their users hold by the kept expansions."""
    searches = fx.searches(spark, sf_dir)
    return searches, cut(closure_of(spark, sf_dir).expansion(searches.select("user"), strict=False), "expansion")


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the written index, for users as the kept expansions have them: no text is read."""
    searches, held = _kept_inputs(spark, sf_dir)
    return index_of(spark, sf_dir).search(searches, held)


def bm25_index_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches, held = _kept_inputs(spark, sf_dir)
    return index_of(spark, sf_dir).search(searches, held, wanted={"datasource": ["en", "de"], "kind": ["issue", "pull_request"]})


def bm25_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over an index that has come to hold the documents in three batches: first every document with another one's title, then twice (as a batch that is tried again) the true rows of a third of them, then of all others."""
    docs, searches, held, _ = _inputs(spark, sf_dir, vectors=False)
    index = Index(spark, scratch(spark, "index"))
    old = docs.withColumn("title", F.concat(F.col("datasource"), F.lit(" "), F.col("title"))).withColumn("deleted", F.col("doc_id") % 5 == 0)
    index.update(old, 0)
    for batch, part in ((1, F.col("doc_id") % 3 == 0), (1, F.col("doc_id") % 3 == 0), (2, F.col("doc_id") % 3 != 0)):
        index.update(docs.filter(part), batch)
    return index.search(searches, held)


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only issues and pull requests of two of the sources."""
    docs, searches, held, _ = _inputs(spark, sf_dir, vectors=False)
    return retrieval.bm25(docs, searches, held, wanted={"datasource": ["en", "de"], "kind": ["issue", "pull_request"]})


BM25_FILTERED_SQL = BASE + "," + _bm25_sql(_SEEN + " JOIN docs f ON f.doc_id = c.doc_id AND f.datasource IN ('en', 'de') AND f.kind IN ('issue', 'pull_request')") + " SELECT * FROM bm25"


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, searches, held, _ = _inputs(spark, sf_dir)
    return retrieval.knn(docs, searches, held)


KNN_SQL = BASE + "," + _knn_sql(_SEEN) + " SELECT * FROM knn"


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, searches, held, _ = _inputs(spark, sf_dir)
    return retrieval.knn(docs, searches, held, wanted={"kind": ["message"]})


KNN_FILTERED_SQL = BASE + "," + _knn_sql(_SEEN + " JOIN docs f ON f.doc_id = c.doc_id AND f.kind = 'message'") + " SELECT * FROM knn"


_graphs: dict[tuple[str, str], VectorIndex] = {}


def graphs_of(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The written vector graphs of a folder's documents: built by the first query of a session that asks for them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _graphs:
        index = VectorIndex(spark, scratch(spark, "graphs"))
        index.update(fx.docs(spark, sf_dir), 0)
        _graphs[key] = index
    return _graphs[key]


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches, held = _kept_inputs(spark, sf_dir)
    return graphs_of(spark, sf_dir).search(searches, held)


def knn_graph_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over graphs that have come to hold the documents in three batches, first with other vectors; the second is tried twice."""
    docs, searches, held, _ = _inputs(spark, sf_dir)
    index = VectorIndex(spark, scratch(spark, "graphs"))
    index.update(docs.withColumn("embedding", F.reverse("embedding")).withColumn("deleted", F.col("doc_id") % 5 == 0), 0)
    for batch, part in ((1, F.col("doc_id") % 3 == 0), (1, F.col("doc_id") % 3 == 0), (2, F.col("doc_id") % 3 != 0)):
        index.update(docs.filter(part), batch)
    return index.search(searches, held)


def knn_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the exact hits, all and of one kind of document, how many there are, and whether walks alone (none scored one by one) find 95 % of them."""
    docs, searches, held, _ = _inputs(spark, sf_dir)
    out = None
    for name, wanted in (("all", None), ("message", {"kind": ["message"]})):
        exact = retrieval.knn(docs, searches, held, wanted=wanted).select("query_id", "doc_id")
        found = graphs_of(spark, sf_dir).search(searches, held, wanted=wanted, scan=False).select("query_id", "doc_id", F.lit(1).alias("found"))
        row = exact.join(found, ["query_id", "doc_id"], "left").agg(F.lit(name).alias("what"), F.count("*").alias("hits"), (F.count("found") >= 0.95 * F.count("*")).alias("enough"))
        out = row if out is None else out.unionByName(row)
    return out


KNN_RECALL_SQL = BASE + "," + _knn_sql(_SEEN) + "," + _knn_sql(_SEEN + " JOIN docs f ON f.doc_id = c.doc_id AND f.kind = 'message'", "few") + " SELECT 'all' AS what, count(*) AS hits, true AS enough FROM knn UNION ALL SELECT 'message', count(*), true FROM few"


def _hybrid(spark: SparkSession, sf_dir: str):
    """docs without vectors, searches, what the searching users hold, the graph, and the fused hits."""
    docs, searches, held, edges = _inputs(spark, sf_dir, vectors=False)
    lists = {"bm25": retrieval.bm25(docs, searches, held), "knn": retrieval.knn(fx.docs(spark, sf_dir), searches, held)}
    return docs, searches, held, edges, retrieval.fuse(lists)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hybrid(spark, sf_dir)[-1]
    ranks = F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return hits.select("query_id", "doc_id", "score", "rank", ranks.alias("ranks"))


_FUSED = BASE + "," + _bm25_sql(_SEEN) + "," + _knn_sql(_SEEN) + "," + RRF
HYBRID_SQL = _FUSED + " SELECT query_id, doc_id, score, rank, ranks FROM hybrid"


def hybrid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the written index, the written graphs and the kept expansions."""
    searches, held = _kept_inputs(spark, sf_dir)
    hits = retrieval.fuse({"bm25": index_of(spark, sf_dir).search(searches, held), "knn": graphs_of(spark, sf_dir).search(searches, held)})
    ranks = F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return hits.select("query_id", "doc_id", "score", "rank", ranks.alias("ranks"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits after the second check: the principal by which each is seen, and how fresh it was."""
    docs, searches, held, _, hits = _hybrid(spark, sf_dir)
    return retrieval.checked(hits, docs, searches, graph.held(held)).select("query_id", "doc_id", "rank", "status", "matched", "fresh_ms")


MATCHED_SQL = (
    _FUSED
    + """, ok AS (
  SELECT h.query_id, h.doc_id, h.rank, s.usr, d.allowed, d.mode, d.src_ts_ms, d.indexed_at_ms FROM hybrid h JOIN searches s USING (query_id) JOIN docs d ON d.doc_id = h.doc_id)
SELECT query_id, doc_id, rank, 'ok' AS status, (SELECT min_by(p, i) FROM (SELECT unnest(allowed) AS p, generate_subscripts(allowed, 1) AS i) JOIN held h ON h.usr = ok.usr AND h.principal = p) AS matched,
  CASE WHEN mode = 'live' AND src_ts_ms > 0 AND src_ts_ms <= indexed_at_ms THEN indexed_at_ms - src_ts_ms ELSE 0 END AS fresh_ms FROM ok"""
)


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, hits that the plain closure doesn't allow, and where the two closures differ: one row. Faults are planted, so that the checks have what to find: each search also shows the document with its own number, seen or not, and the expansion lacks principals three steps away."""
    docs, searches, held, edges, hits = _hybrid(spark, sf_dir)
    users = searches.select("user").distinct()
    planted = searches.select("query_id", "user", F.col("query_id").alias("doc_id")).join(docs.select("doc_id"), "doc_id", "left_semi")
    shown = cut(hits.join(searches.select("query_id", "user"), "query_id").select("query_id", "user", "doc_id").unionByName(planted), "hits")
    truth = cut(graph.truth(edges, users), "truth")
    bad = reports.leaks(shown, docs, truth).agg(F.count("*").alias("leaks"))
    off = reports.disagreements(held.filter("depth < 3"), truth).agg(F.count("*").alias("mismatches"))
    one = F.lit(1).alias("k")
    return shown.agg(F.count("*").alias("hits")).select("*", one).join(bad.select("*", one), "k").join(off.select("*", one), "k").drop("k")


LEAKS_SQL = (
    _FUSED
    + """, shown AS (
  SELECT s.usr, h.doc_id FROM hybrid h JOIN searches s USING (query_id) UNION ALL SELECT s.usr, d.doc_id FROM searches s JOIN docs d ON d.doc_id = s.query_id)
SELECT count(*) AS hits, count(*) FILTER (v.doc_id IS NULL) AS leaks, (SELECT count(*) FROM held WHERE depth >= 3 AND usr IN (SELECT usr FROM searches)) AS mismatches
FROM shown LEFT JOIN seen v ON v.usr = shown.usr AND v.doc_id = shown.doc_id"""
)


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each search's user sees, or doesn't, the documents that its words find best whoever asks."""
    docs, searches, held, _ = _inputs(spark, sf_dir, vectors=False)
    d = docs.withColumn("hidden", F.col("deleted") | F.col("quarantined")).withColumn("deleted", F.lit(False)).withColumn("quarantined", F.lit(False)).drop("hidden")
    pairs = retrieval.bm25(d, searches, None).join(searches.select("query_id", "user"), "query_id").select("user", "doc_id").distinct()
    return retrieval.explain(pairs, docs, held).select("user", "doc_id", "status", "matched", F.array_join("path", ">").alias("path"))


EXPLAIN_SQL = (
    with_(fx.PRINCIPALS, fx.DOCS.replace("docs AS (", "real AS (", 1), "docs AS (SELECT * REPLACE (false AS deleted, false AS quarantined) FROM real)", fx.SEARCHES, INDEX, recursive=True).rstrip()
    + ","
    + _bm25_sql(_LIVE)
    + """, pairs AS (SELECT DISTINCT s.usr, b.doc_id FROM bm25 b JOIN searches s USING (query_id)),
m AS (SELECT p.usr, p.doc_id, d.deleted, d.quarantined, (SELECT min_by(x, i) FROM (SELECT unnest(d.allowed) AS x, generate_subscripts(d.allowed, 1) AS i) JOIN held h ON h.usr = p.usr AND h.principal = x) AS matched FROM pairs p JOIN real d USING (doc_id))
SELECT m.usr AS "user", m.doc_id, CASE WHEN deleted THEN 'deleted' WHEN quarantined THEN 'quarantined' WHEN matched IS NULL THEN 'unheld' ELSE 'visible' END AS status, matched, array_to_string(h.path, '>') AS path
FROM m LEFT JOIN held h ON h.usr = m.usr AND h.principal = m.matched"""
)


def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, searches, held, _ = _inputs(spark, sf_dir)
    return retrieval.browse(docs, searches, held)


BROWSE_SQL = (
    with_(fx.PRINCIPALS, fx.DOCS, fx.SEARCHES, VISIBLE, recursive=True)
    + " SELECT query_id, doc_id, updated_ms, rank FROM (SELECT s.query_id, d.doc_id, d.updated_ms, row_number() OVER (PARTITION BY s.query_id ORDER BY d.updated_ms DESC NULLS LAST, d.doc_id) AS rank FROM searches s JOIN seen v ON v.usr = s.usr JOIN docs d ON d.doc_id = v.doc_id) WHERE rank <= 10"
)


def postings_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field: postings, terms, and the lengths that scores are held against."""
    docs = fx.docs(spark, sf_dir, vectors=False)
    p = retrieval.postings(docs).groupBy("field").agg(F.count("*").alias("postings"), F.sum("tf").alias("words"), F.countDistinct("term").alias("terms"))
    return p.join(retrieval.field_stats(docs).select("field", "n", F.round("avg_len", 6).alias("avg_len")), "field")


POSTINGS_SQL = with_(fx.DOCS, INDEX) + " SELECT p.field, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS words, count(DISTINCT term) AS terms, any_value(n) AS n, round(any_value(avg_len), 6) AS avg_len FROM postings p JOIN stats s ON s.field = p.field GROUP BY p.field"


def duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, datasource, title, class, n_rel, first): documents whose text also occurs under n_rel smaller ids, of which first is the least. Both ends must be of one source and not deleted. A class stands for its members, so copies are never paired."""
    d = fx.docs(spark, sf_dir, vectors=False).filter("not deleted").select("doc_id", "datasource", "title", F.sha2("body", 256).alias("h"))
    # Texts that occur once have no partner and stay out of the window.
    several = d.groupBy("h", "datasource").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").drop("n")
    place = F.row_number().over(Window.partitionBy("h", "datasource").orderBy("doc_id"))
    return d.join(several, ["h", "datasource"]).withColumn("n_rel", place - 1).filter("n_rel > 0").select("doc_id", "datasource", "title", F.col("h").alias("class"), "n_rel", "first")


LABELS = """
labels_ AS (
  SELECT a.doc_id, a.datasource, any_value(a.title) AS title, list(b.doc_id ORDER BY b.doc_id) AS relevant FROM docs a JOIN docs b ON a.body = b.body AND a.datasource = b.datasource AND b.doc_id < a.doc_id
  WHERE NOT a.deleted AND NOT b.deleted GROUP BY a.doc_id, a.datasource)"""


def duplicate_labels_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_labels(spark, sf_dir).select("doc_id", "datasource", "title", F.col("n_rel").cast("long").alias("n_rel"), "first")


LABELS_SQL = with_(fx.DOCS, LABELS) + " SELECT doc_id, datasource, title, len(relevant) AS n_rel, relevant[1] AS first FROM labels_"


def named_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from a field of the documents themselves: those that exist of what a document names as its duplicates, of the same source and not deleted. Every seventh document names the one with half its number and one that isn't there."""
    d = fx.docs(spark, sf_dir, vectors=False).filter("not deleted")
    named = F.when(F.col("doc_id") % 7 == 0, F.array(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 2).cast("string")), F.lit("d-1"))).otherwise(F.array().cast("array<string>"))
    return retrieval.named_duplicates(d.select("id", "datasource", named.alias("duplicates"))).select("id", "datasource", F.array_join("relevant", ",").alias("relevant"))


NAMED_SQL = (
    with_(fx.DOCS)
    + """SELECT a.id, a.datasource, b.id AS relevant FROM docs a JOIN docs b ON b.id = 'd' || (a.doc_id // 2) AND b.datasource = a.datasource AND b.id <> a.id
WHERE a.doc_id % 7 = 0 AND NOT a.deleted AND NOT b.deleted"""
)


def _eval(spark: SparkSession, sf_dir: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """most: how many of the labels are asked, picked by the seed; all, if None."""
    docs, texts = fx.docs(spark, sf_dir), fx.docs(spark, sf_dir, vectors=False)
    labels = duplicate_labels(spark, sf_dir)
    if most is not None:
        labels = labels.orderBy(seeded(seed, "doc_id"), "doc_id").limit(most)
    labels = cut(labels, "labels")
    v = docs.select("doc_id", F.col("embedding").alias("vector"))
    searches = cut(labels.join(v, "doc_id").select(F.col("doc_id").alias("query_id"), F.lit("u:eval").alias("user"), F.array_join(tokens(F.col("title")), " ").alias("query"), "vector", "class", "datasource"), "searches")
    # The documents that can be relevant: copies aren't listed by query.
    of = texts.filter("not deleted").select("doc_id", "datasource", "title", "quarantined", F.sha2("body", 256).alias("class"))
    of = cut(of.join(labels.select("class", "datasource").distinct(), ["class", "datasource"], "left_semi"), "classes")
    # Copies have one title, and may have one vector: what it finds is found once.
    same, points = cut(searches.groupBy("query").agg(F.min("query_id").alias("asked")), "asked"), cut(searches.filter("vector is not null").groupBy("vector").agg(F.min("query_id").alias("point")), "points")
    searches = cut(searches.join(same, "query").join(points, "vector", "left").select("query_id", "asked", "point", "class", "datasource"), "searches")
    closest = cut(retrieval.knn(docs, points.select(F.col("point").alias("query_id"), F.lit("u:eval").alias("user"), "vector"), None).withColumnRenamed("query_id", "point"), "points")
    # A title needs what comes before the last document that is relevant to it, as nothing after that changes a metric; copies with one title score the same. Fusion also needs the places of what vectors find.
    titles = searches.select("asked", "class", "datasource").distinct()
    near = titles.join(of.filter("not quarantined"), ["class", "datasource"]).groupBy("asked", "class", "datasource", "title").agg(F.min("doc_id").alias("doc_id"))
    rivals = searches.filter("point is not null").select("asked", "point").distinct().join(closest, "point")
    pairs = lambda df: df.select(F.col("asked").alias("query_id"), "doc_id")
    words = retrieval.bm25(texts, same.select(F.col("asked").alias("query_id"), F.lit("u:eval").alias("user"), "query"), None, near=pairs(near), rivals=pairs(rivals)).withColumnRenamed("query_id", "asked")
    words = words.join(searches.select("query_id", "asked"), "asked").select("query_id", "doc_id", "score", "rank")
    near_by = closest.join(searches.select("query_id", "point"), "point").select("query_id", "doc_id", "score", "rank")
    bm, kn = cut(words, "bm25"), cut(near_by, "knn")
    single = lambda df, mode: df.filter("rank <= 11").select(F.lit(mode).alias("mode"), "query_id", "doc_id", "rank")
    hits = cut(single(bm, "bm25").unionByName(single(kn, "knn")).unionByName(single(retrieval.fuse({"bm25": bm, "knn": kn}, 11), "hybrid")), "hits")
    # A hit is relevant if it is of the query's class and has a smaller id.
    asked = labels.select(F.col("doc_id").alias("query_id"), F.col("datasource").alias("q_datasource"), F.col("class").alias("q_class"))
    good = (F.col("class") == F.col("q_class")) & (F.col("datasource") == F.col("q_datasource")) & (F.col("doc_id") < F.col("query_id"))
    judged = hits.join(of.select("doc_id", "datasource", "class"), "doc_id", "left").join(asked, "query_id").select("mode", "query_id", "doc_id", "rank", F.coalesce(good, F.lit(False)).alias("good"))
    return reports.relevance(cut(reports.outcomes(judged, labels.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("own"), "datasource", "n_rel")), "outcomes"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval(spark, sf_dir)


_EVAL = (
    with_(fx.DOCS, LABELS, INDEX).rstrip()
    + r""",
asked AS (SELECT l.doc_id AS query_id, 'u:eval' AS usr, regexp_extract_all(lower(l.title), '[\p{L}\p{N}]+') AS words, d.embedding AS vector FROM labels_ l JOIN docs d USING (doc_id)),"""
    + _bm25_sql(_LIVE, own="asked")
    + ","
    + _knn_sql(_LIVE, own="asked")
    + ","
    + RRF.replace("rank <= 10", "rank <= 11")
    + """,
hits AS (SELECT 'bm25' AS mode, query_id, doc_id, rank FROM bm25 WHERE rank <= 11 UNION ALL SELECT 'knn', query_id, doc_id, rank FROM knn WHERE rank <= 11 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hybrid),
placed AS (SELECT mode, query_id, doc_id, row_number() OVER (PARTITION BY mode, query_id ORDER BY rank) AS r FROM hits WHERE doc_id <> query_id),
good AS (SELECT p.mode, p.query_id, list(p.r ORDER BY p.r) AS ranks FROM placed p JOIN labels_ l ON l.doc_id = p.query_id AND list_contains(l.relevant, p.doc_id) WHERE p.r <= 10 GROUP BY p.mode, p.query_id),
each AS (
  SELECT m.mode, l.datasource, len(l.relevant) AS rel, coalesce(g.ranks, []) AS ranks FROM labels_ l CROSS JOIN (SELECT DISTINCT mode FROM hits) m LEFT JOIN good g ON g.mode = m.mode AND g.query_id = l.doc_id),
metrics AS (
  SELECT mode, datasource, count(*) AS n, round(avg(CASE WHEN list_contains(ranks, 1) THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1,
    round(avg(len(list_filter(ranks, lambda r: r <= 5)) / rel), 6) AS recall_at_5, round(avg(len(ranks) / rel), 6) AS recall_at_10, round(avg(coalesce(1 / list_min(ranks), 0)), 6) AS mrr_at_10,
    round(avg(coalesce(list_sum(list_transform(list_filter(ranks, lambda r: r <= 5), lambda r: 1 / log2(r + 1))), 0) / list_sum(list_transform(range(1, least(rel, 5) + 1), lambda r: 1 / log2(r + 1)))), 6) AS ndcg_at_5
  FROM each GROUP BY GROUPING SETS ((mode), (mode, datasource)))"""
)
EVAL_SQL = _EVAL + " SELECT * FROM metrics"
#: Labels that a sampled evaluation asks.
SAMPLED = 50


def eval_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a seeded sample of the labels."""
    return _eval(spark, sf_dir, SAMPLED)


SAMPLED_SQL = _EVAL.replace("labels_ AS (", "every_label AS (", 1).replace("GROUP BY a.doc_id, a.datasource)", f"GROUP BY a.doc_id, a.datasource),\nlabels_ AS (SELECT * FROM every_label ORDER BY md5('42|' || doc_id), doc_id LIMIT {SAMPLED})", 1) + " SELECT * FROM metrics"


def eval_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many per cent fusion is above words alone."""
    m = cut(_eval(spark, sf_dir), "metrics").filter("datasource is null")
    a = m.filter("mode = 'bm25'").select(F.lit(1).alias("k"), *[F.col(c).alias(f"b_{c}") for c in ("mrr_at_10", "ndcg_at_5", "recall_at_10")])
    j = m.filter("mode = 'hybrid'").withColumn("k", F.lit(1)).join(a, "k")
    return j.select(*[reports.lift(F.col(f"b_{c}"), F.col(c)).alias(c) for c in ("mrr_at_10", "ndcg_at_5", "recall_at_10")])


def _lift(c: str) -> str:
    return f"CASE WHEN b.{c} = 0 THEN 0.0 ELSE round((h.{c} - b.{c}) / b.{c} * 100, 1) END AS {c}"


LIFT_SQL = _EVAL + f" SELECT {_lift('mrr_at_10')}, {_lift('ndcg_at_5')}, {_lift('recall_at_10')} FROM metrics h, metrics b WHERE h.mode = 'hybrid' AND b.mode = 'bm25' AND h.datasource IS NULL AND b.datasource IS NULL"


#: When the rounds of the trials run.
ROUNDS = [500, 1100, 1900]


def revoke_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document lies in a container of its own, which a group (of every third trial one beyond it) is granted; a user joins the group, searches the document's first words, and loses the membership or the grant again, some too late for the last round, some never."""
    i, own = F.expr("doc_id div 20"), F.col("doc_id") % 20 == 0
    name = lambda kind: F.concat(F.lit(kind), i.cast("string"))
    docs = fx.docs(spark, sf_dir, vectors=False).withColumn("allowed", F.when(own, F.array(name("c:canary"))).otherwise(F.col("allowed")))
    asked = cut(docs.filter(own).select(
        i.alias("trial"), name("u:trial").alias("user"), "doc_id", first_tokens(F.col("body"), 8).alias("query"), name("g:trial").alias("team"), F.when(i % 3 == 0, name("g:wide")).alias("wide"), name("c:canary").alias("container"),
        ((F.col("doc_id") * 7919) % 1000).alias("granted_ms"), F.when(i % 7 != 0, 1000 + (F.col("doc_id") * 31) % 1200).alias("revoked_ms"),
    ), "trials")
    edge = lambda src, dst, at, present: F.struct(src.alias("src"), dst.alias("dst"), F.lit(present).alias("present"), F.col(at).alias("sent_ms"))
    user, team, wide, container = (F.col(c) for c in ("user", "team", "wide", "container"))
    last = F.coalesce(wide, team)
    sent = F.array(edge(user, team, "granted_ms", True), edge(team, last, "granted_ms", True), edge(last, container, "granted_ms", True), edge(F.when(F.col("trial") % 2 == 0, user).otherwise(last), F.when(F.col("trial") % 2 == 0, team).otherwise(container), "revoked_ms", False))
    changes = asked.select(F.inline(sent)).filter("sent_ms is not null and src <> dst")
    index = Index(spark, scratch(spark, "index"))
    index.update(docs, 0)
    return trials.latencies(asked, trials.probe(docs, asked, changes, Closure(spark, scratch(spark, "closure"), buckets=4), ROUNDS, index=index))


REVOKE_TRIALS_SQL = (
    with_(fx.DOCS).rstrip()
    + rf""",
t AS (SELECT doc_id // 20 AS trial, (doc_id * 7919) % 1000 AS g, CASE WHEN (doc_id // 20) % 7 <> 0 THEN 1000 + (doc_id * 31) % 1200 END AS r,
  NOT deleted AND NOT quarantined AND len(regexp_extract_all(lower(coalesce(body, '')), '[\p{{L}}\p{{N}}]+')) > 0 AS there FROM docs WHERE doc_id % 20 = 0),
p AS (SELECT trial, g, r, tick, there AND tick >= g AND (r IS NULL OR tick < r) AS seen FROM (SELECT *, unnest({ROUNDS}) AS tick FROM t))
SELECT trial, min(tick) FILTER (seen) - g AS grant_ms, CASE WHEN bool_or(seen) THEN min(tick) FILTER (tick >= r) - r END AS revoke_ms, bool_or(seen) AND coalesce(r > {ROUNDS[-1]}, false) AS timed_out, 0 AS leaks FROM p GROUP BY trial, g, r"""
)


def hit_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of each search's ten best documents. Held against all passages in tests."""
    docs, searches, _, _ = _inputs(spark, sf_dir)
    hits = index_of(spark, sf_dir).search(searches, None, 10)
    j = hits.join(searches.select("query_id", "query"), "query_id").join(docs.select("doc_id", "body"), "doc_id")
    return j.select("query_id", "doc_id", passages()(F.col("body"), tokens(F.col("query"))).alias("passage"))


def standard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words and different words Unicode boundaries give each document. Held against the plain rules in tests."""
    words = fx.docs(spark, sf_dir, vectors=False).select("doc_id", standard(F.col("body")).alias("w"))
    return words.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct"))


def hybrid_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words alone over the state that the changelog folds to, whoever asks: the write path and the read path in one plan."""
    state = fold.fold(fx.doc_events(spark, sf_dir))
    docs = cut(state.withColumn("doc_id", F.substring("id", 5, 20).cast("long")), "state")
    searches = docs.select(F.col("title")).filter("title <> ''").distinct().select(F.xxhash64("title").alias("query_id"), F.lit("u:eval").alias("user"), F.col("title").alias("query"))
    hits = retrieval.bm25(docs, searches, None, k=3)
    return hits.join(searches.select("query_id", "query"), "query_id").select("query", "doc_id", "score", "rank")


STATE_SEARCH_SQL = (
    "WITH state AS (" + STATE_SQL + r"""), docs AS (SELECT CAST(substr(id, 5) AS BIGINT) AS doc_id, title, body, deleted, quarantined FROM state),
asked AS (SELECT title AS query_id, 'u:eval' AS usr, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS words FROM (SELECT DISTINCT title FROM docs WHERE title <> '')),"""
    + INDEX
    + ","
    + _bm25_sql(_LIVE, own="asked")
    + " SELECT query_id AS query, doc_id, score, rank FROM bm25 WHERE rank <= 3"
)

QUERIES = {
    "q_hybrid_rrf": hybrid, "q_bm25": bm25, "q_bm25_filtered": bm25_filtered, "q_bm25_index": bm25_index, "q_bm25_index_filtered": bm25_index_filtered, "q_bm25_updated": bm25_updated, "q_hybrid_index": hybrid_index, "q_knn": knn, "q_knn_filtered": knn_filtered, "q_knn_graph": knn_graph, "q_knn_graph_updated": knn_graph_updated, "q_knn_graph_recall": knn_graph_recall, "q_matched": matched, "q_leaks": leaks, "q_explain": explained, "q_browse": browse,
    "q_postings": postings_totals, "q_duplicate_labels": duplicate_labels_out, "q_named_duplicates": named_duplicates, "q_eval_metrics": eval_metrics, "q_eval_lift": eval_lift, "q_eval_sampled": eval_sampled, "q_passages": hit_passages, "q_standard_words": standard_words, "q_state_search": hybrid_of_state, "q_revoke_trials": revoke_trials,
}
ORACLE_SQL = {
    "q_hybrid_rrf": HYBRID_SQL, "q_bm25": BM25_SQL, "q_bm25_filtered": BM25_FILTERED_SQL, "q_bm25_index": BM25_SQL, "q_bm25_index_filtered": BM25_FILTERED_SQL, "q_bm25_updated": BM25_SQL, "q_hybrid_index": HYBRID_SQL, "q_knn": KNN_SQL, "q_knn_filtered": KNN_FILTERED_SQL, "q_knn_graph": KNN_SQL, "q_knn_graph_updated": KNN_SQL, "q_knn_graph_recall": KNN_RECALL_SQL, "q_matched": MATCHED_SQL, "q_leaks": LEAKS_SQL, "q_explain": EXPLAIN_SQL, "q_browse": BROWSE_SQL,
    "q_postings": POSTINGS_SQL, "q_duplicate_labels": LABELS_SQL, "q_named_duplicates": NAMED_SQL, "q_eval_metrics": EVAL_SQL, "q_eval_lift": LIFT_SQL, "q_eval_sampled": SAMPLED_SQL, "q_state_search": STATE_SEARCH_SQL, "q_revoke_trials": REVOKE_TRIALS_SQL,
}
