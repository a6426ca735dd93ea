"""The written index: postings in blocks with each block's greatest weight, and a scan that leaves out blocks which can't hold one of the best.

Documents fall into segments of some thousands by the hash of their id, so that what a task holds of one is bounded whatever their number. A row of the index is a block: at most BLOCK postings of a term and field in a segment, by doc_id, with those pairs of count and length that give the block's greatest weight whatever the mean length is by then. What permissions and filters need of the documents is in one more row of each segment. Rows lie in folders by hash of the term, sorted by it, so a search reads the blocks of its own terms and nothing else, above all no text.

update() adds a batch of changed documents under its number and says which older entries they replace; a batch done again changes nothing. Totals of lengths are kept by batch. compact() writes the same index without replaced entries.

A search's blocks meet by segment, in a task of their own. There the borders of its blocks cut the documents into stretches; the sum of the blocks' greatest weights bounds the scores in each (interval-wise block-max pruning). Stretches are scored by falling bound until the bound is below the k-th score of documents that the user may see.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import tokens
from ..session import batches_of, cut
from .retrieval import B, BOOSTS, DEPTH, K1, QUERIES, SLACK, TIE, _holders, _may_see, _passes, best, of_kinds, seen_counts

MARKS = "struct<allowed:array<string>,datasource:string,container:string,kind:string,hidden:boolean>"
#: Terms that are named in the filter of a scan; more are joined.
NAMED = 1000
#: Segments whose blocks of a bucket one task writes.
TOGETHER = 64
#: Documents whose words a task that builds segments is sent at once, besides those of the segment that it builds.
DOCS = 256
#: Users who may see so many documents at the most have just these scored.
NARROW = 1000
#: Searches from which on it is asked who may see few: they are those of more than one pass.
MANY = QUERIES // 2


def _schema(doc: str) -> str:
    return f"segment long, field int, term string, docs array<{doc}>, tf array<int>, len array<int>, mark array<int>, marks array<{MARKS}>, best_tf array<int>, best_len array<int>"


def _lists(values: pa.Array, starts: np.ndarray, end: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, end).astype(np.int32)), values)


def _frontier(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the postings that no other of their block beats in both count and length, by block."""
    order = np.lexsort((length, -tf, block))
    # A later block's numbers lie below all before, so the running least starts anew.
    v = length[order] - block[order] * (int(length.max(initial=0)) + 1)
    least = np.minimum.accumulate(v)
    return order[np.r_[True, v[1:] < least[:-1]]] if len(v) else order


def _blocks(segment: int, rows: pa.Table, size: int):
    """The batches of a segment's rows, and first its documents with their lengths and marks: field -1."""
    docs, n = rows.column("doc_id").combine_chunks(), rows.num_rows
    lists = [rows.column(f).combine_chunks() for f in BOOSTS]
    lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in lists]
    seen: dict = {}
    marks = rows.column("marks").combine_chunks()
    mark = np.array([seen.setdefault(repr(m), len(seen)) for m in marks.to_pylist()], np.int64)
    distinct = marks.take(pa.array(np.unique(mark, return_index=True)[1]))
    names = ["segment", "field", "term", "docs", "tf", "len", "mark", "marks", "best_tf", "best_len"]
    none, ints = pa.array([None]), lambda x: pa.array(x.astype(np.int32))
    one = lambda x: _lists(x, np.zeros(1, np.int64), len(x))
    empty = one(ints(np.zeros(0)))
    yield pa.RecordBatch.from_arrays([pa.array([segment]), ints(np.array([-1])), none.cast(pa.string()), one(docs), one(ints(lengths[0])), one(ints(lengths[1])), one(ints(mark)), one(distinct), empty, empty], names)
    for field, (words, length) in enumerate(zip(lists, lengths, strict=True)):
        coded = words.flatten().dictionary_encode()
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
        if not len(key):
            continue
        term, doc = key // n, key % n
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        start = np.flatnonzero(place % size == 0)
        for lo in range(0, len(start), 8192):
            own = start[lo : lo + 8192]
            a, b = int(own[0]), int(start[lo + 8192]) if lo + 8192 < len(start) else len(key)
            d, block = doc[a:b], np.searchsorted(own, np.arange(a, b), "right") - 1
            top = _frontier(block, tf[a:b], length[d])
            tops = np.searchsorted(block[top], np.arange(len(own)))
            columns = [pa.array(np.full(len(own), segment)), ints(np.full(len(own), field)), coded.dictionary.take(pa.array(term[own])), _lists(docs.take(pa.array(d)), own - a, b - a), _lists(ints(tf[a:b]), own - a, b - a), _lists(ints(length[d]), own - a, b - a)]
            no = np.zeros(len(own))
            columns += [_lists(ints(no[:0]), no, 0), _lists(distinct.slice(0, 0), no, 0), _lists(ints(tf[a:b][top]), tops, len(top)), _lists(ints(length[d][top]), tops, len(top))]
            yield pa.RecordBatch.from_arrays(columns, names)


def _build(size: int):
    def run(batches):
        now, parts = None, []
        for batch in batches:
            segments = batch.column("segment").to_numpy()
            cuts = [0, *(np.flatnonzero(segments[1:] != segments[:-1]) + 1).tolist(), len(segments)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if now is not None and segments[a] != now:
                    yield from _blocks(now, pa.Table.from_batches(parts), size)
                    parts = []
                now = int(segments[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from _blocks(now, pa.Table.from_batches(parts), size)

    return run


def marks_of(df: DataFrame) -> Column:
    """What permissions and filters need of a document; columns that df lacks are null."""
    has = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    return F.struct(has("allowed", "array<string>"), has("datasource", "string"), has("container", "string"), has("kind", "string"), F.coalesce("quarantined", F.lit(False)).alias("hidden"))


def visible_marks(marks: pa.StructArray, holders, n_users: int, wanted: dict[str, list[str]]) -> np.ndarray:
    """Whether each user may see documents with each of marks, and these are wanted."""
    see = np.ones((len(marks), n_users), bool) if holders is None else _may_see(pc.fill_null(marks.field("allowed"), []), holders, n_users)
    ok = ~pc.fill_null(marks.field("hidden"), False).to_numpy(zero_copy_only=False)
    for c, values in wanted.items():
        ok &= pc.fill_null(pc.is_in(marks.field(c), pa.array(values, pa.string())), False).to_numpy(zero_copy_only=False)
    see[~ok] = False
    return see


class Written:
    """Folders by batch below one that all executors reach. Whatever else a batch writes, replaced entries come next and totals last; only batches with totals are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[int]:
        """The numbers of whole batches."""
        fs, path = self._fs()
        top = path(f"{self.path}/totals")
        names = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(path(f"{p.toString()}/_SUCCESS")))

    def _number(self, batch: int | None) -> int:
        done = self.batches()
        number = max(done, default=-1) + 1 if batch is None else batch
        if any(b > number for b in done):
            raise ValueError(f"batch {number} comes before {max(done)}")
        return number

    def _read(self, kind: str, schema: str, before: int | None = None) -> DataFrame | None:
        found = [f"{self.path}/{kind}/{b}" for b in self.batches() if before is None or b < before]
        # Each batch has its own folder; the folders of a kind differ in nothing else.
        parts = [self.spark.read.schema(schema).option("basePath", p).parquet(p) for p in found]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _doc(self) -> str:
        return self.spark.read.parquet(f"{self.path}/replaced/{self.batches()[0]}").schema["doc_id"].dataType.simpleString()

    def _replace(self, changed: DataFrame, number: int, columns: list[str], schema: str) -> None:
        """Writes which entries of earlier batches changed replaces."""
        old = self.spark.createDataFrame([], schema)
        if any(b < number for b in self.batches()):
            old = self.entries(number).join(changed.select("doc_id").distinct(), "doc_id", "left_semi").join(self.replaced(number).select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")
        old.select(*columns).write.mode("overwrite").parquet(f"{self.path}/replaced/{number}")

    def _finish(self, totals: DataFrame, number: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/{number}")


class Index(Written):
    """Blocks of postings. analyse: the analysis of texts and searches alike."""

    def __init__(self, spark: SparkSession, path: str, analyse=tokens, block: int = 128, segment: int = 4096, buckets: int = 32):
        super().__init__(spark, path)
        self.analyse, self.block, self.segment, self.buckets = analyse, block, segment, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def entries(self, before: int | None = None) -> DataFrame | None:
        """(segment, doc_id, title, body): the documents that segments hold, with their lengths; replaced ones too."""
        blocks = self._read("blocks", _schema(self._doc()) + ", bucket int", before) if self.batches() else None
        if blocks is None:
            return None
        rows = blocks.filter((F.col("bucket") == self.buckets) & (F.col("field") == -1)).select("segment", F.explode(F.arrays_zip("docs", "tf", "len")).alias("x"))
        return rows.select("segment", F.col("x.docs").alias("doc_id"), F.col("x.tf").alias("title"), F.col("x.len").alias("body"))

    def replaced(self, before: int | None = None) -> DataFrame | None:
        """(segment, doc_id, title, body) of entries that later batches replace."""
        return self._read("replaced", f"segment long, doc_id {self._doc()}, title int, body int", before) if self.batches() else None

    def update(self, changed: DataFrame, batch: int | None = None) -> None:
        """Adds the newest rows of changed documents (doc_id or id, title, body, deleted, quarantined, and allowed, datasource, container and kind where they are there), one for each document. batch: its number, by default the next; the highest may be done again."""
        changed = changed if "doc_id" in changed.columns else changed.withColumnRenamed("id", "doc_id")
        number = self._number(batch)
        doc = changed.schema["doc_id"].dataType.simpleString()
        n = changed.filter("not deleted").count()
        segments = max(1, -(-n // self.segment), min(self.spark.sparkContext.defaultParallelism, n // 512))
        number_of = F.lit(number << 32) + F.pmod(F.xxhash64("doc_id"), F.lit(segments))
        # Texts move and are sorted, which are smaller than their words.
        rows = changed.filter("not deleted").select(number_of.alias("segment"), "doc_id", *BOOSTS, marks_of(changed).alias("marks"))
        rows = rows.repartition(segments, "segment").sortWithinPartitions("segment", "doc_id").select("segment", "doc_id", *[self.analyse(F.col(f)).alias(f) for f in BOOSTS], "marks")
        blocks = rows.mapInArrow(_build(self.block), _schema(doc))
        blocks = blocks.withColumn("bucket", F.when(F.col("field") < 0, F.lit(self.buckets)).otherwise(self._bucket(F.col("term"))))
        # A task has a bucket's blocks of some tens of segments.
        spread = blocks.withColumn("part", F.floor(F.pmod("segment", F.lit(1 << 32)) / TOGETHER)).repartition("bucket", "part").drop("part")
        with batches_of(self.spark, DOCS):
            spread.sortWithinPartitions("bucket", "term", "field", "segment").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/blocks/{number}")
        self._replace(changed, number, ["segment", "doc_id", "title", "body"], f"segment long, doc_id {doc}, title int, body int")
        new = self.spark.read.schema(_schema(doc) + ", bucket int").parquet(f"{self.path}/blocks/{number}").filter((F.col("bucket") == self.buckets) & (F.col("field") == -1))
        lens = [new.select(F.lit(1).alias("sign"), F.explode(F.arrays_zip(F.col("tf").alias("title"), F.col("len").alias("body"))).alias("x")).select("sign", "x.title", "x.body")]
        lens.append(self.spark.read.parquet(f"{self.path}/replaced/{number}").select(F.lit(-1).alias("sign"), "title", "body"))
        fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).alias("len")) for i, f in enumerate(BOOSTS)])).alias("x")
        totals = lens[0].unionByName(lens[1]).select("sign", fields).filter("x.len > 0").groupBy("x.field").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("x.len")).alias("total"))
        self._finish(totals, number)

    def stats(self) -> dict[int, tuple[int, float]]:
        """Of each field how many documents have it, and its mean length: from two rows a batch."""
        totals = self._read("totals", "field int, n long, total long")
        rows = [] if totals is None else totals.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        return {r.field: (r.n, r.total / r.n) for r in rows if r.n > 0}

    def compact(self, docs: DataFrame, path: str) -> Index:
        """The same index in a new folder, of the newest rows of all documents, without replaced entries."""
        out = Index(self.spark, path, self.analyse, self.block, self.segment, self.buckets)
        out.update(docs)
        return out

    def _asked(self, words: list[str]) -> DataFrame:
        """The blocks of words: of their buckets alone."""
        named = self.spark.createDataFrame([(w,) for w in words], "term string")
        buckets = [r.b for r in named.select(self._bucket(F.col("term")).alias("b")).distinct().collect()]
        found = self._read("blocks", _schema(self._doc()) + ", bucket int").filter(F.col("bucket").isin(buckets))
        return found.filter(F.col("term").isin(words)) if len(words) <= NAMED else found.join(F.broadcast(named), "term", "left_semi")

    def frequencies(self, asked: DataFrame) -> dict[tuple[int, str], int]:
        """How many documents hold each of the asked blocks' terms in each field."""
        return {(r.field, r.term): r.n for r in self._frequencies(asked).collect()}  # as many as there are asked terms, in each field

    def _frequencies(self, asked: DataFrame) -> DataFrame:
        """(field, term, n)"""
        n = asked.groupBy("field", "term").agg(F.sum(F.size("docs")).alias("n"))
        gone = self.replaced()
        if not gone.isEmpty():
            # Only blocks of segments that have replaced entries are opened.
            old = asked.join(gone.select("segment").distinct(), "segment", "left_semi").select("segment", "field", "term", F.explode("docs").alias("doc_id"))
            old = old.join(gone.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_semi").groupBy("field", "term").agg((-F.count("*")).alias("n"))
            n = n.unionByName(old).groupBy("field", "term").agg(F.sum("n").alias("n"))
        return n

    def _heads(self) -> DataFrame:
        """A row for each segment: its documents, with what permissions and filters need."""
        return self._read("blocks", _schema(self._doc()) + ", bucket int").filter((F.col("bucket") == self.buckets) & (F.col("field") == -1))

    def seen(self, wanted: dict[str, list[str]] | None = None) -> DataFrame:
        """(doc_id, allowed, segment) of the documents that may be found, without replaced entries: from a row for each segment."""
        rows = self._heads().select("segment", "marks", F.explode(F.arrays_zip("docs", "mark")).alias("x")).select("segment", F.col("x.docs").alias("doc_id"), F.get("marks", F.col("x.mark")).alias("m"))
        rows = of_kinds(rows.select("segment", "doc_id", "m.*").filter("not hidden"), wanted).select("doc_id", "allowed", "segment")
        return rows.join(self.replaced().select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")

    def _narrow(self, terms: DataFrame, users: DataFrame, held: DataFrame, wanted: dict[str, list[str]] | None, stats: dict[int, tuple[int, float]]) -> DataFrame:
        """scan() for users (user) who may see few documents: these meet the postings of their searches' terms, and nothing else is moved."""
        doc = self._doc()
        mine = held.select("user", "principal").join(users, "user", "left_semi")
        pairs = self.seen(wanted).select("segment", "doc_id", F.explode("allowed").alias("principal")).join(mine, "principal").select("segment", "doc_id", "user").distinct()
        pairs = cut(pairs.join(terms.select("query_id", "user").distinct(), "user").select("segment", "doc_id", "query_id"), "pairs")
        words = terms.join(users, "user", "left_semi").select("term").distinct()
        blocks = self._read("blocks", _schema(doc) + ", bucket int").filter("field >= 0").join(words, "term", "left_semi")
        freq = self._frequencies(blocks.select("segment", "field", "term", "docs"))
        entries = blocks.select("segment", "field", "term", F.explode(F.arrays_zip("docs", "tf", "len")).alias("x")).select("segment", F.col("x.docs").alias("doc_id"), "field", "term", F.col("x.tf").alias("tf"), F.col("x.len").alias("len"))
        entries = entries.join(pairs.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_semi")
        n, mean, boost = (F.element_at(F.array(*[F.lit(v) for v in x]), F.col("field") + 1) for x in ([float(stats.get(f, (0, 1.0))[0]) for f in range(len(BOOSTS))], [stats.get(f, (0, 1.0))[1] for f in range(len(BOOSTS))], list(BOOSTS.values())))
        weight = boost * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
        j = pairs.join(entries, ["segment", "doc_id"]).join(terms.select("query_id", "term", "qtf"), ["query_id", "term"]).join(freq.withColumnRenamed("n", "df"), ["field", "term"])
        fields = j.groupBy("query_id", "doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("field") == i, F.col("qtf") * weight)), F.lit(0.0)).alias(f) for i, f in enumerate(BOOSTS)])
        score = F.round(F.greatest(*BOOSTS) + TIE * F.least(*BOOSTS), 6)
        none = F.lit(0).cast("long")
        return fields.select("query_id", "doc_id", score.alias("score"), none.alias("blocks"), none.alias("skipped"))

    def scan(self, searches: DataFrame, held: DataFrame | None, k: int = DEPTH, wanted: dict[str, list[str]] | None = None) -> DataFrame:
        """(query_id, doc_id, score, blocks, skipped): of each segment the best k of each search; a row without doc_id says of how many blocks how many were left out. wanted: values of datasource, container or kind. Users who may see at most NARROW documents have these scored instead, if there are more searches than one pass takes: a row for each that has a term."""
        terms = cut(searches.select("query_id", "user", F.explode(self.analyse(F.col("query"))).alias("term")).groupBy("query_id", "user", "term").agg(F.count("*").alias("qtf")), "terms")
        doc = self._doc()
        kinds = f"query_id long, doc_id {doc}, score double, blocks long, skipped long"
        stats, gone, out = self.stats(), self.replaced(), None
        if held is not None and terms.select("query_id").distinct().count() > MANY:
            mine = held.select("user", "principal").join(terms.select("user").distinct(), "user", "left_semi")
            few = cut(mine.select("user").distinct().join(seen_counts(self.seen(), mine).filter(F.col("n") > NARROW), "user", "left_anti"), "narrow")
            out = self._narrow(terms, few, held, wanted, stats)
            terms = cut(terms.join(few, "user", "left_anti").join(mine.select("user").distinct(), "user", "left_semi"), "terms")
            if terms.isEmpty():
                return out
        for mine, pairs in _passes(terms, held):
            queries = mine.orderBy("query_id", "term").collect()
            words = sorted({r.term for r in queries})
            asked = self._asked(words)
            df = self.frequencies(asked)
            asked = asked.unionByName(self._heads())
            walk = _walk(self.spark, queries, words, df, stats, pairs, k, wanted or {})
            if gone.isEmpty():
                part = asked.groupBy("segment").applyInArrow(_alone(walk), kinds)
            else:
                part = asked.groupBy("segment").cogroup(gone.groupBy("segment")).applyInArrow(walk, kinds)
            out = part if out is None else out.unionByName(part)
        return out

    def search(self, searches: DataFrame, held: DataFrame | None, k: int = DEPTH, wanted: dict[str, list[str]] | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank), as retrieval.bm25 gives them."""
        if not self.batches():
            raise ValueError(f"there is no index at {self.path}")
        return best(self.scan(searches, held, k, wanted).filter("doc_id is not null").drop("blocks", "skipped"), k).select("query_id", "doc_id", "score", "rank")


def _walk(spark, queries, words: list[str], df: dict[tuple[int, str], int], stats: dict[int, tuple[int, float]], pairs, k: int, wanted: dict[str, list[str]]):
    users = {u: i for i, u in enumerate(sorted({r.user for r in queries}))}
    place = {w: i for i, w in enumerate(words)}
    weight = np.zeros((len(BOOSTS), len(words)))
    for f, boost in enumerate(BOOSTS.values()):
        for w, i in place.items():
            if (f, w) in df and f in stats:
                weight[f, i] = boost * math.log(1 + (stats[f][0] - df[f, w] + 0.5) / (df[f, w] + 0.5))
    asks: dict[int, tuple[int, list[int], list[float]]] = {}
    for r in queries:
        own = asks.setdefault(r.query_id, (users[r.user], [], []))
        own[1].append(place[r.term])
        own[2].append(float(r.qtf))
    mean = np.array([stats.get(f, (0, 1.0))[1] for f in range(len(BOOSTS))])
    shared = spark.sparkContext.broadcast((place, weight, asks, mean, _holders(users, pairs), len(users)))

    def run(table: pa.Table, gone: pa.Table | None) -> pa.Table:
        place, weight, asks, mean, holders, n_users = shared.value
        kind = table.schema.field("docs").type.value_type
        out: list[list] = [[], [], [], [], []]
        head = table.filter(pc.equal(table.column("field"), -1))
        table = table.filter(pc.greater_equal(table.column("field"), 0))
        if table.num_rows:
            s = _Segment(table, head, gone, place, mean, holders, n_users, wanted)
            for query, (user, own, often) in asks.items():
                ids, scores, blocks, skipped = s.best(np.array(own), np.array(often), weight, user, k)
                if blocks:
                    out[0].append(np.full(len(ids) + 1, query))
                    out[1].append(pa.concat_arrays([ids, pa.array([None], kind)]))
                    for column, values, total in ((2, scores, 0.0), (3, np.zeros(len(ids), np.int64), blocks), (4, np.zeros(len(ids), np.int64), skipped)):
                        out[column].append(np.append(values, total))
        numbers = [np.concatenate(x) if x else np.zeros(0) for x in (out[0], *out[2:])]
        docs = pa.concat_arrays(out[1]) if out[1] else pa.array([], kind)
        return pa.Table.from_arrays([pa.array(numbers[0].astype(np.int64)), docs, pa.array(numbers[1].astype(np.float64)), pa.array(numbers[2].astype(np.int64)), pa.array(numbers[3].astype(np.int64))], ["query_id", "doc_id", "score", "blocks", "skipped"])

    return run


def _alone(walk):
    def run(table: pa.Table) -> pa.Table:
        return walk(table, None)

    return run


class _Segment:
    """A segment's asked blocks, ready for many searches."""

    def __init__(self, table: pa.Table, head: pa.Table, gone: pa.Table | None, place: dict[str, int], mean: np.ndarray, holders, n_users: int, wanted: dict[str, list[str]]):
        terms = table.column("term").combine_chunks().dictionary_encode()
        term = np.array([place[w] for w in terms.dictionary.to_pylist()], np.int64)[terms.indices.to_numpy()]
        field = table.column("field").to_numpy().astype(np.int64)
        order = np.lexsort((field, term))
        table = table.take(pa.array(order))
        self.term, self.field, self.mean = term[order], field[order], mean
        column = lambda c: table.column(c).combine_chunks()
        docs, best_tf = column("docs"), column("best_tf")
        self.start = docs.offsets.to_numpy().astype(np.int64) - docs.offsets[0].as_py()
        # Documents by their order in the segment.
        coded = docs.flatten().dictionary_encode()
        by = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.doc, self.ids = rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(by))
        self.first, self.last = self.doc[self.start[:-1]], self.doc[self.start[1:] - 1]
        self.tf, self.len = (column(c).flatten().to_numpy().astype(np.float64) for c in ("tf", "len"))
        at = best_tf.offsets.to_numpy().astype(np.int64) - best_tf.offsets[0].as_py()
        top = self._part(best_tf.flatten().to_numpy().astype(np.float64), column("best_len").flatten().to_numpy().astype(np.float64), np.repeat(self.field, np.diff(at)))
        self.peak = np.maximum.reduceat(top, at[:-1])
        # What each document's mark lets each user see.
        docs, mark, marks = (head.column(c).combine_chunks().flatten() for c in ("docs", "mark", "marks"))
        see = visible_marks(marks, holders, n_users, wanted)
        self.see = see[mark.to_numpy()[pc.index_in(self.ids, docs).to_numpy()]]
        if gone is not None and gone.num_rows:
            dead = pc.drop_null(pc.index_in(gone.column("doc_id").combine_chunks(), self.ids)).to_numpy()
            self.see[dead] = False

    def _part(self, tf: np.ndarray, length: np.ndarray, field: np.ndarray) -> np.ndarray:
        return tf / (tf + K1 * (1 - B + B * length / self.mean[field]))

    def best(self, terms: np.ndarray, often: np.ndarray, weight: np.ndarray, user: int, k: int) -> tuple[pa.Array, np.ndarray, int, int]:
        """Ids and scores of the k best by score, then id; how many blocks the terms have, and how many weren't scored."""
        lo, hi = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        sizes = hi - lo
        rows = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        if not len(rows):
            return self.ids.slice(0, 0), np.zeros(0), 0, 0
        factor = np.repeat(often, sizes) * weight[self.field[rows], self.term[rows]]
        first, last = self.first[rows], self.last[rows]
        borders = np.unique(np.concatenate([first, last + 1]))
        a, b = np.searchsorted(borders, first), np.searchsorted(borders, last + 1)
        bounds = []
        for f in range(len(BOOSTS)):
            on = self.field[rows] == f
            d = np.bincount(a[on], factor[on] * self.peak[rows[on]], len(borders)) - np.bincount(b[on], factor[on] * self.peak[rows[on]], len(borders))
            bounds.append(np.cumsum(d))
        bound = np.maximum(*bounds) + TIE * np.minimum(*bounds) + SLACK
        seen = np.concatenate([[0], np.cumsum(self.see[:, user])])
        inside = np.diff(seen[np.append(borders, len(self.ids))[: len(borders) + 1]])
        stretches = np.flatnonzero(inside > 0)
        stretches = stretches[np.argsort(-bound[stretches], kind="stable")]
        scores, docs, scored, at, step = np.zeros(0), np.zeros(0, np.int64), np.zeros(len(rows), bool), 0, 0
        while at < len(stretches):
            least = scores[k - 1] if len(scores) >= k else -np.inf
            if bound[stretches[at]] < least:
                break
            # At first as many as hold k visible documents, then twice as many each time.
            step = max(1, int(np.searchsorted(np.cumsum(inside[stretches]), k)) + 1) if not at else 2 * step
            now = stretches[at : at + step]
            now = now[bound[now] >= least]
            at += step
            chosen = np.zeros(len(borders), bool)
            chosen[now] = True
            run = np.concatenate([[0], np.cumsum(chosen)])
            need = np.flatnonzero(run[b] > run[a])
            scored[need] = True
            size = np.diff(self.start)[rows[need]]
            p = np.repeat(self.start[rows[need]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            by = np.repeat(need, size)
            keep = chosen[np.searchsorted(borders, self.doc[p], "right") - 1] & self.see[self.doc[p], user]
            p, by = p[keep], by[keep]
            d, f = self.doc[p], self.field[rows[by]]
            w = factor[by] * self._part(self.tf[p], self.len[p], f)
            found, d = np.unique(d, return_inverse=True)
            title, body = (np.bincount(d[f == i], w[f == i], len(found)) for i in range(len(BOOSTS)))
            scores = np.concatenate([scores, np.round(np.maximum(title, body) + TIE * np.minimum(title, body), 6)])
            docs = np.concatenate([docs, found])
            top = np.lexsort((docs, -scores))[:k]
            scores, docs = scores[top], docs[top]
        return self.ids.take(pa.array(docs)), scores, len(rows), int((~scored).sum())
