"""N-gram Jaccard self join by T-occurrence search, as components of linked documents.

Steps, each a Spark job over all documents:

1. every document's set of word shingles is hashed; a signature names the set, and a count sketch of fixed size orders shingles from rare to common;
2. the prefix of each set (its rarest shingles: one more than a partner may lack) is dealt out by shingle with their places in the order; shingles of a single set drop out. What a pair must share grows with both sizes, so lists are split into bands of sizes: in a band, sets of that size are the small ones if their place allows a partner at least as large, and larger sets enter as far as their place allows a partner of that size. Any linked pair meets in a list whose band is that of its smaller set, which is one of the small ones there;
3. in each list the hub (the small set that shares most lists) is the query and the other sets of the list, as far as places and sizes allow a link, the indexed records: DivideSkip merges the short inverted lists with a heap, probes the long ones by binary search and keeps records reaching the required overlap;
4. sets that one component already holds aren't compared again. Lists of at most LIST sets (and LIST_SHINGLES shingles) that still hold several components are searched whole: each of their sets is a query against the inverted lists of the others. In longer ones WIDER times as many sets a round are queries, those of the rarest components first, until they hold one component or are short enough.

Exact copies are one set, and copies within one task are dealt out once, so a hot text costs what a single one does. A shingle that the sketch counts HOT times or more is dealt out by sets as well, and a hub's records in blocks, so no group is gathered by one task. Lists whose many sets aren't linked at all are compared pair by pair in the end: no exact join can spare that. Sets are compared by 64-bit hashes of their shingles.

Nulls, empty texts and texts without words have no set: n_shingles is 0 and they are linked with nothing, component_id is their own doc_id. A null doc_id takes part with its text; its component is the smallest doc_id that isn't null, or null. Repeated rows each give a row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components, contracted

SHINGLE, PERCENT = 4, 85
#: Buckets of the count sketch (a power of two): a byte each, whatever the input. It only orders shingles; any order gives whole results.
SKETCH_BITS = 24
SKETCH, PARTS = 1 << SKETCH_BITS, 64
#: Sizes in a band differ by this factor at most.
BAND = 1.03
#: Rows that a task gathers before it sends them on, and rows of 8 bytes that are sent to every task at most.
SENT, FEW = 100_000, 100_000
#: From so many occurrences on a shingle's sets are dealt out by set as well.
HOT = 4096
#: Records of one search; sets and shingles of a list that is searched whole, at most; and the growth of queries from round to round in longer ones.
BLOCK, LIST, LIST_SHINGLES, WIDER = 256, 2048, 1 << 22, 8


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def document_sets(batch: pa.RecordBatch, k: int, text: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row."""
    data, at = common.text_buffers(batch.column(text))
    for first, last, h, w, _, _ in common.words(data, at):
        if len(h) >= k:
            all_k = common.shingles(h, k)
        for i in range(last - first):
            a, b = int(w[i]), int(w[i + 1])
            yield first + i, np.unique(all_k[a : b - k + 1] if b - a >= k else common.shingles(h[a:b], k))


def signature(s: np.ndarray) -> int:
    """Names a set, as a signed 64-bit number."""
    total = np.sum(s, keepdims=True, dtype=np.uint64) * common._C + np.uint64(len(s))
    return int(common.signed(common.mix(total ^ common.mix(np.bitwise_xor.reduce(s, keepdims=True))))[0])


class Lists:
    """Inverted lists: for each shingle of universe (sorted) the ordinals of the records (sorted arrays) that hold it."""

    def __init__(self, records: list[np.ndarray], universe: np.ndarray):
        items, which = np.concatenate(records), np.repeat(np.arange(len(records), dtype=np.int32), [len(r) for r in records])
        at = np.minimum(np.searchsorted(universe, items), len(universe) - 1)
        hit = universe[at] == items
        at, which = at[hit], which[hit]
        order = np.lexsort((which, at))
        self.universe, self.which, self.starts = universe, which[order], np.searchsorted(at[order], np.arange(len(universe) + 1))

    def reaching(self, query: np.ndarray, t: int, allowed: np.ndarray | None = None) -> list[tuple[int, int]]:
        """DivideSkip: (ordinal, overlap) of the allowed records that share at least t shingles with the query, whose shingles the universe holds."""
        at = np.searchsorted(self.universe, query)
        lists = [self.which[a:b] for a, b in zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), strict=True) if b > a]
        if allowed is not None:
            lists = [x for x in (x[allowed[x]] for x in lists) if len(x)]
        if len(lists) < t:
            return []
        lists.sort(key=len)
        n_long = min(t - 1, int(t / (0.02 * np.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        candidates, counts, last, run = [], [], -1, 0
        for x in heapq.merge(*(x.tolist() for x in short)):
            if x == last:
                run += 1
                continue
            if run >= t - n_long:
                candidates.append(last)
                counts.append(run)
            last, run = x, 1
        if run >= t - n_long:
            candidates.append(last)
            counts.append(run)
        if not candidates:
            return []
        c, total = np.array(candidates), np.array(counts)
        for x in long:
            p = np.minimum(np.searchsorted(x, c), len(x) - 1)
            total = total + (x[p] == c)
        return [(int(i), int(n)) for i, n in zip(c, total, strict=True) if n >= t]


def divide_skip(query: np.ndarray, records: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(ordinal, overlap) of the records (sorted arrays) whose overlap with the query reaches what it needs of any partner."""
    return Lists(records, query).reaching(query, overlap_needed(len(query), percent))


def linked(a: int, b: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """A row (doc_id, n, sig) for each document, and for each task its part of the count sketch."""

    def run(batches):
        counts = np.zeros(SKETCH, np.uint16)  # beyond 65,535 in a task they start anew: only the order suffers
        for batch in batches:
            n, sig = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row, s in document_sets(batch, k):
                n[row] = len(s)
                if len(s):
                    sig[row] = signature(s)
                    np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(sig, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["doc_id", "n", "sig", "part", "counts"])
        if counts.any():
            none = pa.nulls(1, pa.int64())
            for part, x in enumerate(np.split(counts, PARTS)):
                yield pa.record_batch([none, none, none, pa.array([part], pa.int32()), pa.array([_packed(x)], pa.binary())], ["doc_id", "n", "sig", "part", "counts"])

    return common.saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, sig long, part int, counts binary"), "sets")


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bytes, the few that don't fit behind them; compressed."""
    far = np.flatnonzero(counts > 254)
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + far.astype(np.int64).tobytes() + counts[far].astype(np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    counts = np.frombuffer(raw[: SKETCH // PARTS], np.uint8).astype(np.int64)
    far, values = np.frombuffer(raw[SKETCH // PARTS :], np.int64).reshape(2, -1)
    counts[far] = values
    return counts


def _sketch(described: DataFrame) -> np.ndarray:
    """The sums of the tasks' sketches, as a byte on a scale of logarithms."""

    def added(batches) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = _unpacked(counts) + sums.get(part, 0)
        return sums

    def run(batches):
        for part, x in added(batches).items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([_packed(x)], pa.binary())], ["part", "counts"])

    def scale(batches):
        for part, x in added(batches).items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([np.minimum(255, np.round(12 * np.log2(1.0 + x))).astype(np.uint8).tobytes()], pa.binary())], ["part", "counts"])

    total = np.zeros((PARTS, SKETCH // PARTS), np.uint8)
    # Each task adds up what it reads; a second round adds up what the tasks found, by part.
    once = described.filter("part is not null").select("part", "counts").mapInArrow(run, "part int, counts binary")
    for part, counts in once.repartition(PARTS, "part").mapInArrow(scale, "part int, counts binary").collect():
        total[part] = np.frombuffer(counts, np.uint8)
    return total.reshape(-1)


def _prefixes(docs: DataFrame, order, k: int, percent: int) -> DataFrame:
    """(key, sig, n, pos, salt): the rarest shingles of each set with their places, enough for any partner to share one; order: the broadcast sketch; salt: 0, or for hot shingles one of several numbers, by the set."""

    def run(batches):
        seen: set[int] = set()
        salts = np.maximum(1, (2.0 ** (np.arange(256) / 12) - 1) // HOT).astype(np.int64)  # of each byte of the sketch
        keys, sigs, ns, salt, held = [], [], [], [], 0

        def sent() -> pa.RecordBatch:
            nonlocal held
            each = [len(x) for x in keys]
            out = pa.record_batch([pa.array(common.signed(np.concatenate(keys))), pa.array(np.repeat(np.array(sigs), each)), pa.array(np.repeat(np.array(ns, np.int32), each)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in each])), pa.array(np.concatenate(salt))], ["key", "sig", "n", "pos", "salt"])
            for x in (keys, sigs, ns, salt):
                x.clear()
            held = 0
            return out

        for batch in batches:
            for _, s in document_sets(batch, k):
                if len(s) and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    p = len(s) - overlap_needed(len(s), percent) + 1
                    often = order.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    by = np.argsort((often.astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24)), kind="stable")[:p]
                    many = salts[often[by]]
                    keys.append(s[by])
                    sigs.append(sig)
                    ns.append(len(s))
                    salt.append(np.where(many > 1, 1 + sig % many, 0).astype(np.int32))
                    held += p
                    if held >= SENT:
                        yield sent()
        if keys:
            yield sent()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, sig long, n int, pos int, salt int")


def _shared(postings: DataFrame) -> DataFrame:
    """(key, sig, n, pos): of shingles that several sets hold, each set once. Hot ones are dealt out by salt too and all stay: one that a single set holds drops out with its list."""
    w = Window.partitionBy("key", "salt")
    seen = postings.withColumns({"a": F.min("sig").over(w), "b": F.max("sig").over(w), "before": F.lag("sig").over(w.orderBy("sig"))})
    return seen.filter("(salt > 0 or a <> b) and (before is null or before <> sig)").select("key", "sig", "n", "pos")


def _both(n: str, m: str, percent: int) -> str:
    """SQL: the overlap that sets of n and m elements need."""
    return f"((CAST({percent} AS BIGINT) * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _lists(shared: DataFrame, percent: int) -> tuple[DataFrame, dict]:
    """(list, sig, n, pos, small), and how many rows: the lists of each shingle's bands that hold a small set and another one; equal ones are one list (so are, once in 2**64, others: that only adds pairs to compare)."""
    # Keys with the same sets are one list, with the least place that each set has in them: far fewer rows go into bands.
    same = shared.groupBy("key").agg(F.count("*").alias("size"), F.min("sig").alias("a"), F.max("sig").alias("b"), F.try_sum(F.shiftright(F.xxhash64("sig"), 24)).alias("total")).filter("size > 1")
    merged = shared.join(same.select("key", F.xxhash64("size", "a", "b", "total").alias("group")), "key").groupBy("group", "sig").agg(F.first("n").alias("n"), F.min("pos").alias("pos"))
    band = lambda n: f"CAST(floor(ln({n}) / {float(np.log(BAND))!r}) AS INT)"
    least = f"((n * {percent} + 99) div 100)"
    each = common.saved(merged, "groups").withColumn("own", F.expr(band("n"))).withColumn("band", F.explode(F.expr(f"sequence({band(least)} - 1, own)")))
    # A size below all of the band's: the place may only be judged too mildly.
    each = each.withColumn("low", F.expr(f"greatest({least}, CAST(floor(exp(band * {float(np.log(BAND))!r})) AS BIGINT) - 1)"))
    each = each.filter(F.expr(f"pos <= n - {_both('n', 'low', percent)}")).withColumn("small", F.expr(f"own = band and pos <= n - {_both('n', 'n', percent)}"))
    whole = each.groupBy("group", "band").agg(F.count("*").alias("size"), F.count_if("small").alias("smalls"), F.min("sig").alias("a"), F.max("sig").alias("b"), F.try_sum(F.shiftright(F.xxhash64("sig", "small"), 24)).alias("total")).filter("size > 1 and smalls > 0")
    named = each.join(whole, ["group", "band"]).select(F.xxhash64("size", "a", "b", "total").alias("list"), "sig", "n", "pos", "small")
    return common.measured(named.groupBy("list", "sig").agg(F.first("n").alias("n"), F.min("pos").alias("pos"), F.bool_or("small").alias("small")), "lists", rows=F.count(F.lit(1)))


def _texts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sig, text) of the sets in wanted (sig), written; a set comes once for each task that holds it, and others may come too."""
    shared = docs.sparkSession.sparkContext.broadcast(common.maybe_in(wanted))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rows, sigs = [], []
            for row, s in document_sets(batch, k):
                if len(s):
                    sig = signature(s)
                    at = sig % common.FILTER_BITS
                    if shared.value[at >> 3] >> (at & 7) & 1 and sig not in seen:
                        seen.add(sig)
                        rows.append(row)
                        sigs.append(sig)
            for i in range(0, len(rows), 64):
                yield pa.record_batch([pa.array(sigs[i : i + 64]), batch.column("text").take(pa.array(rows[i : i + 64]))], ["sig", "text"])

    found = common.saved(docs.select(F.col("text").cast("string")).mapInArrow(run, "sig long, text string"), "texts")
    shared.destroy()
    return found


class _Member(NamedTuple):
    sig: int
    comp: int
    ask: bool
    small: bool | None
    n: int | None
    pos: int | None
    shingles: np.ndarray


def _links(members: list[_Member], percent: int) -> list[tuple[int, int]]:
    """Pairs of sigs that hold the linked members of different components together: each member that asks is a query, and pairs that a component already holds aren't compared. Where places are given, they and small must allow the pair."""
    asks = [i for i, m in enumerate(members) if m.ask]
    _, comp = np.unique([m.comp for m in members], return_inverse=True)
    if not asks or not comp.any():
        return []
    sets = [m.shingles for m in members]
    size, done, out = np.array([len(s) for s in sets]), np.zeros(len(members), bool), []
    placed = members[0].pos is not None
    if placed:
        pos, small = np.array([m.pos for m in members]), np.array([m.small for m in members])
    lists = None
    for i in asks:
        ok = (comp != comp[i]) & ~done & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if placed:
            need = -(-percent * (size + size[i]) // (100 + percent))
            ok &= (small | small[i]) & (pos <= size - need) & (pos[i] <= size[i] - need)
        done[i] = True
        if not ok.any():
            continue
        if lists is None:
            lists = Lists(sets, sets[i] if len(asks) == 1 else np.unique(np.concatenate([sets[j] for j in asks])))
        for j, overlap in lists.reaching(sets[i], overlap_needed(int(size[i]), percent), ok):
            if linked(int(size[i]), int(size[j]), overlap, percent):
                out.append((members[i].sig, members[j].sig))
                comp[comp == comp[j]] = comp[i]
    return out


GROUP = ["list", "blocks", "block"]


def _search(groups: DataFrame, k: int, percent: int) -> DataFrame:
    """groups (GROUP, sig, comp, ask, small, n, pos, text) to linked pairs (u, v) that hold each group's components together."""

    def run(batches):
        now, members, out = None, {}, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True))
            rest = list(zip(*(batch.column(c).to_pylist() for c in ("sig", "comp", "ask", "small", "n", "pos")), strict=True))
            for row, s in document_sets(batch, k):
                if keys[row] != now:
                    out += _links(list(members.values()), percent)
                    now, members = keys[row], {}
                m = _Member(*rest[row], s)
                if m.sig not in members or m.ask:
                    members[m.sig] = m
            if len(out) >= 1000:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), ["u", "v"])
                out = []
        out += _links(list(members.values()), percent)
        if out:
            yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), ["u", "v"])

    return groups.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "u long, v long")


def _hub_groups(active: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """What _search takes: each hub (list, hub, blocks: a power of two that follows the size of its list) with the sets of its list, by blocks, as far as places and sizes allow a link."""
    hubs = hubs.select("list", F.col("hub.sig").alias("query"), F.col("hub.n").alias("qn"), F.col("hub.pos").alias("qpos"), F.col("hub.small").alias("qsmall"), F.col("hub.comp").alias("qcomp"), "blocks")
    need = _both("n", "qn", percent)
    pairs = active.join(hubs, "list").filter(F.expr(f"comp <> qcomp and (small or qsmall) and 100 * least(n, qn) >= {percent} * greatest(n, qn) and pos <= n - {need} and qpos <= qn - {need}"))
    records = pairs.select(F.col("query").alias("list"), "blocks", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"), "sig", "comp", F.lit(False).alias("ask")).distinct()
    asking = hubs.select("query", "qcomp", "blocks").distinct()
    asking = asking.select(F.col("query").alias("list"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("query").alias("sig"), F.col("qcomp").alias("comp"), F.lit(True).alias("ask"))
    none = {"small": F.lit(None).cast("boolean"), "n": F.lit(None).cast("int"), "pos": F.lit(None).cast("int")}
    return records.union(asking).withColumns(none)


def _linked_sets(docs: DataFrame, lists: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the sets that have links. lists: (list, sig, n, pos, small)."""
    texts = every = _texts(docs, lists.select("sig").distinct(), k)
    search = lambda groups: _search(groups.join(texts, "sig").select(*GROUP, "sig", "comp", "ask", "small", "n", "pos", "text"), k, percent)
    blocks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BLOCK)))).cast("int").alias("blocks")
    hub = lambda by: F.max_by(F.struct("sig", "n", "pos", "small", "comp"), by).alias("hub")
    score = lists.join(lists.groupBy("list").agg(F.count("*").alias("size")), "list").groupBy("sig").agg(F.sum("size").alias("score"))
    active, queries, edges = lists.withColumn("comp", F.col("sig")), 1, None
    done = common.saved(active.join(score, "sig").groupBy("list").agg(hub(F.struct("small", "score", "sig")), blocks), "hubs")
    groups = _hub_groups(active, done, percent)
    while True:
        found, seen = common.measured(search(groups), "links", n=F.count(F.lit(1)))
        common.tidy(docs.sparkSession)
        if seen["n"]:
            edges, _ = contracted(found if edges is None else edges.union(found))
            # A set's smallest neighbour so far: sets of one component may still bear several names, which costs comparisons only.
            names = edges.groupBy("u").agg(F.min("v").alias("v"))
            active = active.withColumn("comp", F.col("sig")).join(names.withColumnRenamed("u", "sig"), "sig", "left").withColumn("comp", F.coalesce("v", "comp")).drop("v")
        left = active.select("list", "sig", "n", "pos", "small", "comp").join(done.select("list", F.col("hub.sig").alias("sig")), ["list", "sig"], "left_anti")
        is_long = ((F.count("*") > LIST) | (F.sum("n") > LIST_SHINGLES)).alias("long")
        several = left.groupBy("list").agg(is_long, F.min("comp").alias("a"), F.max("comp").alias("b"), F.bool_or("small").alias("any")).filter("a <> b and any").select("list", "long")
        active, seen = common.measured(left.join(several, "list"), "lists", rows=F.count(F.lit(1)), long=F.count_if("long"))
        if not seen["rows"]:
            break
        if seen["rows"] <= FEW:
            # 8 bytes a row: sent to every task, so that only their texts are dealt out again.
            texts = every.join(F.broadcast(active.select("sig").distinct()), "sig", "left_semi")
        # Short lists are searched whole, once.
        groups = active.filter("not long").select("list", F.lit(0).alias("blocks"), F.lit(0).alias("block"), "sig", "comp", F.lit(True).alias("ask"), "small", "n", "pos")
        if not seen["long"]:
            found = common.saved(search(groups), "links")
            edges = found if edges is None else edges.union(found)
            break
        queries *= WIDER
        long = active.filter("long").drop("long")
        often = long.groupBy("list", "comp").agg(F.count("*").alias("often"))
        salt = F.pmod(F.xxhash64("sig", F.lit(queries)), F.lit(queries)).alias("salt")
        done = common.saved(long.join(often, ["list", "comp"]).groupBy("list", salt).agg(hub(F.struct(-F.col("often"), "sig"))).join(long.groupBy("list").agg(blocks), "list"), "hubs")
        groups = groups.unionByName(_hub_groups(long, done, percent))
        active = long
    return None if edges is None else components(edges)


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of each row, and of each set, written, (sig, least, rows, component): its smallest doc_id, its number of rows and the name of its component."""
    described = _describe(docs, k)
    rows = described.filter("part is null").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), "sig")
    order = docs.sparkSession.sparkContext.broadcast(_sketch(described))
    shared = common.saved(_shared(_prefixes(docs, order, k, percent)), "shared")
    order.destroy()
    common.tidy(docs.sparkSession)
    lists, seen = _lists(shared, percent)
    comps = _linked_sets(docs, lists, k, percent) if seen["rows"] else None
    classes = rows.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    if comps is None:
        classes = classes.withColumn("component", F.col("sig"))
    else:
        classes = classes.join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    return rows, common.saved(classes, "classes")


def ngram_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id): documents link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles."""
    rows, classes = _classes(docs, k, percent)
    whole = classes.join(classes.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("sig", "component_id")
    linked_rows = rows.filter("sig is not null").join(whole, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked_rows.union(rows.filter("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without all but one row of each component: that of the smallest doc_id (those without come last; of texts with one doc_id that of the smallest signature, of repeated rows any).

    Rows are told apart by doc_id and text, so texts that share a doc_id are judged each for itself. Rows without words stay. All columns stay as they are. Only rows that a filter of fixed size can't tell to stay are shuffled.
    """
    rows, classes = _classes(docs, k, percent)
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("last"), "least", "sig")).alias("first"), F.sum("rows").alias("all")).filter(F.col("all") > 1)
    chosen = classes.join(first, "component").select("sig", (F.col("first.sig") == F.col("sig")).alias("rep"), F.col("first.least").alias("least"))
    # By doc_id and text, not by text: copies of one text are judged in many tasks.
    judged = rows.filter("sig is not null").join(chosen, "sig").select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), (F.col("rep") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("__keep")).distinct()
    judged = common.saved(judged, "judged")
    bits = docs.sparkSession.sparkContext.broadcast(common.maybe_in(judged.filter("__id is not null").select("__id")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    number, text = common.named(docs, "doc_id"), common.named(docs, "text")

    def unsure(batch: pa.RecordBatch) -> np.ndarray:
        doc_id = batch.column(number).cast(pa.int64())
        at = np.mod(pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False), common.FILTER_BITS)
        return (bits.value[at >> 3] >> (at & 7) & 1).astype(bool) | pc.is_null(doc_id).to_numpy(zero_copy_only=False)

    def sure(batches):
        for batch in batches:
            yield batch.filter(pa.array(~unsure(batch)))

    def named(batches):
        for batch in batches:
            batch = batch.filter(pa.array(unsure(batch)))
            sig = [None] * batch.num_rows
            for row, s in document_sets(batch, k, text):
                sig[row] = signature(s) if len(s) else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.int64())], [*batch.schema.names, "__sig"])

    maybe = docs.mapInArrow(named, f"{kinds}, __sig long").withColumnRenamed("__sig", "__text")
    maybe = maybe.join(judged, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sig")), "left").filter("__keep is null or __keep")
    # Of repeated rows that stay, one each; rows that aren't judged are all different.
    maybe = maybe.withColumn("__row", F.when(F.col("__keep").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", "__text", "__row"])
    return docs.mapInArrow(sure, kinds).union(maybe.select(*docs.columns))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(common.table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, and all that is reachable: for small tables.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT p.b, r.c FROM reach r JOIN pairs p ON p.a = r.doc_id)
SELECT doc_id, n_shingles, component_id FROM (SELECT doc_id, len(s) AS n_shingles FROM sets) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
