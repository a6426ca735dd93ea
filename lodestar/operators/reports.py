"""Statistics: percentiles, histograms, counters, rates, samples, pages, relevance and convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import seeded

#: Upper bounds of latency buckets, in milliseconds.
BUCKETS = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99 with max and n."""
    at = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").cast("long").alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)]
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(*at, F.max(value).cast("long").alias("max"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, *by: str, buckets: list[int] | None = None) -> DataFrame:
    """(by, le, n): how many values are at most le; le null counts all."""
    bounds = BUCKETS if buckets is None else buckets
    counts = [F.struct(F.lit(b).cast("long").alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    counts.append(F.struct(F.lit(None).cast("long").alias("le"), F.count(value).alias("n")))
    return df.groupBy(*by).agg(F.array(*counts).alias("h")).select(*by, F.explode("h").alias("h")).select(*by, "h.le", "h.n")


def counter(df: DataFrame, value: Column, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).alias("total"))


def share_below(df: DataFrame, value: str, limit: int, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg((F.col(value) < limit).cast("double")), 6).alias("share"), F.count(value).alias("n"))


def peak_rate(events: DataFrame, ts: str = "ts", seconds: int = 10, slide: int = 1) -> DataFrame:
    """(peak): the most events in any window of so many seconds that starts on a slide, a second.

    Events are counted by slide first; only those counts are put into windows.
    """
    ticks = events.groupBy(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slide * 1_000_000)).alias("tick")).agg(F.count("*").alias("n"))
    steps = seconds // slide
    wide = ticks.select(F.explode(F.sequence(F.col("tick") - (steps - 1), F.col("tick"))).alias("start"), "n").groupBy("start").agg(F.sum("n").alias("n"))
    return wide.agg(F.round(F.max("n") / F.lit(float(seconds)), 6).alias("peak"))


def revoke_latency(probes: DataFrame, timeout_ms: int = 15_000, share_ms: int = 700) -> DataFrame:
    """One row: nearest-rank percentiles of how long revoked grants stayed visible, the share of all trials below share_ms, and how many were still seen at the timeout. probes: (trial, revoked_ms, probe_ms, visible), one row for each look at a trial."""
    after = (F.col("probe_ms") >= F.col("revoked_ms")) & ~F.col("visible")
    trials = probes.groupBy("trial", "revoked_ms").agg((F.min(F.when(after, F.col("probe_ms"))) - F.col("revoked_ms")).alias("ms"))
    trials = trials.withColumn("ms", F.when(F.col("ms") <= timeout_ms, F.col("ms")))
    times = percentiles(trials, "ms").withColumn("k", F.lit(1))
    late = trials.agg(F.count("*").alias("trials"), F.count_if(F.col("ms").isNull()).alias("timeouts"), F.round(F.avg(F.coalesce(F.col("ms") < share_ms, F.lit(False)).cast("double")), 6).alias("share")).withColumn("k", F.lit(1))
    return late.join(times, "k", "left").drop("k")


def newest(df: DataFrame, most: int, *order: Column, by: list[str]) -> DataFrame:
    """The newest rows of each group, at most so many: a capped list."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= most)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with distinct keys, the same for the same seed: those with the least digest of key and seed."""
    return df.dropDuplicates([key]).orderBy(seeded(key, seed), key).limit(n)


def page_after(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The n rows that follow a key: pages whose cost doesn't grow with their depth."""
    return (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(n)


def page_at(df: DataFrame, order: list[Column | str], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def history(messages: DataFrame, ts: str, oldest, latest, n: int, *ties: str) -> tuple[DataFrame, DataFrame]:
    """(the newest n rows between the times, both exclusive, newest first; (has_more))."""
    between = messages.filter((F.col(ts) > F.lit(oldest)) & (F.col(ts) < F.lit(latest)))
    more = between.orderBy(F.desc(ts), *ties).limit(n + 1)
    return between.orderBy(F.desc(ts), *ties).limit(n), more.agg((F.count("*") > n).alias("has_more"))


def outcomes(hits: DataFrame, labels: DataFrame, deepest: int = 10) -> DataFrame:
    """(mode, query_id, datasource, n_rel, ranks): ranks of relevant hits after the query's own document went. hits: (mode, query_id, doc_id, rank, good: whether it is relevant); labels: (query_id, own, datasource, n_rel)."""
    modes = hits.select("mode").distinct()
    w = Window.partitionBy("mode", "query_id").orderBy("rank")
    j = hits.join(labels, "query_id").filter(~F.col("doc_id").eqNullSafe(F.col("own"))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= deepest)
    found = j.filter("good").groupBy("mode", "query_id").agg(F.array_sort(F.collect_list("r")).alias("ranks"))
    # A few modes: each label once for each of them.
    every = labels.select("query_id", "datasource", "n_rel").withColumn("k", F.lit(1)).join(F.broadcast(modes.withColumn("k", F.lit(1))), "k").drop("k")
    return every.join(found, ["mode", "query_id"], "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))


def relevance(found: DataFrame) -> DataFrame:
    """(mode, datasource or null for all, n, hit_at_1, recall_at_5, recall_at_10, mrr_at_10, ndcg_at_5) of outcomes."""
    ranks, rel = F.col("ranks"), F.col("n_rel").cast("double")

    def within(k):
        return F.size(F.filter(ranks, lambda r: r <= k)).cast("double")

    dcg = F.aggregate(F.filter(ranks, lambda r: r <= 5), F.lit(0.0), lambda s, r: s + 1 / F.log2(r.cast("double") + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(5))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r.cast("double") + 1))
    each = found.filter("n_rel > 0").select(
        "mode", "datasource", (within(1) > 0).cast("double").alias("hit"), (within(5) / rel).alias("r5"), (within(10) / rel).alias("r10"),
        F.coalesce(1 / F.array_min(ranks).cast("double"), F.lit(0.0)).alias("rr"), (dcg / ideal).alias("ndcg"),
    )
    means = {"hit_at_1": "hit", "recall_at_5": "r5", "recall_at_10": "r10", "mrr_at_10": "rr", "ndcg_at_5": "ndcg"}
    sets = each.groupingSets([[F.col("mode")], [F.col("mode"), F.col("datasource")]], F.col("mode"), F.col("datasource"))
    return sets.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(name) for name, c in means.items()])


def lift(base: Column, value: Column) -> Column:
    """By how many per cent value is above base, to a tenth; 0 where base is 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.round((value - base) / base * 100, 1))


def convergence(expected: DataFrame, state: DataFrame, applies: DataFrame, expected_applies: DataFrame) -> DataFrame:
    """One row: documents checked, lost, regressed and stale against expected (id, version, deleted, content_hash), and applies too many or too few (id, applies)."""
    have = state.select("id", F.col("version").alias("h_version"), F.col("deleted").alias("h_deleted"), F.col("content_hash").alias("h_hash"))
    j = expected.join(have, "id", "left")
    kind = (
        F.when(F.col("h_version").isNull() | (F.col("h_version") < F.col("version")), "lost")
        .when(F.col("h_version") > F.col("version"), "regressed")
        .when((F.col("h_deleted") != F.col("deleted")) | ~F.col("h_hash").eqNullSafe(F.col("content_hash")), "stale")
    )
    docs = j.select(kind.alias("kind")).agg(F.count("*").alias("checked"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("lost", "regressed", "stale")])
    a = applies.select("id", F.col("applies").alias("a")).join(expected_applies.select("id", F.col("applies").alias("e")), "id", "full_outer")
    off = F.coalesce("a", F.lit(0)) - F.coalesce("e", F.lit(0))
    counts = a.agg(F.coalesce(F.sum(F.greatest(off, F.lit(0))), F.lit(0)).alias("double_applies"), F.coalesce(F.sum(F.greatest(-off, F.lit(0))), F.lit(0)).alias("missed_applies"))
    return docs.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k").drop("k")


def leaks(hits: DataFrame, docs: DataFrame, truth: DataFrame) -> DataFrame:
    """The hits (user, doc_id, ...) that the true closure (user, principal) doesn't allow, or whose document is deleted or hidden: none should be."""
    acl = docs.filter("not deleted and not quarantined").select("doc_id", F.explode("allowed").alias("principal"))
    ok = hits.select("user", "doc_id").distinct().join(acl, "doc_id").join(truth, ["user", "principal"], "left_semi").select("user", "doc_id").distinct()
    return hits.join(ok, ["user", "doc_id"], "left_anti")


def disagreements(expansion: DataFrame, truth: DataFrame) -> DataFrame:
    """(user, principal, side): what only one of the two closures holds."""
    e = expansion.select("user", "principal", F.lit(True).alias("a"))
    return e.join(truth.withColumn("b", F.lit(True)), ["user", "principal"], "full_outer").filter("a is null or b is null").select("user", "principal", F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("side"))


def lag(progress: DataFrame) -> DataFrame:
    """(topic, lag): records that wait, by topic, of (topic, partition, latest, committed); unknown offsets (null or negative) are left out."""
    ok = progress.filter("latest >= 0 and committed >= 0")
    return ok.groupBy("topic").agg(F.sum(F.greatest(F.col("latest") - F.col("committed"), F.lit(0))).alias("lag"))
