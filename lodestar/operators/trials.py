"""Revocation measured on searches: each trial grants, waits until a search shows its document, revokes, and searches until it is gone.

trials: (trial, user, doc_id, query, granted_ms, revoked_ms), one row each; a null time: never sent. changes: (src, dst, present, sent_ms), the edges that trials send. Rounds are micro-batches: each takes over what was sent since the last one, and then every trial searches, all trials in one plan. What a trial sees comes from the expansions that the rounds keep up to date and from retrieval itself, nothing is taken from the times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import retrieval
from .closure import Closure
from .postings import Index


def probe(docs: DataFrame, trials: DataFrame, changes: DataFrame, kept: Closure, rounds: Sequence[int], first: int = 0, index: Index | None = None, k: int = retrieval.DEPTH) -> DataFrame:
    """(trial, probe_ms, visible, others): by trial and round whether the trial's document is among the k best of its search, and how many others are. rounds: rising times; kept: whose batches before first are done."""
    searches = cut(trials.select(F.col("trial").alias("query_id"), "user", "query"), "searches")
    own = trials.select(F.col("trial").alias("query_id"), F.col("doc_id").alias("own"))
    out, since = None, None
    for n, at in enumerate(rounds, first):
        due = F.col("sent_ms") <= at if since is None else (F.col("sent_ms") <= at) & (F.col("sent_ms") > since)
        # Of an edge that was sent twice the last state counts; of one time a revoke.
        newest = changes.filter(due).groupBy("src", "dst").agg(F.max_by("present", F.struct("sent_ms", ~F.col("present"))).alias("present"))
        kept.apply(cut(newest, "changes"), n)
        hits = retrieval.bm25(docs, searches, cut(kept.expansion(searches.select("user"), n), "held"), k, index)
        seen = own.join(hits, "query_id", "left").groupBy(F.col("query_id").alias("trial")).agg(
            F.coalesce(F.bool_or(F.col("doc_id") == F.col("own")), F.lit(False)).alias("visible"), F.count_if(F.col("doc_id") != F.col("own")).alias("others")
        )
        seen = cut(seen.withColumn("probe_ms", F.lit(at).cast("long")), "seen")
        out, since = seen if out is None else out.unionByName(seen), at
    return out


def latencies(trials: DataFrame, probes: DataFrame) -> DataFrame:
    """(trial, grant_ms, revoke_ms, timed_out, leaks): until the first search that shows the document and, where one did, from the revoke until the first that doesn't; timed_out: no such search after a revoke that was sent; leaks: others' documents seen."""
    j = trials.select("trial", "granted_ms", "revoked_ms").join(probes, "trial")
    shown = F.min(F.when(F.col("visible") & (F.col("probe_ms") >= F.col("granted_ms")), F.col("probe_ms")))
    gone = F.min(F.when(~F.col("visible") & (F.col("probe_ms") >= F.col("revoked_ms")), F.col("probe_ms")))
    each = j.groupBy("trial", "granted_ms", "revoked_ms").agg(shown.alias("shown"), gone.alias("gone"), F.sum("others").alias("leaks"))
    return each.select(
        "trial", (F.col("shown") - F.col("granted_ms")).alias("grant_ms"), F.when(F.col("shown") < F.col("gone"), F.col("gone") - F.col("revoked_ms")).alias("revoke_ms"),
        (F.col("shown").isNotNull() & F.col("revoked_ms").isNotNull() & F.col("gone").isNull()).alias("timed_out"), "leaks",
    )
