"""Deliveries of hooks and events: verified, told from repetitions, and handled, in one stream.

Senders repeat what they think was lost, so each delivery's key is claimed for a time. Claims come in two phases: a batch picks, of each key without a live claim, the first delivery; these are handled; and only then are the claims written. What the handler says has failed isn't claimed, so the next delivery of the key (of the same batch, even) is handled; if the handler raises, the batch fails as a whole, no claim is left of it, and Spark does it again under its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import github_verified, signer
from ..session import counted, cut
from .store import Table

#: The usual hour for which a delivery counts as handled, and the window in which a signed request is fresh.
TTL_MS, SKEW_S = 3_600_000, 300
OUTCOMES = "key string, at_ms long, off long, outcome string"


def hook_problem(secret: str, signature: Column, body: Column) -> Column:
    """Why a hook is refused; null if it is its sender's."""
    return F.when(~github_verified(secret, signature, body), "forged")


def event_problem(secret: str, ts: Column, signature: Column, body: Column, at_ms: Column, skew_s: int = SKEW_S) -> Column:
    """Why an event is refused, by its signed time: null if it is its sender's, and fresh at at_ms."""
    signed = signer(secret, "v0=")(F.concat(F.lit("v0:"), ts, F.lit(":"), body)) == signature
    fresh = F.abs(F.floor(at_ms / 1000) - ts.try_cast("long")) <= skew_s
    return F.when(~F.coalesce(signed, F.lit(False)), "forged").when(~F.coalesce(fresh, F.lit(False)), "old")


def into(path: str, mapping: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], None]:
    """A handler that writes what mapping makes of deliveries (document events, say) below path."""

    def handle(rows: DataFrame, name: str) -> None:
        mapping(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    return handle


class Deliveries:
    """path: a shared folder for claims and outcomes. problem: a Column that says why a delivery is refused, or null. handle: takes deliveries and the name of their part of a batch, under which it may be called again, and returns (key) of those that failed, or None."""

    def __init__(self, spark: SparkSession, path: str, problem: Column, handle: Callable[[DataFrame, str], DataFrame | None], ttl_ms: int = TTL_MS, buckets: int = 64):
        self.spark, self.path, self.problem, self.handle, self.ttl_ms = spark, path.rstrip("/"), problem, handle, ttl_ms
        self.claims = Table(spark, f"{self.path}/claims", ["key"], "key string, claimed_ms long", buckets=buckets)

    def batch(self, deliveries: DataFrame, number: int) -> None:
        """deliveries: key, at_ms (when they came), off (their place) and what problem and handle need."""
        judged = cut(deliveries.withColumn("_problem", self.problem), "deliveries")
        todo = judged.filter("_problem is null and key is not null").drop("_problem")
        stored = self.claims.read(number) if todo.isEmpty() else self.claims.read(number, self.claims.touched(todo, number))
        claims = self.spark.createDataFrame([], self.claims.schema) if stored is None else stored
        # Deliveries without a live claim. Of a key whose first one is handled, those that its claim outlives are decided, and what came before the first one is.
        free = lambda since: since.isNull() | (F.col("at_ms") >= since + self.ttl_ms)
        left, n = counted(todo.join(claims.hint("merge"), "key", "left").filter(free(F.col("claimed_ms"))).drop("claimed_ms"), "left")
        picked, part, place = [], 0, ["key", "at_ms", "off"]
        # No side of a join is sent to every task: a small file may hold many rows.
        while n:
            first = cut(left.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("at_ms", "off"))).filter("_n = 1").drop("_n"), "first")
            failed = self.handle(first, f"{number}-{part}")
            done = first.select(*place).withColumn("outcome", F.lit("handled"))
            if failed is not None:
                failed = failed.select("key").distinct().withColumn("failed", F.lit("failed"))
                done = cut(first.select(*place).join(failed.hint("merge"), "key", "left").withColumn("outcome", F.coalesce("failed", F.lit("handled"))).drop("failed"), "picked")
            picked.append(done)
            later = F.struct("at_ms", "off") > F.struct("p_at", "p_off")
            of_key = done.select("key", F.col("at_ms").alias("p_at"), F.col("off").alias("p_off"), F.when(F.col("outcome") == "handled", F.col("at_ms")).alias("p_claim"))
            left, n = counted(left.join(of_key.hint("merge"), "key").filter(later & free(F.col("p_claim"))).drop("p_at", "p_off", "p_claim"), "left")
            part += 1
        outcome = todo.select(*place)
        if picked:
            all_ = picked[0]
            for p in picked[1:]:
                all_ = all_.unionByName(p)
            outcome = outcome.join(all_.hint("merge"), place, "left")
            claims = all_.filter("outcome = 'handled'").groupBy("key").agg(F.max("at_ms").alias("claimed_ms"))
        else:
            outcome = outcome.withColumn("outcome", F.lit(None).cast("string"))
            claims = self.spark.createDataFrame([], self.claims.schema)
        refused = judged.filter("_problem is not null or key is null").select("key", "at_ms", "off", F.coalesce("_problem", F.lit("no key")).alias("outcome"))
        outcome.withColumn("outcome", F.coalesce("outcome", F.lit("duplicate"))).unionByName(refused).write.mode("overwrite").parquet(f"{self.path}/outcomes/{number}")
        # Claims that have run out go when the table is compacted.
        newest = judged.agg(F.max("at_ms")).first()[0]
        self.claims.keep = None if newest is None else F.col("claimed_ms") > newest - self.ttl_ms
        # Last: until now nothing of this batch is claimed.
        self.claims.upsert(claims, number)

    def start(self, deliveries: DataFrame, **trigger) -> StreamingQuery:
        """trigger: as writeStream.trigger takes it; by default all that is there, then an end."""
        return deliveries.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def outcomes(self) -> DataFrame:
        """(key, at_ms, off, outcome): handled, failed, duplicate, forged, old or no key."""
        return self.spark.read.schema(OUTCOMES).parquet(f"{self.path}/outcomes/*")
