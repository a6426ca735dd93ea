"""Queries on what comes from sources and goes to sinks: deliveries, a log, links, results; and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.scalar import epoch_ms, is_project_key, next_link, signer
from ..session import scratch, table
from ..sources import dumps, log
from ..streaming import deliveries

SECRET = "a shared secret"


def _hmac_sql(message: str) -> str:
    """HMAC-SHA256 of a text, in hex, spelt out."""
    key = SECRET.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", signer(SECRET)(F.col("props")).alias("signature"))


SIGNATURES_SQL = f"SELECT event_id, 'sha256=' || {_hmac_sql('props')} AS signature FROM events"


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a delivery of its user and type: some with another text's signature, some with a time long past."""
    i = F.col("event_id")
    at = epoch_ms(F.col("ts"))
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), at.alias("at_ms"), i.alias("off"), F.col("props").alias("body"), (F.floor(at / 1000) - F.when(i % 13 == 4, 600).otherwise(0)).cast("string").alias("time"))
    text = F.when(F.col("off") % 11 == 5, F.concat("body", F.lit("x"))).otherwise(F.col("body"))
    return e.withColumn("signature", signer(SECRET, "v0=")(F.concat(F.lit("v0:"), "time", F.lit(":"), text)))


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each delivery, in a stream of three parts, if a claim counts for twelve hours and every seventh handling fails."""
    path, all_ = scratch(spark, "deliveries"), sent(spark, sf_dir)
    most = all_.agg(F.max("off")).first()[0] or 0
    problem = deliveries.event_problem(SECRET, F.col("time"), F.col("signature"), F.col("body"), F.col("at_ms"))
    keep = deliveries.into(f"{path}/handled", lambda rows: rows)

    def handle(rows: DataFrame, name: str) -> DataFrame:
        keep(rows, name)
        return rows.filter("off % 7 = 3").select("key")

    stream = deliveries.Deliveries(spark, f"{path}/out", problem, handle, ttl_ms=43_200_000)
    for part in range(3):
        all_.filter(F.floor(F.col("off") * 3 / F.lit(most + 1)) == part).write.mode("append").parquet(f"{path}/in")
        stream.start(spark.readStream.schema(all_.schema).parquet(f"{path}/in")).awaitTermination()
    return stream.outcomes().select("off", "key", "outcome")


DELIVERED_SQL = f"""
WITH sent AS (
  SELECT event_id AS off, user_id || ':' || event_type AS key, epoch_us(ts) // 1000 AS at_ms, props AS body,
    CAST(epoch_us(ts) // 1000000 - CASE WHEN event_id % 13 = 4 THEN 600 ELSE 0 END AS VARCHAR) AS time FROM events),
judged AS (
  SELECT *, CASE WHEN {_hmac_sql("'v0:' || time || ':' || body || CASE WHEN off % 11 = 5 THEN 'x' ELSE '' END")} <> {_hmac_sql("'v0:' || time || ':' || body")} THEN 'forged'
    WHEN abs(at_ms // 1000 - CAST(time AS BIGINT)) > 300 THEN 'old' END AS problem FROM sent),
lists AS (
  SELECT key, list({{'off': off, 'at': at_ms, 'fails': off % 7 = 3, 'outcome': CASE WHEN off % 7 = 3 THEN 'failed' ELSE 'handled' END, 'claim': CASE WHEN off % 7 = 3 THEN NULL ELSE at_ms END}} ORDER BY at_ms, off) AS l
  FROM judged WHERE problem IS NULL GROUP BY key),
played AS (
  SELECT key, list_reduce(list_transform(l, lambda x: [x]), lambda done, x: list_concat(done, [CASE WHEN done[-1].claim IS NULL OR x[1].at >= done[-1].claim + 43200000 THEN x[1]
    ELSE {{'off': x[1].off, 'at': x[1].at, 'fails': x[1].fails, 'outcome': 'duplicate', 'claim': done[-1].claim}} END])) AS l FROM lists)
SELECT off, key, problem AS outcome FROM judged WHERE problem IS NOT NULL
UNION ALL SELECT x.off, key, x.outcome FROM (SELECT key, unnest(l) AS x FROM played)"""

def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event through a keyed log: half of them written at once (and again under the same name), half by a stream; read back by a stream, with each one's place among those of its key."""
    log.register(spark)
    path = scratch(spark, "log")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("doc:"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"), F.col("event_id").alias("ts_ms"))
    half = (e.agg(F.max("ts_ms")).first()[0] or 0) // 2
    for _ in range(2):
        log.produce(e.filter(F.col("ts_ms") <= half), f"{path}/log", "ts_ms", commit="first")
    e.filter(F.col("ts_ms") > half).write.parquet(f"{path}/in")
    read = spark.readStream.schema(e.schema).parquet(f"{path}/in")
    read.writeStream.foreachBatch(lambda df, n: log.produce(df, f"{path}/log", "ts_ms", commit=f"rest-{n}")).option("checkpointLocation", f"{path}/c1").trigger(availableNow=True).start().awaitTermination()
    back = spark.readStream.format("log").option("path", f"{path}/log").load()
    back.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c2").trigger(availableNow=True).start().awaitTermination()
    place = F.row_number().over(Window.partitionBy("key").orderBy("partition", "offset")).cast("long")
    return spark.read.parquet(f"{path}/out").select("key", "value", "ts_ms", place.alias("place"))


LOG_SQL = "SELECT 'doc:' || user_id AS key, props AS value, event_id AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events"

def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page that a header names, and whether a text is a project's key, of headers and keys made of events."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    last = F.concat(F.lit("<http://x/?page="), i, F.lit('>; rel="last"'))
    following = F.concat(F.lit("<http://x/?page="), i, F.lit('&k=1>; rel="next"'))
    header = F.when(F.col("event_id") % 3 == 0, last).when(F.col("event_id") % 3 == 1, following).otherwise(F.concat(last, F.lit(", "), following))
    key = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.upper("event_type"), F.lit("-"), i))
    return e.select("event_id", next_link(header).alias("following"), is_project_key(key).alias("is_key"))


LINKS_SQL = "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'http://x/?page=' || event_id || '&k=1' END AS following, event_id % 2 = 0 AS is_key FROM events"


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product and cosine of each vector and the next one, and the length of the first one normalised."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    j = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    a, b = F.col("embedding"), F.col("other")
    return j.select("vec_id", F.round(vectors.dot(a, b), 6).alias("dot"), F.round(vectors.cosine(a, b), 6).alias("cosine"), F.round(vectors.norm(vectors.normalised(a)), 6).alias("length"))


VECTORS_SQL = """SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot,
  round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, 1.0::DOUBLE AS length FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that were written as JSON lines, read back."""
    path = scratch(spark, "results")
    dumps.write_results(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first")), path)
    return spark.read.schema("event_type string, n long, first long").json(path)


RESULTS_SQL = "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type"

QUERIES = {"q_signatures": signatures, "q_deliveries": delivered, "q_log_round_trip": log_round_trip, "q_links": links, "q_vectors": vector_pairs, "q_results": results}
ORACLE_SQL = {"q_signatures": SIGNATURES_SQL, "q_deliveries": DELIVERED_SQL, "q_log_round_trip": LOG_SQL, "q_links": LINKS_SQL, "q_vectors": VECTORS_SQL, "q_results": RESULTS_SQL}
