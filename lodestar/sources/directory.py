"""The directory of users, groups, containers and edges, and a made-up workspace to try things on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import base36, title_case

USERS = "id string, name string, email string"
CONTAINERS = "id string, datasource string, name string, visibility string"


def find_users(users: DataFrame, text: str = "", most: int = 5000) -> DataFrame:
    """Users whose id, name or address holds a text, letters in either case, by id."""
    q = F.lit(text.lower())
    hit = F.contains(F.lower("id"), q) | F.contains(F.lower("name"), q) | F.contains(F.lower("email"), q)
    return (users.filter(hit) if text else users).orderBy("id").limit(most)


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.lower("email") == email.lower())


def find_edges(edges: DataFrame, src: str = "", dst: str = "", most: int = 10_000) -> DataFrame:
    """Edges from and to given ends; an empty end is any."""
    e = edges.filter(F.col("src") == src) if src else edges
    return (e.filter(F.col("dst") == dst) if dst else e).orderBy("src", "dst").limit(most)


def groups(edges: DataFrame) -> DataFrame:
    """(kind, id) of all groups, sorted."""
    both = edges.select(F.col("src").alias("p")).union(edges.select("dst")).filter(F.col("p").startswith("g:")).distinct()
    return both.select(F.when(F.col("p").startswith("g:org-"), "org").otherwise("team").alias("kind"), F.col("p").alias("id")).orderBy("kind", "id")


def _pick(options: list[str], *seeds: Column | int) -> Column:
    """One of options, by the seeds' hash."""
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(F.xxhash64(*[s if isinstance(s, Column) else F.lit(s) for s in seeds]), F.lit(len(options))) + 1).cast("int"))


def company(spark: SparkSession, n_users: int, teams: list[str], orgs: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(users, edges) of a made-up company: every team in an organisation, every user in a team, three in ten in a second one."""
    first, last = ["ada", "ben", "cleo", "dan", "eva", "finn", "gia", "hugo"], ["adams", "brook", "chen", "diaz", "evans", "fox", "grant", "hale"]
    u = spark.range(1, n_users + 1).withColumn("f", _pick(first, F.col("id"), seed)).withColumn("l", _pick(last, F.col("id"), seed + 1))
    users = u.select(F.concat("f", F.lit("-"), base36(F.col("id"))).alias("uid"), F.concat_ws(" ", title_case(F.col("f")), title_case(F.col("l"))).alias("name"), F.col("id").alias("n"))
    users = users.withColumn("email", F.concat("uid", F.lit("@example.org")))
    main, second = _pick(teams, F.col("n"), seed + 2), _pick(teams, F.col("n"), seed + 3)
    two = F.when(F.pmod(F.xxhash64("n", F.lit(seed + 4)), F.lit(10)) < 3, F.array_distinct(F.array(main, second))).otherwise(F.array(main))
    member = users.select(F.concat(F.lit("u:"), "uid").alias("src"), F.explode(two).alias("t")).select("src", F.concat(F.lit("g:"), "t").alias("dst"))
    nest = spark.createDataFrame([(f"g:{t}", f"g:org-{orgs[i % len(orgs)]}") for i, t in enumerate(teams)], "src string, dst string")
    edges = member.unionByName(nest).select("src", "dst", F.lit(True).alias("present"), F.lit(1).cast("long").alias("version"))
    return users.select(F.col("uid").alias("id"), "name", "email"), edges


def workspace(spark: SparkSession, channels: int, messages: int, start_ms: int, days: int = 120, seed: int = 42) -> DataFrame:
    """Messages (channel, user, text, ts, thread_ts) of a made-up chat: times spread over days, three in ten answer an earlier message."""
    what, where = ["deploy", "rollback", "incident", "review", "migration", "alert"], ["api", "billing", "search", "mobile", "ingest", "auth"]
    m = spark.range(messages)
    h = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(days * 86_400_000))
    ms = F.lit(start_ms) + h
    ts = F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad(F.pmod(F.col("id"), F.lit(1_000_000)).cast("string"), 6, "0"))
    m = m.withColumn("ts", ts).withColumn("channel", F.concat(F.lit("C"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(channels)).cast("string")))
    text = F.concat_ws(" ", _pick(what, F.col("id"), seed + 2), F.lit("of"), _pick(where, F.col("id"), seed + 3), F.lit("#"), F.pmod(F.col("id"), F.lit(997)).cast("string"))
    m = m.withColumn("text", text).withColumn("user", F.concat(F.lit("U"), F.pmod(F.xxhash64("id", F.lit(seed + 4)), F.lit(200)).cast("string")))
    reply = F.pmod(F.xxhash64("id", F.lit(seed + 5)), F.lit(10)) < 3
    earlier = F.concat((F.floor(ms / 1000) - 60).cast("string"), F.lit(".000000"))
    return m.select("channel", "user", "text", "ts", F.when(reply, earlier).alias("thread_ts"))


def chaos(events: DataFrame, seed: int = 42, duplicate: float = 0.1, swap: float = 0.1) -> DataFrame:
    """events (id, version, ...) with off: each document's events in order, but for neighbours that swap, and some sent twice; documents interleave. The same for the same seed."""
    from pyspark.sql import Window

    def share(*salt):
        return F.pmod(F.xxhash64("id", "version", *[F.lit(s) for s in salt]), F.lit(1_000_000)) / 1_000_000

    w = Window.partitionBy("id").orderBy("version")
    e = events.withColumn("_swap", share(seed) < swap).withColumn("_place", F.row_number().over(w).cast("double"))
    # A version that swaps goes just behind the next one, unless that one swaps too.
    e = e.withColumn("_place", F.when(F.col("_swap") & ~F.coalesce(F.lead("_swap").over(w), F.lit(True)), F.col("_place") + 1.5).otherwise(F.col("_place")))
    e = e.withColumn("_copy", F.explode(F.when(share(seed + 1) < duplicate, F.array(F.lit(0.0), F.lit(0.1))).otherwise(F.array(F.lit(0.0)))))
    # A document's own order is kept: what interleaves is only where its whole sequence starts.
    lane = F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1_000_000))
    off = (F.row_number().over(Window.partitionBy("id").orderBy(F.col("_place") + F.col("_copy"), "version")) * 1_000_000 + lane).cast("long")
    return e.withColumn("off", off).drop("_swap", "_place", "_copy")
