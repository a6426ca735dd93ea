"""The permission graph: edges by newest version, and the principals that each one holds through it.

Users are only ever roots, so walks start from the groups: what a group reaches is found once, whatever the number of its members, and each user then needs one join. Every round of a walk is a join on the frontier alone, ends in a written table, and stops when nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CONTAINER, EVERYONE, GROUP, USER
from ..session import counted, cut

#: Steps from a user: containers may lie this far, other principals beyond it are an error.
MOST_STEPS = 8


class TooDeep(ValueError):
    """Groups nest beyond MOST_STEPS."""


def latest(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(src, dst, present, version, src_ts_ms) of each edge by its newest version; of equal ones the first wins, removed edges stay with theirs. events: also off."""
    e = events.select("src", "dst", "present", "version", "src_ts_ms", "off")
    if state is not None:
        e = e.unionByName(state.select("src", "dst", "present", "version", "src_ts_ms", F.lit(-1).cast("long").alias("off")))
    best = F.max_by(F.struct("present", "version", "src_ts_ms"), F.struct("version", -F.col("off")))
    return e.groupBy("src", "dst").agg(best.alias("e")).select("src", "dst", "e.present", "e.version", "e.src_ts_ms")


def applied(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """events with applied: whether each is newer than all before it of its edge."""
    e = events
    if state is not None:
        e = e.join(state.select("src", "dst", F.col("version").alias("stored")), ["src", "dst"], "left")
    before = Window.partitionBy("src", "dst").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("version").over(before)
    top = top if state is None else F.greatest(top, F.col("stored"))
    return e.withColumn("applied", top.isNull() | (F.col("version") > top)).drop("stored")


def epoch(events: DataFrame, state: DataFrame | None = None, start: int = 0) -> DataFrame:
    """(epoch): start and one more for each applied change."""
    return applied(events, state).agg((F.lit(start) + F.count_if("applied")).cast("long").alias("epoch"))


def reach(edges: DataFrame, roots: DataFrame, steps: int = MOST_STEPS, leaves: bool = True) -> DataFrame:
    """(root, principal, depth, path) reachable from each of roots (root) over present edges in at most steps + 1 steps; containers are leaves.

    A path is the shortest, the least of equals. leaves: whether containers end a walk. Only edges that begin at a root or where another one ends are read in each round: none of users, who are many.
    """
    e = edges.filter("present").select("src", "dst")
    starts = e.select(F.col("dst").alias("src")).union(roots.select(F.col("root").alias("src"))).distinct()
    e = cut(e.join(starts, "src", "left_semi"), "inner")
    seen = cut(roots.select("root").distinct().select("root", F.col("root").alias("principal"), F.lit(0).alias("depth"), F.array("root").alias("path")), "reach")
    frontier = seen
    for depth in range(1, steps + 2):
        at = frontier.filter(~F.col("principal").startswith(CONTAINER)) if leaves else frontier
        new = at.join(e, at.principal == e.src).groupBy("root", "dst").agg(F.min("path").alias("path"))
        new = new.join(seen.select("root", F.col("principal").alias("dst")), ["root", "dst"], "left_anti")
        frontier, n = counted(new.select("root", F.col("dst").alias("principal"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path")), "frontier")
        if not n:
            return seen
        seen = seen.unionByName(frontier)
    return seen


def _to_all(users: DataFrame, rows: DataFrame, salts: int = 64) -> DataFrame:
    """Each of rows with each user: what everyone holds. Users are dealt out by salt and rows copied to each salt, so that no task has all users: never broadcast, as the few rows then lie in one task."""
    u = users.withColumn("_salt", F.pmod(F.xxhash64("user"), F.lit(salts))).hint("merge")
    return u.join(rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), "_salt").drop("_salt")


def expand(edges: DataFrame, users: DataFrame, steps: int = MOST_STEPS, strict: bool = True) -> DataFrame:
    """(user, principal, depth, path): all that each of users (user, with its prefix) holds, itself and everyone's group included.

    The path is the shortest; of equals one from the user before one from everyone's group, then the least. strict: raise TooDeep if a group lies beyond steps; deeper principals are left out.
    """
    present = edges.filter("present").select("src", "dst")
    users = users.select("user").distinct()
    direct = cut(users.join(present, users.user == present.src).select("user", F.col("dst").alias("held")), "direct")
    roots = direct.filter(F.col("held").startswith(GROUP)).select(F.col("held").alias("root")).distinct().union(edges.sparkSession.createDataFrame([(EVERYONE,)], "root string"))
    groups = reach(edges, roots, steps)  # written, round by round
    own = users.select("user", F.lit(0).alias("order"), F.col("user").alias("principal"), F.lit(0).alias("depth"), F.array("user").alias("path"))
    leaf = direct.filter(~F.col("held").startswith(GROUP)).select("user", F.lit(0).alias("order"), F.col("held").alias("principal"), F.lit(1).alias("depth"), F.array("user", "held").alias("path"))
    through = direct.join(groups, direct.held == groups.root).select("user", F.lit(0).alias("order"), "principal", (F.col("depth") + 1).alias("depth"), F.concat(F.array("user"), F.col("path")).alias("path"))
    everyone = _to_all(users, groups.filter(F.col("root") == EVERYONE)).select("user", F.lit(1).alias("order"), "principal", "depth", "path")
    both = own.unionByName(leaf).unionByName(through).unionByName(everyone)
    best = both.groupBy("user", "principal").agg(F.min(F.struct("depth", "order", "path")).alias("m")).select("user", "principal", "m.depth", "m.path")
    # Only what lies deep below some group can lie deep below a user: mostly nothing, and then users aren't asked.
    deep = (F.col("depth") + 1 > steps) & ~F.col("principal").startswith(CONTAINER)
    if strict and not groups.filter(deep).isEmpty() and not best.filter((F.col("depth") > steps) & ~F.col("principal").startswith(CONTAINER)).isEmpty():
        raise TooDeep(f"groups nest deeper than {steps} steps")
    return best.filter(F.col("depth") <= steps)


def truth(edges: DataFrame, users: DataFrame, most: int = 64) -> DataFrame:
    """(user, principal) by the plain closure: no cap on steps but most, no special kinds. Held against expand. What a user's own targets reach is found once for each target, whatever the number of its members."""
    present = edges.filter("present").select("src", "dst")
    users = users.select("user").distinct()
    direct = cut(users.join(present, users.user == present.src).select("user", F.col("dst").alias("root")), "direct")
    everyone = edges.sparkSession.createDataFrame([(EVERYONE,)], "root string")
    reached = reach(edges, direct.select("root").union(everyone), most, leaves=False)
    mine = direct.join(reached, "root").select("user", "principal")
    every = _to_all(users, reached.filter(F.col("root") == EVERYONE)).select("user", "principal")
    return users.select("user", F.col("user").alias("principal")).union(mine).union(every).distinct()


def held(expansion: DataFrame) -> DataFrame:
    """(user, principals): sorted sets."""
    return expansion.groupBy("user").agg(F.array_sort(F.collect_set("principal")).alias("principals"))


def path_to(expansion: DataFrame, user: str, principal: str) -> DataFrame:
    """The path from user to principal; no row if it isn't held."""
    return expansion.filter((F.col("user") == user) & (F.col("principal") == principal)).select("path")


def can_see(allowed: Column, principals: Column) -> Column:
    return F.coalesce(F.arrays_overlap(allowed, principals), F.lit(False))


def grants(edges: DataFrame) -> DataFrame:
    """(container, holders): the sorted sources other than users of the present edges to each container."""
    e = edges.filter(F.col("present") & F.col("dst").startswith(CONTAINER) & ~F.col("src").startswith(USER))
    return e.groupBy(F.col("dst").alias("container")).agg(F.array_sort(F.collect_set("src")).alias("holders"))


def direct_groups(edges: DataFrame) -> DataFrame:
    """(user, groups): the sorted groups that each user is a member of."""
    e = edges.filter(F.col("present") & F.col("src").startswith(USER) & F.col("dst").startswith(GROUP))
    return e.groupBy(F.col("src").alias("user")).agg(F.array_sort(F.collect_set("dst")).alias("groups"))


def reconcile(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, present): the changes that make the present user edges of wanted's targets equal to wanted (src, dst)."""
    targets = wanted.select("dst").distinct()
    have = edges.filter(F.col("present") & F.col("src").startswith(USER)).join(targets, "dst", "left_semi").select("src", "dst", F.lit(True).alias("h"))
    want = wanted.filter(F.col("src").isNotNull()).select("src", "dst").distinct().withColumn("w", F.lit(True))
    return want.join(have, ["src", "dst"], "full_outer").filter("w is null or h is null").select("src", "dst", F.col("w").isNotNull().alias("present"))


def versioned(changes: DataFrame, last: int, now_ns: int) -> DataFrame:
    """changes (src, dst, present) with versions above last and at least now, each its own, and published = false."""
    start = max(now_ns, last + 1)
    # Spark's own index of rows: dense within partitions, increasing, never equal.
    return changes.withColumn("version", F.lit(start).cast("long") + F.monotonically_increasing_id()).withColumn("published", F.lit(False))


def pending(edges: DataFrame, most: int = 5000) -> DataFrame:
    """The oldest edges that still wait to be published."""
    return edges.filter(~F.col("published")).orderBy("version", "src", "dst").limit(most)


def published(edges: DataFrame, sent: DataFrame) -> DataFrame:
    """edges with published set for exactly the versions in sent (src, dst, version)."""
    done = sent.select("src", "dst", "version", F.lit(True).alias("done")).distinct()
    return edges.join(done, ["src", "dst", "version"], "left").withColumn("published", F.col("published") | F.col("done").isNotNull()).drop("done").select(*edges.columns)
