"""Expansions that are kept: what each group and user holds, brought up to date by batches of changed edges.

A batch that adds or removes edges can change only the expansions of groups that reach the source of such an edge, before or after, and of these groups' members. Those are found by walking up from the sources, deleted, and derived again: within the affected groups by a walk of their own, beyond them from what is kept of the others (a group that isn't affected can't lead back to one that is). Everything else stays as it is written, and isn't read: rows lie in buckets by group or user.

What everyone's group holds is joined where expansions are read, not written for each user. Each batch is a delta under its number, so expansions can be had as of any batch that isn't vacuumed yet, and a batch done again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONTAINER, EVERYONE, GROUP, USER
from ..session import counted, cut
from ..streaming.store import Table
from .graph import MOST_STEPS, TooDeep, _to_all, reach

_HELD = "{} string, principal string, depth int, path array<string>, present boolean"


class Closure:
    """path: a shared folder for edges by source and by target, and for what groups and users hold."""

    def __init__(self, spark: SparkSession, path: str, steps: int = MOST_STEPS, buckets: int = 64):
        self.spark, self.steps = spark, steps
        path = path.rstrip("/")
        edge = "src string, dst string, present boolean"
        self.out = Table(spark, f"{path}/out", ["src", "dst"], edge, buckets=buckets, by=["src"])
        self.into = Table(spark, f"{path}/into", ["src", "dst"], edge, buckets=buckets, by=["dst"])
        self.groups = Table(spark, f"{path}/groups", ["root", "principal"], _HELD.format("root"), buckets=buckets, by=["root"])
        self.users = Table(spark, f"{path}/users", ["user", "principal"], _HELD.format("user"), buckets=buckets, by=["user"])

    def _near(self, table: Table, column: str, keys: DataFrame, before: int) -> DataFrame:
        """The present rows of table in the buckets of keys (key), others that lie there too: for those who join them by column anyway."""
        if table.read(before) is None:
            return self._none(table).drop("present")
        return table.read(before, table.touched(keys.select(F.col("key").alias(column)), before)).filter("present").drop("present")

    def _of(self, table: Table, column: str, keys: DataFrame, before: int) -> DataFrame:
        """The present rows of table whose column is among keys (key): of the keys' buckets alone."""
        return self._near(table, column, keys, before).join(keys.select(F.col("key").alias(column)), column, "left_semi")

    def _none(self, table: Table) -> DataFrame:
        """No rows, which plans see, so that they leave out what would be joined with them."""
        return self.spark.sql("SELECT 1 WHERE false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])

    def _edges(self, table: Table, column: str, keys: DataFrame, flips: DataFrame, before: int, both: bool = False) -> DataFrame:
        """(src, dst) of the edges at keys after flips (src, dst, present); both: before or after. What flips to present wasn't, so no edge comes twice."""
        old = self._near(table, column, keys, before)
        old = old if both else old.join(flips.filter("not present"), ["src", "dst"], "left_anti")
        now = old.select("src", "dst").unionByName(flips.filter("present").select("src", "dst"))
        return now.join(keys.select(F.col("key").alias(column)), column, "left_semi").select("src", "dst")

    def apply(self, changes: DataFrame, batch: int) -> dict[str, int]:
        """Takes over the edges (src, dst, present) that a batch changed, newest state each; how many groups and users were derived again. Batches have rising numbers."""
        changes = cut(changes.select("src", "dst", "present"), "changes")
        stored = self._near(self.out, "src", changes.select(F.col("src").alias("key")), batch).withColumn("was", F.lit(True))
        flips = changes.join(stored, ["src", "dst"], "left")
        flips, n = counted(flips.filter(F.col("present") != F.coalesce("was", F.lit(False))).drop("was"), "flips")
        done = {"groups": 0, "users": 0}
        if n:
            affected, done["groups"] = self._affected(flips, batch)
            if done["groups"]:
                self._groups(affected, flips, batch)
            else:
                self.groups.upsert(self._none(self.groups), batch)
            done["users"] = self._members(affected if done["groups"] else None, flips, batch)
        self.out.upsert(flips, batch)
        self.into.upsert(flips, batch)
        return done

    def _affected(self, flips: DataFrame, batch: int) -> tuple[DataFrame, int]:
        """(key) and how many: the groups that reach a flipped edge's source."""
        found, n = counted(flips.select(F.col("src").alias("key")).filter(F.col("key").startswith(GROUP)).distinct(), "affected")
        frontier, many = found, n
        while n:
            up = self._edges(self.into, "dst", frontier, flips, batch, both=True).select(F.col("src").alias("key")).filter(F.col("key").startswith(GROUP)).distinct()
            frontier, n = counted(up.join(found, "key", "left_anti"), "affected")
            found, many = found.unionByName(frontier), many + n
        return cut(found, "affected") if many else found, many

    def _store(self, table: Table, name: str, new: DataFrame, keys: DataFrame, batch: int) -> None:
        """Writes what differs from the kept rows of keys."""
        old = self._of(table, name, keys, batch).select(name, "principal", F.struct("depth", "path").alias("old"))
        both = new.select(name, "principal", F.struct("depth", "path").alias("new")).join(old, [name, "principal"], "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
        row = F.coalesce("new", "old")
        table.upsert(both.select(name, "principal", row["depth"].alias("depth"), row["path"].alias("path"), F.col("new").isNotNull().alias("present")), batch)

    def _groups(self, affected: DataFrame, flips: DataFrame, batch: int) -> None:
        edges = cut(self._edges(self.out, "src", affected, flips, batch), "edges")
        target = affected.select(F.col("key").alias("dst"))
        inner = edges.join(target, "dst", "left_semi").withColumn("present", F.lit(True))
        inside = reach(inner, affected.select(F.col("key").alias("root")), self.steps)
        outer = cut(edges.join(target, "dst", "left_anti"), "outer")
        kept = self._near(self.groups, "root", outer.select(F.col("dst").alias("key")), batch).withColumnRenamed("root", "dst")
        direct = outer.select("src", F.col("dst").alias("principal"), F.lit(1).alias("depth"), F.array("dst").alias("rest"))
        exits = direct.unionByName(outer.join(kept, "dst").select("src", "principal", (F.col("depth") + 1).alias("depth"), F.col("path").alias("rest")))
        through = inside.withColumnRenamed("principal", "src").withColumnRenamed("depth", "before").join(exits, "src").select("root", "principal", (F.col("before") + F.col("depth")).alias("depth"), F.concat("path", "rest").alias("path"))
        new = inside.select("root", "principal", "depth", "path").unionByName(through).filter(F.col("depth") <= self.steps + 1)
        self._store(self.groups, "root", _least(new, "root"), affected, batch)

    def _members(self, affected: DataFrame | None, flips: DataFrame, batch: int) -> int:
        """affected: None for no groups."""
        own = flips.select(F.col("src").alias("key"))
        if affected is not None:
            own = own.union(self._edges(self.into, "dst", affected, flips, batch, both=True).select(F.col("src").alias("key")))
        users, n = counted(own.filter(F.col("key").startswith(USER)).distinct(), "users")
        if n:
            edges = cut(self._edges(self.out, "src", users, flips, batch), "edges")
            kept = self._near(self.groups, "root", edges.select(F.col("dst").alias("key")), batch + 1).withColumnRenamed("root", "dst")
            direct = edges.select(F.col("src").alias("user"), F.col("dst").alias("principal"), F.lit(1).alias("depth"), F.array("src", "dst").alias("path"))
            through = edges.join(kept, "dst").select(F.col("src").alias("user"), "principal", (F.col("depth") + 1).alias("depth"), F.concat(F.array("src"), F.col("path")).alias("path"))
            self._store(self.users, "user", _least(direct.unionByName(through), "user"), users, batch)
        else:
            self.users.upsert(self._none(self.users), batch)
        return n

    def expansion(self, users: DataFrame, batch: int | None = None, strict: bool = True) -> DataFrame:
        """(user, principal, depth, path) of users (user), as graph.expand gives them; as of a batch, by default the last."""
        before = (1 << 62) if batch is None else batch + 1
        users = cut(users.select("user").distinct(), "users")
        mine = self._of(self.users, "user", users.select(F.col("user").alias("key")), before).select("user", "principal", "depth", "path").filter(F.col("principal") != F.col("user"))
        own = users.select("user", F.col("user").alias("principal"), F.lit(0).alias("depth"), F.array("user").alias("path"))
        mine = cut(own.unionByName(mine), "mine")
        root = self.spark.sql("SELECT '" + EVERYONE + "' AS key")
        all_ = self._of(self.groups, "root", root, before).select("principal", "depth", "path").filter(F.col("principal") != EVERYONE)
        all_ = cut(all_.unionByName(root.select(F.col("key").alias("principal"), F.lit(0).alias("depth"), F.array("key").alias("path"))), "everyone")
        # What a user holds already, of what everyone does, is one row a user; so the rows of users and what everyone holds needn't be brought together again.
        both = mine.join(all_.select("principal", F.struct("depth", "path").alias("every")), "principal", "left")
        nearer = F.coalesce(F.col("every.depth") < F.col("depth"), F.lit(False))
        first = both.select("user", "principal", *[F.when(nearer, F.col(f"every.{c}")).otherwise(F.col(c)).alias(c) for c in ("depth", "path")])
        has = both.filter("every is not null").groupBy("user").agg(F.collect_set("principal").alias("has"))
        rest = _to_all(users.join(has, "user", "left"), all_).filter(~F.coalesce(F.array_contains("has", F.col("principal")), F.lit(False))).select("user", "principal", "depth", "path")
        best = first.unionByName(rest)
        # Only what lies deep below some group can lie deep below a user: mostly nothing, and then users aren't asked.
        deep = ~F.col("principal").startswith(CONTAINER)
        groups = self.groups.read(before) if strict else None
        if groups is not None and not groups.filter(F.col("present") & (F.col("depth") + 1 > self.steps) & deep).isEmpty() and not best.filter((F.col("depth") > self.steps) & deep).isEmpty():
            raise TooDeep(f"groups nest deeper than {self.steps} steps")
        return best.filter(F.col("depth") <= self.steps)


def _least(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name, "principal").agg(F.min(F.struct("depth", "path")).alias("m")).select(name, "principal", "m.depth", "m.path")
