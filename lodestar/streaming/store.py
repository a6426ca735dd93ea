"""Tables that a stream folds into: a base and one delta for each batch, as plain parquet.

A batch writes its changed rows under its own number, overwriting what an earlier try left, so doing a batch again changes nothing. Readers take the newest row of each key; compaction writes a new base once there are many deltas, and only a pointer, written last, makes it the one that is read. Rows lie in buckets by the hash of their key, so a batch reads only the buckets that it touches. Their number is a power of two times the first one and follows the rows: a new base that would hold more than ROWS in a bucket gets twice as many, as often as need be, and large buckets are written by several tasks.

The schema has a log of its own: what is new in a declared schema is added as a version before anything is written with it, older files read with nulls there; another type, another key or fewer columns are refused.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a bucket, on average, before a new base has more buckets; and those that one task writes.
ROWS, TASK = 20_000, 1_000_000


class SchemaChange(ValueError):
    """A declared schema that isn't the written one with columns added."""


class Table:
    """A keyed table below a folder that all executors reach. by: the columns whose hash gives the bucket, by default the keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, compact_after: int = 32, buckets: int = 64, by: list[str] | None = None):
        self.spark, self.path, self.keys, self.compact_after, self.buckets, self.by = spark, path.rstrip("/"), keys, compact_after, buckets, by or keys
        #: What compaction keeps; all, if None.
        self.keep: Column | None = None
        self.schema = spark.createDataFrame([], schema).schema
        self._checked = False

    def _text(self, name: str) -> str:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """A small file, under another name first."""
        fs, path = self._fs()
        aside = path(f"{self.path}/{name}.aside")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(aside, path(f"{self.path}/{name}")):
            raise OSError(f"{self.path}/{name} is there already")

    def versions(self) -> list[StructType]:
        """The schemas that the table has had, the first one first."""
        fs, path = self._fs()
        top = path(f"{self.path}/schemas")
        names = sorted((s.getPath().getName() for s in fs.listStatus(top)), key=lambda n: (len(n), n)) if fs.exists(top) else []
        return [StructType.fromJson(json.loads(self._text(f"schemas/{n}"))) for n in names if n.isdigit()]

    def check(self) -> None:
        """Holds the declared schema against the written one, and adds it to the log if it has more columns."""
        if self._checked:
            return
        done = self.versions()
        if done:
            old, new = ({f.name: f.dataType for f in x.fields} for x in (done[-1], self.schema))
            wrong = [f"{c}: {t.simpleString()} became {new[c].simpleString()}" for c, t in old.items() if c in new and new[c] != t]
            wrong += [f"{c} is missing" for c in old if c not in new]
            wrong += [f"{c} can't be added to the key" for c in self.keys if c not in old]
            if wrong:
                raise SchemaChange(f"{self.path}: {'; '.join(wrong)}")
        if not done or [f.name for f in done[-1].fields] != self.schema.names and {f.name for f in done[-1].fields} != set(self.schema.names):
            self._put(f"schemas/{len(done)}", self.schema.json())
        self._checked = True

    def _count(self, base: int) -> int:
        """How many buckets a base and the deltas after it have."""
        fs, path = self._fs()
        name = f"buckets/{base}"
        return int(self._text(name)) if base >= 0 and fs.exists(path(f"{self.path}/{name}")) else self.buckets

    def _base(self, before: int | None = None) -> int:
        return max((b for b in self._batches("base") if before is None or b < before), default=-1)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(n)).cast("int")

    def touched(self, rows: DataFrame, before: int | None = None) -> list[int]:
        """The buckets of rows that have this table's columns by, as read() of the same time takes them: as many as rows at the most."""
        return sorted(r.b for r in rows.select(self._bucket(self._count(self._base(before))).alias("b")).distinct().collect())

    def _folder(self, kind: str, batch: int) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(f"{self.path}/{kind}/{batch}")

    def _write(self, rows: DataFrame, kind: str, batch: int, buckets: int, parts: int = 1) -> None:
        """parts: among how many tasks the rows of a bucket are dealt."""
        part = F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(parts))
        rows.select(*self.schema.names, self._bucket(buckets).alias("_bucket")).repartition("_bucket", part).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{kind}/{batch}")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _batches(self, kind: str) -> list[int]:
        """The numbers of complete folders of a kind."""
        fs, path = self._fs()
        top = path(f"{self.path}/{kind}")
        if not fs.exists(top):
            return []
        names = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(path(f"{p.toString()}/_SUCCESS")))

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows as of just before a batch, or now; None if there are none yet. buckets: of these only (of touched())."""
        base = self._base(before)
        deltas = [b for b in self._batches("delta") if b > base and (before is None or b < before)]
        parts = [self._folder("base", base).withColumn("_batch", F.lit(base))] if base >= 0 else []
        parts += [self._folder("delta", b).withColumn("_batch", F.lit(b)) for b in deltas]
        if not parts:
            return None
        parts = [(p if buckets is None else p.filter(F.col("_bucket").isin(buckets))).drop("_bucket") for p in parts]
        if len(parts) == 1:
            return parts[0].drop("_batch")
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
        return newest.select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*self.schema.names)

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """Writes the changed rows of a batch, one for each key, and compacts now and then."""
        self.check()
        # A batch that is done again has the base that it had.
        base = self._base(batch)
        self._write(changed, "delta", batch, self._count(base))
        if batch not in self._batches("base") and len([b for b in self._batches("delta") if b > base]) >= self.compact_after:
            self.compact(batch)

    def delta(self, batch: int) -> DataFrame:
        """What a batch changed."""
        return self._folder("delta", batch).drop("_bucket")

    def compact(self, batch: int) -> None:
        """A new base that holds all up to batch. Older folders stay for readers that began before; vacuum() removes them."""
        self.check()
        now = self.read()
        if now is None:
            return
        now = now if self.keep is None else now.filter(self.keep)
        n, buckets = now.count(), self._count(self._base(batch))
        while n > ROWS * buckets:
            buckets *= 2
        fs, path = self._fs()
        if fs.exists(path(f"{self.path}/buckets/{batch}")):
            fs.delete(path(f"{self.path}/buckets/{batch}"), False)
        self._put(f"buckets/{batch}", str(buckets))
        self._write(now, "base", batch, buckets, max(1, -(-n // (TASK * buckets))))

    def vacuum(self) -> None:
        """Removes what the newest base replaces."""
        fs, path = self._fs()
        bases = self._batches("base")
        if bases:
            for kind, numbers in (("base", bases[:-1]), ("delta", [b for b in self._batches("delta") if b <= bases[-1]])):
                for b in numbers:
                    fs.delete(path(f"{self.path}/{kind}/{b}"), True)
