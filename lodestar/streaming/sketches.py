"""Histograms that merge: each batch of a stream adds its own counts under its number, and what is asked of the whole is a sum of these, without another look at the values.

Two kinds of counts are kept of positive and other values alike: exact ones by the bounds of latency buckets, and counts by powers of GAMMA = (1 + error) / (1 - error), of which any quantile can be told within that relative error (Masson, Rim and Lee, 2019). A batch that is done again replaces what it wrote.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reports import BUCKETS


class Sketches:
    """path: a shared folder. by: the columns that have histograms of their own (text). error: of quantiles, relative."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = (), error: float = 0.01, bounds: list[int] | None = None):
        self.spark, self.path, self.by, self.error = spark, path.rstrip("/"), by, error
        self.gamma, self.bounds = (1 + error) / (1 - error), BUCKETS if bounds is None else bounds
        self.schema = "".join(f"`{c}` string, " for c in by) + "kind string, place long, n long, least double, most double"

    def _place(self, value: Column) -> Column:
        """The power of gamma that covers a value; none for 0, the value's mirrored by size for negative ones (even places: positive, odd: negative, null: 0)."""
        power = F.ceil(F.ln(F.abs(value)) / math.log(self.gamma)).cast("long")
        return F.when(value > 0, 2 * power).when(value < 0, 2 * power + 1)

    def add(self, df: DataFrame, value: str, batch: int) -> None:
        """Counts the values of a batch; nulls don't count."""
        v = df.filter(F.col(value).isNotNull()).select(*[F.col(c).cast("string").alias(c) for c in self.by], F.col(value).cast("double").alias("v"))
        # The first bound that isn't below the value; none beyond the last.
        bound = F.coalesce(*[F.when(F.col("v") <= b, F.lit(b)) for b in self.bounds]).cast("long")
        kinds = F.explode(F.array(F.struct(F.lit("log").alias("kind"), self._place(F.col("v")).alias("place")), F.struct(F.lit("bound").alias("kind"), bound.alias("place"))))
        counts = v.select(*self.by, "v", kinds.alias("x")).groupBy(*self.by, "x.kind", "x.place").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        # A row for each place: few, whatever the batch holds.
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def merged(self) -> DataFrame:
        """(by, kind, place, n, least, most) of all batches."""
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(f"{self.path}/batch=*")
        return rows.groupBy(*self.by, "kind", "place").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))

    def compact(self, upto: int) -> None:
        """Replaces the batches up to one by their sum, under that one's number."""
        rows = self.spark.read.schema(self.schema + ", batch int").option("basePath", self.path).parquet(f"{self.path}/batch=*").filter(F.col("batch") <= upto)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [r.batch for r in rows.select("batch").distinct().collect()]  # numbers of batches since the last time
        total = rows.groupBy(*self.by, "kind", "place").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sum-{upto}")
        for b in old:
            fs.delete(path(f"{self.path}/batch={b}"), True)
        fs.rename(path(f"{self.path}/sum-{upto}"), path(f"{self.path}/batch={upto}"))

    def histogram(self) -> DataFrame:
        """(by, le, n), as reports.histogram gives them: exact."""
        counts = self.merged().filter("kind = 'bound'")
        below = [F.struct(F.lit(b).cast("long").alias("le"), F.coalesce(F.sum(F.when(F.col("place") <= b, F.col("n"))), F.lit(0)).alias("n")) for b in self.bounds]
        below.append(F.struct(F.lit(None).cast("long").alias("le"), F.sum("n").alias("n")))
        return counts.groupBy(*self.by).agg(F.array(*below).alias("h")).select(*self.by, F.explode("h").alias("h")).select(*self.by, "h.le", "h.n")

    def quantiles(self, *qs: float) -> DataFrame:
        """(by, q, value): nearest-rank quantiles within the relative error; never below the least value or above the greatest."""
        power = F.floor(F.col("place") / 2)
        size = F.pow(F.lit(self.gamma), power) * 2 / (self.gamma + 1)
        about = F.when(F.col("place").isNull(), 0.0).when(F.col("place") % 2 == 0, size).otherwise(-size)
        counts = self.merged().filter("kind = 'log'").withColumn("about", F.greatest(F.col("least"), F.least(F.col("most"), about)))
        # Places of one histogram: some thousands at most, as powers.
        over = Window.partitionBy(*self.by).orderBy("about")
        ranked = counts.withColumn("upto", F.sum("n").over(over)).withColumn("all", F.sum("n").over(Window.partitionBy(*self.by)))
        asked = ranked.select(*self.by, "about", "upto", "n", "all", F.explode(F.array(*[F.lit(q) for q in qs])).alias("q"))
        rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("all")))
        return asked.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(*self.by, "q", F.col("about").alias("value"))
