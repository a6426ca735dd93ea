"""Counters that are sampled now and then and begin anew when their process does: increments, rates over a range of time, and the greatest rate of a span.

samples: series columns, t_ms and value, one row for each look at a counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A gap at an end of the range counts as covered if it is shorter than so many times the mean gap between samples (fixed value of the usual rule).
COVERED = 1.1


def increments(samples: DataFrame, *series: str) -> DataFrame:
    """samples with inc: how much was counted since the sample before; a smaller value than before means a new start, so all of it is new. Null for a series' first sample."""
    before = F.lag("value").over(Window.partitionBy(*series).orderBy("t_ms"))
    return samples.withColumn("inc", F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def increase(samples: DataFrame, *series: str) -> DataFrame:
    """(series, total): what each series has counted in all since its first sample, whatever its restarts."""
    return increments(samples, *series).groupBy(*series).agg(F.coalesce(F.sum("inc"), F.lit(0)).alias("total"))


def rates(samples: DataFrame, *series: str, range_ms: int, step_ms: int) -> DataFrame:
    """(series, at_ms, rate): a second's mean growth in the range before each step (its end included, its beginning not), for ranges with two samples at least.

    Growth between the first and last sample of a range is extended to its ends: by the gap there if that is about as short as those between samples, else by half of a mean gap; never to before the counter would have been 0.
    """
    if range_ms % step_ms:
        raise ValueError("the range isn't a multiple of the step")
    step = F.ceil(F.col("t_ms") / step_ms)
    # Each sample lies in so many ranges; only sums, firsts and lasts of them are kept, summed up before any shuffle.
    wide = increments(samples, *series).withColumn("step", F.explode(F.sequence(step, step + (range_ms // step_ms - 1))))
    first = F.min_by(F.struct("t_ms", "value", F.coalesce("inc", F.lit(0)).alias("inc")), "t_ms")
    parts = wide.groupBy(*series, "step").agg(first.alias("first"), F.max("t_ms").alias("last"), F.sum("inc").alias("inc"), F.count("*").alias("n")).filter("n > 1")
    grown = (F.coalesce("inc", F.lit(0)) - F.col("first.inc")).cast("double")
    at = F.col("step") * step_ms
    width = (F.col("last") - F.col("first.t_ms")).cast("double")
    mean = width / (F.col("n") - 1)
    ahead, behind = (F.col("first.t_ms") - (at - range_ms)).cast("double"), (at - F.col("last")).cast("double")
    ahead = F.when(ahead >= mean * COVERED, mean / 2).otherwise(ahead)
    behind = F.when(behind >= mean * COVERED, mean / 2).otherwise(behind)
    ahead = F.when(grown > 0, F.least(ahead, width * (F.col("first.value") / grown))).otherwise(ahead)
    rate = grown * (width + ahead + behind) / width / F.lit(range_ms / 1000)
    return parts.select(*series, at.cast("long").alias("at_ms"), rate.alias("rate"))


def summed(rates_: DataFrame, *by: str) -> DataFrame:
    """(by, at_ms, rate): the sum of all series' rates at each step."""
    return rates_.groupBy(*by, "at_ms").agg(F.sum("rate").alias("rate"))


def peak(rates_: DataFrame, *by: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """(by, peak): the greatest summed rate of the steps from from_ms (not included) to to_ms."""
    own = rates_
    if from_ms is not None:
        own = own.filter(F.col("at_ms") > from_ms)
    if to_ms is not None:
        own = own.filter(F.col("at_ms") <= to_ms)
    return summed(own, *by).groupBy(*by).agg(F.max("rate").alias("peak"))
