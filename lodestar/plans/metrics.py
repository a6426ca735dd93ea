"""Queries on sampled counters and on histograms that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_ms
from ..operators import counters
from ..session import scratch, table
from ..streaming.sketches import Sketches

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of events by type, looked at in the minutes in which they have grown; each begins anew every day."""
    t = F.ceil(epoch_ms(F.col("ts")) / MINUTE) * MINUTE
    ticks = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), t.cast("long").alias("t_ms")).agg(F.count("*").alias("n"))
    day = Window.partitionBy("series", F.floor(F.col("t_ms") / DAY)).orderBy("t_ms")
    return ticks.select("series", "t_ms", F.sum("n").over(day).alias("value"))


COUNTED = f"""
ticks AS (SELECT event_type AS series, (epoch_us(ts) // 1000 + {MINUTE - 1}) // {MINUTE} * {MINUTE} AS t_ms, count(*) AS n FROM events GROUP BY 1, 2),
samples AS (SELECT series, t_ms, CAST(sum(n) OVER (PARTITION BY series, t_ms // {DAY} ORDER BY t_ms) AS BIGINT) AS value FROM ticks),
inc AS (SELECT *, CASE WHEN value < b THEN value ELSE value - b END AS inc FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY t_ms) AS b FROM samples))"""


def increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.increase(counted(spark, sf_dir), "series")


INCREASES_SQL = "WITH" + COUNTED + " SELECT series, CAST(coalesce(sum(inc), 0) AS BIGINT) AS total FROM inc GROUP BY series"


def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summed rates of all counters over two hours, every ten minutes."""
    r = counters.rates(counted(spark, sf_dir), "series", range_ms=2 * HOUR, step_ms=10 * MINUTE)
    return counters.summed(r).select("at_ms", F.round("rate", 9).alias("rate"))


RATES = (
    "WITH"
    + COUNTED
    + f""",
wide AS (SELECT i.*, ((t_ms + {10 * MINUTE - 1}) // {10 * MINUTE} + o) * {10 * MINUTE} AS at_ms FROM inc i, range(12) r(o)),
parts AS (
  SELECT series, at_ms, min(t_ms) AS first_t, max(t_ms) AS last_t, count(*) AS n, arg_min(value, t_ms) AS first_v,
    CAST(coalesce(sum(inc), 0) - coalesce(arg_min({{'i': inc}}, t_ms).i, 0) AS DOUBLE) AS grown FROM wide GROUP BY series, at_ms HAVING count(*) > 1),
gaps AS (
  SELECT *, CAST(last_t - first_t AS DOUBLE) AS width, (last_t - first_t) / (n - 1) AS mean, CAST(first_t - (at_ms - {2 * HOUR}) AS DOUBLE) AS ahead, CAST(at_ms - last_t AS DOUBLE) AS behind FROM parts),
ends AS (SELECT *, CASE WHEN ahead >= mean * 1.1 THEN mean / 2 ELSE ahead END AS a, CASE WHEN behind >= mean * 1.1 THEN mean / 2 ELSE behind END AS b FROM gaps),
rates AS (
  SELECT series, at_ms, grown * (width + CASE WHEN grown > 0 THEN least(a, width * (first_v / grown)) ELSE a END + b) / width / {2 * HOUR / 1000} AS rate FROM ends),
summed AS (SELECT at_ms, sum(rate) AS rate FROM rates GROUP BY at_ms)"""
)
RATES_SQL = RATES + " SELECT at_ms, round(rate, 9) AS rate FROM summed"


def counter_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = counters.rates(counted(spark, sf_dir), "series", range_ms=2 * HOUR, step_ms=10 * MINUTE)
    return counters.peak(r).select(F.round("peak", 9).alias("peak"))


PEAK_SQL = RATES + " SELECT round(max(rate), 9) AS peak FROM summed"


def _sketched(spark: SparkSession, sf_dir: str) -> Sketches:
    """The values of events by type, in five batches, of which the third comes twice and the first three are summed up."""
    s = Sketches(spark, scratch(spark, "sketches"), ("event_type",))
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") * 20).alias("v"))
    for batch in (0, 1, 2, 2, 3, 4):
        s.add(e.filter(F.col("event_id") % 5 == batch), "v", batch)
        if batch == 3:
            s.compact(2)
    return s


def sketch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sketched(spark, sf_dir).histogram()


SKETCH_SQL = "SELECT event_type, le, count(*) FILTER (le IS NULL OR value * 20 <= le) AS n FROM events, (SELECT unnest([5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000] || [NULL]) AS le) WHERE value IS NOT NULL GROUP BY event_type, le"


def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the merged sketches' quantiles are within their stated error of the exact ones."""
    s = _sketched(spark, sf_dir)
    qs = (0.01, 0.5, 0.95, 0.99, 1.0)
    exact = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value * 20)") for q in qs]
    true = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array(*[F.struct(F.lit(q).alias("q"), x.alias("exact")) for q, x in zip(qs, exact, strict=True)]).alias("x")).select("event_type", F.explode("x").alias("x")).select("event_type", "x.q", "x.exact")
    within = F.abs(F.col("value") - F.col("exact")) <= F.abs(F.col("exact")) * (s.error + 1e-9)
    return true.join(s.quantiles(*qs), ["event_type", "q"]).select("event_type", "q", F.round("exact", 6).alias("exact"), within.alias("within"))


QUANTILES_SQL = "WITH x AS (SELECT event_type, [" + ", ".join(f"{{'q': CAST({q} AS DOUBLE), 'exact': quantile_disc(value * 20, {q})}}" for q in (0.01, 0.5, 0.95, 0.99, 1.0)) + "] AS l FROM events GROUP BY event_type), y AS (SELECT event_type, unnest(l) AS u FROM x) SELECT event_type, u.q AS q, round(u.exact, 6) AS exact, true AS within FROM y"

QUERIES = {"q_counter_increase": increases, "q_counter_rates": counter_rates, "q_counter_peak": counter_peak, "q_sketch_histogram": sketch_histogram, "q_sketch_quantiles": sketch_quantiles}
ORACLE_SQL = {"q_counter_increase": INCREASES_SQL, "q_counter_rates": RATES_SQL, "q_counter_peak": PEAK_SQL, "q_sketch_histogram": SKETCH_SQL, "q_sketch_quantiles": QUANTILES_SQL}
