"""Event dumps: JSON lines, one event a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DOC_EVENT


def write_dump(events: DataFrame, path: str) -> None:
    """Appends events to a dump."""
    events.select("op", "doc", "version", "src_ts_ms", "emit_ts_ms", "mode").write.mode("append").json(path)


def emit(events: DataFrame, batch: int, send: Callable[[DataFrame, str], None], dump: str = "") -> None:
    """A batch of events on its way: first sent (send takes records and the name under which it may be called again), and only then added to the dump, in a folder of the batch. What isn't sent isn't dumped, and a batch that comes again is dumped once."""
    value = F.to_json(F.struct("op", "doc", "version", "src_ts_ms", "emit_ts_ms", "mode"))
    send(events.select(F.col("doc.id").alias("key"), value.alias("value"), F.col("emit_ts_ms").alias("ts_ms")), f"emit-{batch}")
    if dump:
        events.select("op", "doc", "version", "src_ts_ms", "emit_ts_ms", "mode").write.mode("overwrite").json(f"{dump.rstrip('/')}/batch={batch}")


def read_dump(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The events of a dump. strict: a line that can't be read ends the job, naming it; otherwise it is left out."""
    return spark.read.schema(spark.createDataFrame([], DOC_EVENT).schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def replayed(events: DataFrame, now_ms: int) -> DataFrame:
    """The same events, sent again."""
    return events.withColumn("mode", F.lit("replay")).withColumn("emit_ts_ms", F.lit(now_ms).cast("long"))


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
