"""Sessions, scratch folders and lineage cuts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Session settings that results depend on (the zone) or that suit skewed, large inputs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_own: dict[str, str] = {}


def session(app: str = "lodestar", **settings: str) -> SparkSession:
    """A session with SETTINGS, which the given ones override (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the cluster names; a local temporary one only where none is named and all is one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a short lineage that survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Plans that are run within give Python at most so many rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """cut(), and the number of rows, which Spark counts while it writes."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    try:
        return kept, seen.get["n"]
    except Py4JError:
        # Spark saw that there are no rows before it ran anything, and dropped the observation.
        return kept, kept.count()
