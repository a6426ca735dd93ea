"""The stateful fold against the fold by windows: chaos, a hot document, restarts."""

import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from lodestar.operators import fold
from lodestar.schemas import ITEM, STATE
from lodestar.streaming import keyed


def chaos(seed, n, keys):
    """Items of keys in shuffled versions, a third of all of the first one."""
    rng = random.Random(seed)
    when = lambda: rng.choice([None, datetime(2024, 1, rng.randrange(1, 28), tzinfo=UTC)])
    lists = lambda: rng.choice([None, [], ["x"], ["c:a", "u:b"]])
    out = []
    for off in range(n):
        op = rng.choices(["upsert", "delete", "poison"], [8, 1, 1])[0]
        key = "d0" if rng.random() < 1 / 3 else f"d{rng.randrange(keys)}"
        at = rng.randrange(0, 1000)
        if op == "poison":
            out.append((key, off, op, None, None, None, None, at, *[None] * 13))
            continue
        text = [rng.choice([None, "", "a", "b", "é"]) for _ in range(8)]
        content = (*text, lists(), lists(), lists(), when(), when()) if op == "upsert" else (None,) * 13
        out.append((key, off, op, rng.randrange(1, n), rng.choice([None, rng.randrange(0, 1000)]), rng.randrange(1000), rng.choice(["live", "replay"]), at, *content))
    return out


def test_equals_the_fold(spark, tmp_path):
    rows = chaos(1, 1500, 60)
    items = spark.createDataFrame(rows, ITEM)
    cuts = [0, 400, 1300, 1500]
    state = None
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    keyed.use_rocksdb(spark)
    # So few rows at once that the hot document's come in many parts, in any order.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = items.filter((F.col("off") >= lo) & (F.col("off") < hi))
            part.orderBy(F.rand(lo)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = spark.readStream.schema(items.schema).parquet(f"file://{tmp_path}/in")
            out = keyed.folded(stream, 7).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"file://{tmp_path}/out/{n}")).outputMode("update")
            out.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            state = fold.merged(state, fold.fold(part, state, 7))
        order = [f.name for f in spark.createDataFrame([], STATE).schema.fields]
        want = sorted(map(tuple, state.select(*order).collect()), key=repr)
        got = sorted(map(tuple, keyed.documents(spark, f"file://{tmp_path}/checkpoint").select(*order).collect()), key=repr)
        assert got == want
        counts = spark.read.option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/out").agg(*[F.sum(c) for c in keyed.COUNTS]).first()
        assert sum(counts) == sum(r[2] != "poison" for r in rows)
        pending = spark.read.format("statestore").option("stateVarName", "pending").load(f"file://{tmp_path}/checkpoint")
        assert pending.count() == 0
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
