"""Runs queries against the SQL that they are held against: python -m tests.compare [folder] [name...]."""

from __future__ import annotations

import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def normal(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(normal(r[i]) for i in order) for r in data), key=repr)


def difference(spark, db, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours == theirs:
        return ""
    a, b = [r for r in ours if r not in set(theirs)], [r for r in theirs if r not in set(ours)]
    return f"{len(ours)} and {len(theirs)} rows; only ours ({len(a)}): {str(a[:2])[:600]}; only theirs ({len(b)}): {str(b[:2])[:600]}"


def main(args: list[str]) -> int:
    import __spark_entry__ as entry
    from lodestar.session import session

    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    spark = session("compare", spark_master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = database(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args[1:] or [q for q in queries if q.startswith("q_")]:
        began = time.time()
        try:
            found = difference(spark, db, queries[name], sql[name], sf_dir) if name in sql else f"no SQL; {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:
            found = f"failed: {str(e)[:1500]}"
        ok = not found or found.startswith("no SQL")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - began:.1f} s {found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
