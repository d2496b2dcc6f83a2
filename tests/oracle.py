"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def connection(folder: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder: str = SF):
    """None when equal, else a text that shows the difference."""
    started = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = dict(zip(names, [str(d[1]) for d in cursor.description]))
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", spent, len(got)
    for field, kind in df.dtypes:
        expected = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}.get(kind, kind)
        if kinds[field] != expected:
            return f"type of {field}: {kind} against {kinds[field]}", spent, len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None, spent, len(got)
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    return (
        f"{len(a)} rows against {len(b)}; columns {sorted(names)}; only here {only_a[:2]}; only there {only_b[:2]}",
        spent, len(got),
    )


def main(only=()):
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from floodgauge.session import get_session

    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection()
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        try:
            if name in sqls:
                problem, spent, n = compare(spark, con, name, fn, sqls[name])
            else:
                started = time.time()
                n = len(fn(spark, SF).collect())
                problem, spent = None, time.time() - started
        except Exception as e:  # noqa: BLE001
            problem, spent, n = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {spent:.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
