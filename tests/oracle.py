"""Run a query in Spark and its SQL in DuckDB over the same tables and compare the rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings repositories nodes shared_nodes removed_nodes edges files observations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return str(x) if x is not None else None


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, sf: str, name: str, query, sql: str, con=None) -> str:
    df = query(spark, sf)
    began = time.time()
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    cur = (con or connect(sf)).execute(sql)
    b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if a[1] != b[1]:
        return f"rows {sum(a[1].values())} {sum(b[1].values())}; only Spark {list((a[1] - b[1]).items())[:3]}; only SQL {list((b[1] - a[1]).items())[:3]}"
    print(f"{name}: {sum(a[1].values())} rows, {took:.1f} s")
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, sql = connect(sf_dir), entry.oracle_sql()
    for n, f in entry.queries().items():
        if names and n not in names and not any(n.startswith(x[:-1]) for x in names if x[-1] == "*"):
            continue
        began = time.time()
        if n in sql:
            if why := compare(s, sf_dir, n, f, sql[n], con):
                print(f"{n}: DIFFERS: {why}")
        else:
            print(f"{n}: {f(s, sf_dir).count()} rows, no SQL, {time.time() - began:.1f} s")
