"""Run queries against their SQL in DuckDB, as the driver does: python tests/compare.py [sf_dir] [name prefix ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in data), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def compare(df, rel):
    a, x = rows(df.columns, df.collect())
    b, y = rows(rel.columns, rel.fetchall())
    if a != b:
        return f"columns {a} and {b}"
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    for c, t in df.dtypes:
        if t in KINDS and theirs[c] != KINDS[t]:
            return f"type of {c}: {t} and {theirs[c]}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; first only in one: {[r for r in x if r not in y][:2]} {[r for r in y if r not in x][:2]}"
    for r, s in zip(x, y):
        if r != s and not all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(p)) for p, q in zip(r, s)):
            return f"row {r} and {s}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf, only = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', 8)}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(sf), entry.oracle_sql()
    for name, f in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            if name in sql:
                df = f(spark, sf)
                n, why = df.count(), compare(df, con.sql(sql[name]))
            else:
                n, why = f(spark, sf).count(), ""
        except Exception as e:
            n, why = -1, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if not why else 'FAIL'} {name} {n} rows {time.time() - t:.1f} s{'' if name in sql else ' (no SQL)'} {why}", flush=True)
