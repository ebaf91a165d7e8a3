"""Run the registered queries beside their SQL in DuckDB and compare rows.

usage: python check.py [--sf DIR] [--only name,name] [--module rows] [--chunk N]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
         "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]"}


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("cleanloom").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def main() -> int:
    import duckdb
    from workload import MODULES

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only")
    ap.add_argument("--module")
    ap.add_argument("--chunk", type=int)
    args = ap.parse_args()
    spark = session()
    if args.chunk:
        spark.conf.set("cleanloom.scan.rowsPerChunk", str(args.chunk))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    todo = {n: q for m in MODULES if not args.module or m.__name__.endswith("." + args.module) for n, q in m.Q.items()}
    if args.only:
        todo = {n: todo[n] for n in args.only.split(",")}
    for name, (fn, sql) in todo.items():
        start = time.time()
        try:
            df = fn(spark, args.sf)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark {str(e)[:900]}", flush=True)
            continue
        took = time.time() - start
        if not sql:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sql)
            cols = [c[0] for c in cur.description]
            kinds = [str(c[1]) for c in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: sql {str(e)[:600]}", flush=True)
            continue
        note = ""
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(df.columns)} / {sorted(cols)}", flush=True)
            continue
        order_a = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        order_b = sorted(range(len(cols)), key=lambda i: cols[i])
        for i, j in zip(order_a, order_b):
            k = KINDS.get(df.schema[i].dataType.simpleString(), df.schema[i].dataType.simpleString())
            if k != kinds[j] and not (k == "VARCHAR" and kinds[j] == "STRING"):
                note += f" type {cols[j]}: {k}/{kinds[j]}"
        a = sorted(tuple(norm(r[i]) for i in order_a) for r in got)
        b = sorted(tuple(norm(r[j]) for j in order_b) for r in want)
        if a == b:
            print(f"ok    {name}: {len(a)} rows {took:.1f}s{note}", flush=True)
        else:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            print(f"FAIL  {name}: rows {len(a)}/{len(b)}, {len(diff)} differ, first {str(diff[:2])[:500]}{note}", flush=True)
    print(f"{len(todo) - bad} of {len(todo)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
