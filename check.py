"""Compare worked queries with their SQL in DuckDB: ``python check.py [sf_dir] [name-prefix ...]``."""

from __future__ import annotations

import datetime
import decimal
import logging
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

from statmosaic.plans import ORACLES, QUERIES
from statmosaic.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    args = sys.argv[1:]
    d = args.pop(0) if args and Path(args[0]).is_dir() else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = 0
    for name in sorted(QUERIES):
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = QUERIES[name](spark, d)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if name not in ORACLES:
                print(f"ROWS  {name} {len(got)} rows {took:.2f}s", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            columns = [c[0] for c in cur.description]
            want = rows_of(columns, cur.fetchall())
            if sorted(columns) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name} {sorted(df.columns)} / {sorted(columns)}", flush=True)
            elif got != want:
                bad += 1
                a, b = set(got) - set(want), set(want) - set(got)
                print(f"DIFF  {name} {len(got)}/{len(want)} rows; spark only {len(a)} {sorted(a, key=repr)[:3]}; sql only {len(b)} {sorted(b, key=repr)[:3]}", flush=True)
            else:
                print(f"ok    {name} {len(got)} rows {took:.2f}s{'  EMPTY' if not got else ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            text = str(e) if "-v" in sys.argv else str(e).split("JVM stacktrace")[0][:600]
            print(f"FAIL  {name} {type(e).__name__}: {text}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 100))
