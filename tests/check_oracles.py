"""Compare queries with their reference SQL: python tests/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tallyspark.queries.core import TABLES  # noqa: E402


def norm(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


KIND = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "int": "INTEGER"}


def compare(spark, con, name, sf_dir):
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    secs = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(got)} rows {secs:.1f}s", True
    t1 = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    osecs = time.time() - t1
    types = {d[0]: str(d[1]) for d in cur.description}
    gn, gr = rows_of(df.columns, got)
    wn, wr = rows_of([d[0] for d in cur.description], want)
    if gn != wn:
        return f"COLUMNS {gn} != {wn}", False
    bad = [c for c, t in df.dtypes if KIND.get(t) != types[c]]
    if bad:
        return f"TYPES {[(c, dict(df.dtypes)[c], types[c]) for c in bad]}", False
    if gr != wr:
        return (f"VALUES spark {len(got)} duckdb {len(want)}\n   only spark "
                f"{list((gr - wr).items())[:4]}\n   only duckdb {list((wr - gr).items())[:4]}"), False
    return f"ok {len(got)} rows {secs:.1f}s (duckdb {osecs:.1f}s)", True


def main():
    from tallyspark.session import build_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in entry.queries():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            text, ok = compare(spark, con, name, sf_dir)
        except Exception as exc:
            text, ok = f"ERROR {type(exc).__name__} {str(exc)[:700]}", False
        if not ok:
            failed.append(name)
        print(f"{name}: {text}", flush=True)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
