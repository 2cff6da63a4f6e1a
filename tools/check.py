"""Developer check: run registered queries against their SQL in DuckDB and print what differs.

usage: python check.py [-s SF_DIR] [-t] [name ...]
"""

import glob
import math
import os
import sys
import tempfile
import time

import duckdb

from bibliospark.session import build_session


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if v is None:
        return "null"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def compare(spark, con, name, folder, queries, oracles):
    start = time.time()
    df = queries[name](spark, folder)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if name not in oracles:
        return f"ROWS {len(got):7d} {spent:6.2f}s", True
    start = time.time()
    rel = con.execute(oracles[name])
    want, wcols = rows_of([d[0] for d in rel.description], rel.fetchall())
    duck_spent = time.time() - start
    if cols != wcols:
        return f"COLUMNS {cols} vs {wcols}", False
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"DIFF rows {len(got)} vs {len(want)}\n   spark only {str(extra)[:900]}\n   duck only  {str(missing)[:900]}", False
    return f"OK   {len(got):7d} {spent:6.2f}s duck {duck_spent:5.2f}s" + ("  EMPTY" if not got else ""), True


def main():
    from bibliospark.plans import ORACLES, QUERIES

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if "-s" in args:
        i = args.index("-s")
        folder = args[i + 1]
        del args[i : i + 2]
    names = []
    for a in args:
        names += [q for q in QUERIES if q == a or (a.endswith("*") and q.startswith(a[:-1]))
                  or (a.startswith("@") and QUERIES[q].__globals__ is not None and MODULE.get(q) == a[1:])]
    names = names or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                               "spark.driver.memory": "12g",
                                               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in names:
        try:
            message, ok = compare(spark, con, name, folder, QUERIES, ORACLES)
        except Exception as exc:  # report and go on
            message, ok = "FAIL " + str(exc)[:1200], False
        bad += not ok
        if not ok or "-q" not in sys.argv:
            print(f"{name:28s} {message}", flush=True)
    print(f"{len(names)} checked, {bad} bad")


MODULE: dict[str, str] = {}

if __name__ == "__main__":
    from bibliospark.plans.registry import SECTION

    MODULE.update(SECTION)
    main()
