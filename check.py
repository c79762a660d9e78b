"""Run registered queries next to their SQL and compare; a development tool.

usage: python check.py [sf_dir] [prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from doubtline.queries import all_queries, all_sql
from doubtline.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value if isinstance(value, (int, str)) else str(value)


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark_rows, names, sql_rows, sql_names) -> str:
    if sorted(names) != sorted(sql_names):
        return f"COLUMNS {sorted(names)} != {sorted(sql_names)}"
    order = sorted(names)
    left = sorted((tuple(cell(r[names.index(c)]) for c in order) for r in spark_rows), key=str)
    right = sorted((tuple(cell(r[sql_names.index(c)]) for c in order) for r in sql_rows), key=str)
    if len(left) != len(right):
        return f"ROWS {len(left)} != {len(right)}"
    if left == right:
        return "ok"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"VALUES {len(bad)} of {len(left)} differ, {order}: {bad[:3]}"


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plans, sql = all_queries(), all_sql()
    failed = 0
    for name in plans:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            start = time.time()
            df = plans[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            if name in sql:
                start = time.time()
                cursor = con.execute(sql[name])
                names = [d[0] for d in cursor.description]
                result = compare(rows, df.columns, cursor.fetchall(), names)
                oracle = f"{time.time() - start:6.2f}s"
            else:
                result, oracle = ("ok (rows only)" if rows else "EMPTY"), "   -   "
        except Exception as error:
            result, spent, oracle, rows = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, "   -   ", []
            if "-v" in argv:
                traceback.print_exc()
        failed += not result.startswith("ok")
        print(f"{name:28s} {len(rows):8d} rows {spent:6.2f}s {oracle}  {result}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
