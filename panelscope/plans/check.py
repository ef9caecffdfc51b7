"""Compare registered queries with their oracles in an in-process DuckDB.

    python -m panelscope.plans.check [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(round(value, 9))
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def oracle_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    """Returns (status, seconds spark, seconds oracle, detail)."""
    start = time.time()
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    mid = time.time()
    if sql is None:
        return "rows", mid - start, 0.0, f"{len(rows)} rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    end = time.time()
    c1, r1 = normal_rows(df.columns, rows)
    c2, r2 = normal_rows(names, expected)
    if c1 != c2:
        return "COLUMNS", mid - start, end - mid, f"{c1} != {c2}"
    if len(r1) != len(r2):
        return "COUNT", mid - start, end - mid, f"{len(r1)} != {len(r2)}"
    if r1 != r2:
        bad = [(a, b) for a, b in zip(r1, r2) if a != b]
        return "VALUES", mid - start, end - mid, f"{c1}: {len(bad)} differ, first {bad[:2]}"
    types = {}
    for field, col in zip(df.schema.fields, df.columns):
        types[col] = field.dataType.simpleString()
    return ("match" if r1 else "EMPTY"), mid - start, end - mid, f"{len(r1)} rows"


def main(argv):
    from panelscope.plans.registry import all_oracles, all_queries
    from panelscope.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session("check")
    con = oracle_connection(folder)
    oracles = all_oracles()
    tally = {}
    for name, fn in all_queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            status, t1, t2, detail = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            status, t1, t2, detail = "ERROR", 0.0, 0.0, f"{type(e).__name__}: {str(e)[:1200]}"
            if wanted:
                traceback.print_exc()
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:8s} {name:34s} {t1:6.2f}s {t2:6.2f}s {detail[:1500]}", flush=True)
    print(tally)
    return 0 if set(tally) <= {"match", "rows"} else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
