"""Run registered queries next to their SQL statements in DuckDB and compare all rows.

    python tests/compare.py [--sf 0.01] [--only prefix,prefix]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    """One comparable form per value; integers, floats, dates and text stay apart."""
    if v is None:
        return ("null", "")
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return ("float", "nan" if math.isnan(v) else v + 0.0)
    if isinstance(v, datetime):
        return ("time", v.replace(tzinfo=None).isoformat())
    if isinstance(v, date):
        return ("date", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("list", tuple(plain(x) for x in v))
    return (type(v).__name__, v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder):
    """None if equal, else a short description of the first difference."""
    df = fn(spark, folder)
    got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows", len(got)
    cur = con.execute(sql)
    want_names, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ:\n    got  {bad[0][0]}\n    want {bad[0][1]}", len(got)
    return None, len(got)


def main():
    from tests.session import get_session
    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = get_session(), connect(folder)
    sqls, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args.only and not any(name.startswith(p) for p in args.only.split(",")):
            continue
        t = time.time()
        try:
            diff, n = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # report every query, not the first failure only
            diff, n = "".join(traceback.format_exception_only(type(e), e))[:1500], -1
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {name:28s} {kind:4s} {n:7d} rows {time.time() - t:6.2f}s", flush=True)
        if diff:
            failed.append(name)
            print("   ", diff, flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
