"""Run registered queries on Spark and their SQL on DuckDB, compare exact values.

usage: python tools/check.py [-d DIR] [name or prefix* ...]
"""

import argparse
import datetime as dt
import fnmatch
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from stakeflow.plans import QUERIES
from stakeflow.session import local_session
from stakeflow.sources.tables import RAW


def norm(v):
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*", default=["*"])
    a = ap.parse_args()
    spark = local_session()
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"create view {t} as select * from '{a.d}/{t}.parquet'")
    bad = []
    for name, q in QUERIES.items():
        if not any(fnmatch.fnmatch(name, p) for p in a.names or ["*"]):
            continue
        t0 = time.time()
        try:
            df = q(spark, a.d)
            got = rows(df.columns, df.collect())
            t1 = time.time()
            if q.sql is None:
                print(f"rows {name}: {len(got)} ({t1-t0:.1f}s) {got[:1]}")
                continue
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = rows(cols, cur.fetchall())
            types = [str(d[1]) for d in cur.description]
            if sorted(cols) != sorted(df.columns):
                bad.append(name)
                print(f"BAD  {name}: columns {sorted(df.columns)} vs {sorted(cols)}")
            elif got != want:
                bad.append(name)
                diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
                print(f"BAD  {name}: rows {len(got)} vs {len(want)} {sorted(cols)}")
                for g, w in diff:
                    print("    spark ", g)
                    print("    oracle", w)
            else:
                odd = [t for t in types if "HUGE" in t or "DECIMAL" in t or "[]" in t]
                flag = f" TYPES {odd}" if odd else ""
                flag += " EMPTY" if not got else ""
                print(f"ok   {name}: {len(got)} rows ({t1-t0:.1f}s, sql {time.time()-t1:.1f}s){flag}")
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:900]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
        sys.stdout.flush()
    print("bad:", bad)


main()
