"""Run registered queries in Spark and their SQL in DuckDB and compare the results.

usage: python tools/check_oracles.py [sf_dir] [name substring ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyloom.queries import QUERIES  # noqa: E402
from tallyloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    key = df.astype(str)
    return df.loc[key.sort_values(list(key.columns)).index].reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns differ: {sorted(a.columns)} / {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows differ: {len(a)} / {len(b)}"
    a, b = canonical(a), canonical(b)
    kinds = {c: (a[c].dtype.kind, b[c].dtype.kind) for c in a if a[c].dtype != b[c].dtype}
    for c in a.columns:
        left, right = a[c].astype(object).where(a[c].notna(), None), b[c].astype(object).where(b[c].notna(), None)
        bad = [(i, x, y) for i, (x, y) in enumerate(zip(left, right)) if not (x == y or (x is None and y is None))]
        if bad:
            i = bad[0][0]
            return f"{c}: {len(bad)} values differ, e.g. {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return f"ok {len(a)} rows" + (f" (types {kinds})" if kinds else "")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pick = sys.argv[2:]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    spark = local_session(int(os.environ.get("CHECK_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name, q in QUERIES.items():
        if pick and not any(p in name for p in pick):
            continue
        t = time.time()
        try:
            got = q.run(spark, sf).toPandas()
            dt = time.time() - t
            verdict = f"rows only: {len(got)}" if q.sql is None else compare(got, con.execute(q.sql).df())
        except Exception as e:  # noqa: BLE001
            dt, verdict = time.time() - t, f"ERROR {str(e).splitlines()[0][:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        ok = verdict.startswith(("ok", "rows only"))
        if not ok:
            failed.append(name)
        print(f"{'PASS' if ok else 'FAIL'} {name} {dt:.2f}s {verdict}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
