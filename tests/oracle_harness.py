"""Spark-vs-DuckDB comparison used by the tests and by ``python -m tests.oracle_harness``.

Mirrors the verification contract: same column names, same row count, and
the same multiset of rows (floats compared after rounding).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from penalytics.sources.tables import TABLES, table_path


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~null",)
        if math.isinf(v):
            return ("~inf", v > 0)
        return round(v, digits) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def canonical_rows(records: list[dict], cols: list[str], digits: int = 6) -> list[tuple]:
    rows = [tuple(_norm(r[c], digits) for c in cols) for r in records]
    return sorted(rows, key=repr)


def compare(spark, sf_dir: str, name: str, build, sql: str, digits: int = 6) -> tuple[bool, str]:
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    s_cols = sorted(sdf.columns)
    t1 = time.time()
    con = duck_connect(sf_dir)
    cur = con.execute(sql)
    d_cols_raw = [d[0] for d in cur.description]
    d_rows = [dict(zip(d_cols_raw, r)) for r in cur.fetchall()]
    d_cols = sorted(d_cols_raw)
    if s_cols != d_cols:
        return False, f"{name}: columns differ spark={s_cols} duck={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"{name}: rows differ spark={len(s_rows)} duck={len(d_rows)}"
    a = canonical_rows(s_rows, s_cols, digits)
    b = canonical_rows(d_rows, d_cols, digits)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{name}: values differ, first: {diff}"
    return True, f"{name}: ok rows={len(a)} spark={t1 - t0:.2f}s"


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from penalytics.plans.registry import all_queries
    from penalytics.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    only = set(argv)
    spark = build_session()
    bad = 0
    for name, q in all_queries().items():
        if only and name not in only:
            continue
        if q.oracle is None:
            t0 = time.time()
            n = q.build(spark, sf_dir).count()
            print(f"{name}: rows-only {n} rows {time.time() - t0:.2f}s", flush=True)
            continue
        try:
            ok, msg = compare(spark, sf_dir, name, q.build, q.oracle)
        except Exception as e:  # report and continue with the rest
            ok, msg = False, f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
