"""Spark-vs-DuckDB comparison used by the oracle tests (and runnable by hand).

    python -m tests.compare /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

import duckdb

RAW = ("region nation customer supplier part orders lineitem events documents "
       "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, sf_dir: str, key: str, query, sql: str, con=None):
    """Return (ok, message): same columns and types, same rows in any order."""
    df = query(spark, sf_dir)
    s_types = {n: SPARK_TO_DUCK.get(t, t) for n, t in df.dtypes}
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_types = {c[0]: str(c[1]) for c in res.description}
    wrong = {n: (t, d_types.get(n)) for n, t in s_types.items() if d_types.get(n) not in (None, t)}
    if wrong:
        return False, f"{key}: column types differ {wrong}"
    d_cols = [c[0] for c in res.description]
    d_cols, d_rows = rows_of(d_cols, res.fetchall())
    if s_cols != d_cols:
        return False, f"{key}: columns differ\n spark={s_cols}\n duck ={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"{key}: row count spark={len(s_rows)} duck={len(d_rows)}"
    if s_rows != d_rows:
        diffs = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        return False, f"{key}: values differ (first diffs)\n" + "\n".join(
            f" spark={a}\n duck ={b}" for a, b in diffs)
    return True, f"{key}: ok ({len(s_rows)} rows)"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from fleetgrade.session import get_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = get_session()
    qs, orc = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for k in keys or sorted(qs):
        if k not in orc:
            n = qs[k](spark, sf_dir).count()
            print(f"{k}: no oracle ({n} rows)")
            continue
        try:
            ok, msg = compare(spark, sf_dir, k, qs[k], orc[k], con)
        except Exception as e:  # noqa: BLE001 - report and continue
            ok, msg = False, f"{k}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(msg, flush=True)
    print(f"{len(keys or qs) - bad} ok, {bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
