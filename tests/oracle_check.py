"""Run registered queries on Spark and their SQL oracle on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: rows on both sides and whether the values match
(order-insensitive, columns compared by name).
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm_value(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat() + " 00:00:00"
    if isinstance(v, float):
        return round(v, 12)
    if hasattr(v, "item"):
        return _norm_value(v.item())
    return v


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm_value(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, sf_dir: str, keys=None) -> dict:
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or list(qs):
        t0 = time.time()
        sdf = qs[k](spark, sf_dir)
        rows = sdf.collect()
        spd = pd.DataFrame([r.asDict() for r in rows], columns=sdf.columns)
        t1 = time.time()
        if k not in sqls:
            out[k] = dict(spark_rows=len(spd), oracle=None, secs=round(t1 - t0, 2))
            continue
        opd = con.execute(sqls[k]).df()
        t2 = time.time()
        same_cols = sorted(spd.columns) == sorted(opd.columns)
        match = same_cols and normalise(spd) == normalise(opd)
        out[k] = dict(spark_rows=len(spd), oracle_rows=len(opd), cols=same_cols, match=match,
                      secs=round(t1 - t0, 2), oracle_secs=round(t2 - t1, 2))
        if not match:
            out[k]["spark_cols"] = list(spd.columns)
            out[k]["oracle_cols"] = list(opd.columns)
    return out


if __name__ == "__main__":
    from pulsegrid import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    res = compare(spark, sf, keys)
    for k, v in res.items():
        print(k, v, flush=True)
    bad = [k for k, v in res.items() if v.get("oracle") is not None or v.get("match") is False]
    print("MISMATCH:", [k for k, v in res.items() if v.get("match") is False])
