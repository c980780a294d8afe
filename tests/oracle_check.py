"""Runs queries beside their SQL, as the driver does: python tests/oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return v if isinstance(v, str) else str(v)


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(DATA, sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    return con


def compare(spark, con, sf: str, query, sql: str) -> str:
    """"" if both agree, else what differs."""
    df = query(spark, f"{DATA}/{sf}")
    ours = df.toPandas()
    theirs = con.sql(sql).df()
    a, b = sorted(ours.columns), sorted(theirs.columns)
    if a != b:
        return f"columns {a} / {b}"
    rows = lambda d: sorted((tuple(norm(v) for v in r) for r in d[a].itertuples(index=False)), key=repr)
    x, y = rows(ours), rows(theirs)
    if x != y:
        sx, sy = set(x), set(y)
        return f"{len(x)} / {len(y)} rows; only Spark {sorted(sx - sy, key=repr)[:3]}; only SQL {sorted(sy - sx, key=repr)[:3]}"
    return ""


if __name__ == "__main__":
    from tessera.session import local_session

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    spark, con = local_session(), connect(sf)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, bad = e.queries(), e.oracle_sql(), 0
    for name in args or sql:
        t = time.time()
        try:
            out = compare(spark, con, sf, queries[name], sql[name])
        except Exception as x:
            out = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(out)
        print(f"{'ok ' if not out else 'BAD'} {name} {time.time() - t:.1f} s {out[:900]}", flush=True)
    print(f"{bad} differ of {len(args or sql)}")
    sys.exit(bool(bad))
