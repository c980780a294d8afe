"""Seconds that DuckDB takes for the SQL beside each query of the bench, the median of three: python tests/duckdb_times.py [sf] [threads]."""

from __future__ import annotations

import statistics
import sys
import time

from oracle_check import connect


def main() -> None:
    sf, threads = (sys.argv[1:] + ["sf0.1", "8"][len(sys.argv) - 1 :])[:2]
    import __spark_entry__ as entry
    import bench

    con, sql = connect(sf), entry.oracle_sql()
    con.execute(f"SET threads = {threads}")
    for name in bench.HEADLINE:
        if name not in sql:
            print(f"| {name} | no SQL |", flush=True)
            continue
        took = []
        for _ in range(3):
            began = time.time()
            con.sql(sql[name]).fetchall()
            took.append(time.time() - began)
            if took[0] > 30:
                break
        print(f"| {name} | {statistics.median(took):.2f} |", flush=True)


if __name__ == "__main__":
    main()
