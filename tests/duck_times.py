"""Times of the headline queries' check SQL in DuckDB: python tests/duck_times.py [sf] [threads]; one markdown row each."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import bench  # noqa: E402
from compare import duck  # noqa: E402
from oddglass.plans import catalog  # noqa: E402

if __name__ == "__main__":
    sf, threads = (sys.argv[1:] + ["0.1", "8"][len(sys.argv) - 1:])[:2]
    con = duck(f"/root/testdata/sf{sf}")
    con.execute(f"SET threads = {int(threads)}")
    total = 0.0
    for name in bench.HEADLINE:
        sql = catalog.oracle_sql()[name]
        con.execute(f"CREATE OR REPLACE TEMP TABLE warm AS {sql}")
        start = time.time()
        con.execute(f"CREATE OR REPLACE TEMP TABLE out AS {sql}")
        took = time.time() - start
        total += took
        print(f"| {name} | {took:.2f} |", flush=True)
    print(f"| total | {total:.2f} |")
