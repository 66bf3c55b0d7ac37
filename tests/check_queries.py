"""Compare every registered query with its SQL: python tests/check_queries.py [sf] [name part ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, duck  # noqa: E402
from oddglass.session import get_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    good = bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            if name in sqls:
                n, problems = compare(fn(spark, sf_dir), con, sqls[name])
            else:
                n, problems = len(fn(spark, sf_dir).collect()), []
        except Exception as e:  # report and go on with the next query
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:700]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        good, bad = good + (not problems), bad + bool(problems)
        tag = "ok " if not problems else "BAD"
        note = "" if name in sqls else " (rows only)"
        print(f"{tag} {name} rows={n} {time.time() - start:.1f}s{note}{' EMPTY' if n == 0 else ''} {' | '.join(problems)[:1500]}", flush=True)
    print(f"good {good} bad {bad}")
