"""What each query's plan contains: python tests/plan_report.py [sf] [name part ...]

Automatic broadcasts are switched off, so every broadcast shown is one the code asks for.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from oddglass.session import get_session  # noqa: E402

MARKS = {
    "scan": r"FileScan|BatchScan", "shuffle": r"Exchange (?:hash|range|round)", "single": r"Exchange SinglePartition", "bcast": r"BroadcastExchange",
    "cartesian": r"CartesianProduct", "nested": r"BroadcastNestedLoopJoin", "python": r"(?:FlatMapGroupsIn|MapIn|ArrowEval|BatchEval)\w*",
}

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    spark = get_session("local[8]", spark__sql__shuffle__partitions="8", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in entry.queries().items():
        if sys.argv[2:] and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        plan = fn(spark, f"/root/testdata/sf{sf}")._jdf.queryExecution().executedPlan().toString()
        found = {k: len(re.findall(p, plan)) for k, p in MARKS.items()}
        reused = len(re.findall("ReusedExchange", plan))
        windows = [w for w in re.findall(r"Window(?:Group\w*)? \[.*?\](?=,|\n)[^\n]*", plan)]
        bare = sum(1 for w in windows if re.search(r"windowspecdefinition\((?:specified|[^,]* (?:ASC|DESC))", w))
        print(name, {k: v for k, v in {**found, "reused": reused, "windows": len(windows), "unpartitioned": bare}.items() if v}, flush=True)
