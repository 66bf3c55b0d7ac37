"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is run once to warm the JVM on the smallest tables and then timed once.
"""

from __future__ import annotations

import json
import os
import time

from oddglass.plans import catalog
from oddglass.session import get_session

HEADLINE = (
    "A1_ratio_rate", "A3_split_sweep", "L1_extremeness", "L2_rank", "L6_split_contrast", "L7_bh_fdr", "L17_matched_control", "P1_scan",
    "W6_rolling_mean", "W7_active_hit_streak", "W9_games_window_split", "J4_range_join_window", "J12_asof_anchor", "D12_career_chase", "D18_career_conjunction",
    "I1_interest_score", "T6_diversity_capped_topk", "E2_editorial_prior", "C3_digit_audit", "S11_feed_flatten", "V2_movement", "Y5_comps", "R3_live_pitcher_line",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    queries = catalog.queries()
    times = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            queries[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
