"""Registered queries against their SQL on the small tables.

By default one query per family; ODDGLASS_ALL=1 runs them all (minutes).
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oddglass.plans import catalog
from compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "A1_ratio_rate", "A3_split_sweep", "A20_exact_quantile_cut", "C3_digit_audit", "C13_adjudicate", "D3_leaderboard", "D12_career_chase", "E2_editorial_prior",
    "F2_load_registry", "G7_change", "H2_run_specs", "I1_interest_score", "J4_range_join_window", "J12_asof_anchor", "L1_extremeness", "L7_bh_fdr",
    "P7_conjunction_groups", "Q2_grade_predictions", "R3_live_pitcher_line", "S11_feed_flatten", "T6_diversity_capped_topk", "V9_launch", "W6_rolling_mean", "X16_metric_family", "Y2_components",
)


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.queries()) if os.environ.get("ODDGLASS_ALL") else SAMPLE)
def test_query_matches_sql(spark, name):
    rows, problems = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert not problems, problems
    assert rows >= 0
