"""All registered queries, by module."""

from __future__ import annotations

from . import q_audit, q_boards, q_candidates, q_detectors, q_joins, q_learn, q_lenses, q_live, q_points, q_rates, q_reconcile, q_scalars, q_scan, q_windows
from .registry import ORACLES, QUERIES

MODULES = (q_scalars, q_rates, q_joins, q_windows, q_lenses, q_scan, q_points, q_detectors, q_boards, q_learn, q_audit, q_reconcile, q_candidates, q_live)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
