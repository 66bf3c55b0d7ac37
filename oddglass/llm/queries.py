"""All queries of this folder, by name."""

from __future__ import annotations

from . import q_bpe, q_decontam, q_html, q_lang_id, q_lm, q_mtree, q_near_dups, q_prefix_trie, q_quality, q_repeats, q_secrets, q_toxicity, q_whiten  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
