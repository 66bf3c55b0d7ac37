"""Rare-fact analytics on Spark: rates, lenses, scope, scoring, audits, streams."""
