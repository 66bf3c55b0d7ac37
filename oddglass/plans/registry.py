"""Names, Spark callables and check SQL of every registered query."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import ROLE_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(sql: str) -> str:
    """Replace each ``@role`` by its defining sub-select, repeatedly."""
    while True:
        new = re.sub(r"@([a-z_]+)", lambda m: f"({ROLE_SQL[m.group(1)].strip()})", sql)
        if new == sql:
            return _same_rounding(sql.strip())
        sql = new


def _same_rounding(sql: str) -> str:
    """Write each ``round(`` the way functions.scalars.rnd rounds, without a negative zero."""
    out, closes, depth = [], [], 0
    for token in re.findall(r"\bround\(|[()]|[^()r]+|r", sql):
        if token == "round(":
            out.append("(round(1e-9 + ")
            depth += 1
            closes.append(depth)
        else:
            out.append(token)
            depth += (token == "(") - (token == ")")
            if token == ")" and closes and depth < closes[-1]:
                closes.pop()
                out.append(" + 0e0)")
    return "".join(out)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its check SQL, if any."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return keep
