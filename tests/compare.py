"""Run a registered query on Spark and its check SQL on DuckDB; compare whole results."""

from __future__ import annotations

import decimal
import math

import duckdb

from oddglass.plans.roles import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in data),
        key=lambda t: tuple((x is None, x or "") for x in t),
    )


def compare(df, con, sql):
    """Return (row count, list of differences)."""
    got = df.collect()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        return len(got), [f"columns {sorted(df.columns)} != {sorted(want_cols)}"]
    if len(got) != len(want):
        problems.append(f"rows spark {len(got)} duckdb {len(want)}")
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, columns {sorted(want_cols)}, first {bad[0]}")
    types = {n.lower(): t for n, t in df.dtypes}
    duck_types = {d[0].lower(): str(d[1]) for d in cur.description}
    for name, t in types.items():
        fam = lambda s: ("n" if any(k in s.lower() for k in ("int", "double", "float", "number", "dec")) else s.lower().replace("varchar", "string")[:3])
        if fam(t) != fam(duck_types[name]) and not (t.startswith("time") or t == "date"):
            problems.append(f"type {name}: spark {t} duckdb {duck_types[name]}")
        if "dec" in t or "dec" in duck_types[name].lower():
            problems.append(f"decimal column {name}: {t} / {duck_types[name]}")
    return len(got), problems
