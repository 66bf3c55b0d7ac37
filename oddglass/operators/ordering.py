"""Exact positions, cumulative sums and quantiles without a one-task window.

A plain ``Window.partitionBy(metric).orderBy(value)`` sends a whole metric to one
task.  Here each partition key is cut into ordered buckets first.  A hash-picked
handful of rows only chooses where to cut; every row is then placed in a bucket,
summed inside it, and shifted by the exact totals of the buckets before it, so
results are exact for any choice of cut points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PICK_ONE_IN = 4096  # one row in so many may become a cut point
MOST_CUTS = 256  # cut points kept per partition key
SPREAD = 32  # tasks a key's rows meet its cut points in
# Names of columns whose values the driver lists: metric and family names.
LISTED = {"metric_id", "metric", "family", "lens"}


def _names(cols: list[str]) -> str:
    return ", ".join(f"`{c}`" for c in cols)


def _cut_points(rows: DataFrame, part: list[str], one_in: int, most: int) -> DataFrame:
    # Hashing all columns keeps this branch's plan equal to the row branch below
    # it, so Spark reuses the shuffle that produced ``rows``.  Of the picked rows at
    # most ``most`` per key are kept; each task cuts its own down before it sends any.
    picked = rows.where(f"pmod(xxhash64({_names(rows.columns)}), {one_in}) = 0").select(*part, "_k")
    if part:
        by = f"PARTITION BY {_names(part)} ORDER BY xxhash64(_k), _k"
        few = picked.selectExpr("*", f"row_number() OVER ({by}) AS _i").where(f"_i <= {most}").drop("_i")
    else:
        few = picked.orderBy(F.xxhash64("_k"), "_k").limit(most)
    return few.groupBy(*part).agg(F.expr("sort_array(collect_list(_k)) AS _cuts"))


def running_totals(
    df: DataFrame,
    part: list[str],
    order: list[str],
    amounts: dict[str, str],
    *,
    few_parts: bool | None = None,
    one_in: int = PICK_ONE_IN,
    most: int = MOST_CUTS,
) -> DataFrame:
    """Add, per named amount (SQL text), ``before_<name>``, the sum over strictly earlier
    rows, and ``whole_<name>``, the sum over the whole partition key.

    ``order`` are ascending columns that are unique and non-null within ``part``.
    ``few_parts`` says that ``part`` takes values from a list the driver holds, which
    bounds the cut-point tables to ``most`` entries per listed value; only then are they
    broadcast by hint.  By default that is so for columns of metric and family names, and
    without a partition key.  All other tables are left to adaptive execution, and rows meet
    their cut points in ``SPREAD`` tasks per key.  Sums are taken per key and bucket, so a key
    that holds half of all rows is spread over its buckets.
    """
    few = set(part) <= LISTED if few_parts is None else few_parts
    cols = df.columns
    rows = df.selectExpr("*", f"struct({_names(order)}) AS _k")
    hint = F.broadcast if few else (lambda d: d)
    cuts = _cut_points(rows, part, one_in, most)
    if not part:
        cut = rows.withColumn("_cuts", cuts.scalar())
    elif few:
        cut = rows.join(F.broadcast(cuts), part, "left")
    else:
        spread = cuts.selectExpr("*", f"explode(sequence(0, {SPREAD - 1})) AS _s")
        cut = rows.selectExpr("*", f"CAST(pmod(xxhash64(_k), {SPREAD}) AS INT) AS _s").join(spread, [*part, "_s"], "left")
    placed = cut.selectExpr(*cols, "_k", "CASE WHEN _cuts IS NULL THEN 0 ELSE size(filter(_cuts, c -> c <= _k)) END AS _b").repartition(*[F.col(c) for c in [*part, "_b"]])
    inside = f"(PARTITION BY {_names([*part, '_b'])} ORDER BY _k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    local = placed.selectExpr("*", *[f"coalesce(sum({a}) OVER {inside}, ({a}) * 0) AS _in_{n}" for n, a in amounts.items()])
    # The hash keeps every column alive, so this branch is the row branch's own
    # plan and Spark runs the shuffle below both only once.
    totals = placed.groupBy(*part, "_b").agg(
        *[F.expr(f"sum({a}) AS _sum_{n}") for n, a in amounts.items()], F.expr(f"max(xxhash64({_names(cols)})) AS _same"))
    by = f"PARTITION BY {_names(part)}" if part else ""
    offsets = totals.selectExpr(
        *part, "_b",
        *[f"coalesce(sum(_sum_{n}) OVER ({by} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), _sum_{n} * 0) AS _off_{n}" for n in amounts],
        *[f"sum(_sum_{n}) OVER ({by}) AS whole_{n}" for n in amounts])
    out = local.join(hint(offsets), [*part, "_b"])
    return out.selectExpr(*cols, *[f"_off_{n} + _in_{n} AS before_{n}" for n in amounts], *[f"whole_{n}" for n in amounts])


def ordinal(
    df: DataFrame, part: list[str], order: list[str], *, out: str = "rank", size: str = "pop_n", **kw,
) -> DataFrame:
    """1-based position by ascending ``order`` (unique within ``part``) and the size."""
    ranked = running_totals(df, part, order, {"_x": "1L"}, **kw)
    return ranked.selectExpr(*df.columns, f"before__x + 1 AS `{out}`", f"whole__x AS `{size}`")


def ecdf(
    df: DataFrame, part: list[str], value: str, *, better: str | None = None, out: str = "pct", size: str = "pop_n", **kw,
) -> DataFrame:
    """Share of the population each row strictly beats.

    Equal values are counted once per value before anything is ordered, so a value
    that holds a third of the rows is one row here.  ``better`` is SQL text, true
    where higher values win (default: always).
    """
    turned = f"`{value}`" if better is None else f"CASE WHEN {better} THEN `{value}` ELSE -`{value}` END"
    rows = df.selectExpr("*", f"{turned} AS _v")
    counts = rows.where("_v IS NOT NULL").groupBy(*part, "_v").agg(F.expr("count(1) AS _c"))
    below = running_totals(counts, part, ["_v"], {"_x": "_c"}, **kw).drop("_c")
    return rows.join(below, [*part, "_v"]).selectExpr(*df.columns, f"before__x / whole__x AS `{out}`", f"whole__x AS `{size}`")


def competition_rank(df: DataFrame, part: list[str], value: str, *, descending: bool = True, out: str = "rank", **kw) -> DataFrame:
    """SQL ``RANK()`` (ties share the lowest position) by the same route."""
    rows = df.selectExpr("*", f"{'-' if descending else ''}`{value}` AS _v")
    counts = rows.groupBy(*part, "_v").agg(F.expr("count(1) AS _c"))
    below = running_totals(counts, part, ["_v"], {"_x": "_c"}, **kw)
    return rows.join(below.drop("_c", "whole__x"), [*part, "_v"]).selectExpr(*df.columns, f"before__x + 1 AS `{out}`")


def quantile_cut(df: DataFrame, part: list[str], value: str, q: float, *, out: str = "cut", **kw) -> DataFrame:
    """The continuous q-quantile per ``part``, interpolated between its two neighbours."""
    counts = df.where(f"`{value}` IS NOT NULL").groupBy(*part, value).agg(F.expr("count(1) AS _c"))
    placed = running_totals(counts, part, [value], {"_x": "_c"}, **kw).selectExpr(
        "*", f"floor((whole__x - 1) * {q!r}D) AS _l", f"ceil((whole__x - 1) * {q!r}D) AS _h", f"(whole__x - 1) * {q!r}D AS _s")
    holds = "(before__x <= {0} AND {0} < before__x + _c)"
    low, high = holds.format("_l"), holds.format("_h")
    ends = placed.where(f"{low} OR {high}").groupBy(*part).agg(
        F.expr(f"max(CASE WHEN {low} THEN `{value}` END) AS _lo"), F.expr(f"max(CASE WHEN {high} THEN `{value}` END) AS _hi"), F.expr("max(_s - _l) AS _f"))
    return ends.selectExpr(*part, f"_lo + (_hi - _lo) * _f AS `{out}`")


def next_better(df: DataFrame, part: list[str], order: list[str], bring: dict[str, str], **kw) -> DataFrame:
    """Join each row to the one placed just above it, bringing the named columns along."""
    placed = ordinal(df, part, order, **kw)
    above = placed.select(
        *part, (F.col("rank") + 1).alias("rank"), *[F.col(src).alias(new) for src, new in bring.items()]
    )
    return placed.join(above, [*part, "rank"], "left")


def range_totals(
    points: DataFrame,
    probes: DataFrame,
    part: list[str],
    at: str,
    amounts: dict[str, str],
    low: str,
    high: str,
    probe_id: list[str],
    **kw,
) -> DataFrame:
    """Per probe, the count and sums over points with ``low <= at <= high``.

    Points and the two ends of every probe go through one cumulative sum; the
    answer is the difference of the two ends, so no probe meets each point.  Amounts
    are whole numbers, so the differences are exact.
    """
    names = ["_cnt", *amounts]
    base = points.where(f"`{at}` IS NOT NULL").groupBy(*part, F.expr(f"CAST(`{at}` AS DOUBLE) AS _at")).agg(
        F.expr("count(1) AS _cnt"), *[F.expr(f"sum(coalesce(CAST({src} AS BIGINT), 0L)) AS `{n}`") for n, src in amounts.items()])
    # An end of a probe lies before (0) or behind (2) the points (1) of equal place.
    ends = probes.selectExpr(*part, *probe_id, f"stack(2, CAST(`{low}` AS DOUBLE), 0, CAST(`{high}` AS DOUBLE), 2) AS (_at, _side)")
    spots = ends.select(*part, "_at", "_side").distinct().selectExpr(*part, "_at", "_side", *[f"0L AS `{n}`" for n in names])
    merged = base.selectExpr(*part, "_at", "1 AS _side", *names).unionByName(spots)
    out = running_totals(merged, part, ["_at", "_side"], {n: f"`{n}`" for n in names}, **kw)
    seen = out.where("_side <> 1").select(*part, "_at", "_side", *[f"before_{n}" for n in names])
    return ends.join(seen, [*part, "_at", "_side"]).groupBy(*part, *probe_id).agg(*[
        F.expr(f"sum(CASE WHEN _side = 2 THEN before_{n} ELSE -before_{n} END) AS {'n_in' if n == '_cnt' else n}") for n in names])
