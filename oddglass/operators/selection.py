"""Values at stated ranks without a full order.

To read a population at some of its ranks, only the stretches that hold those ranks need an order.
Rows are placed in ordered buckets (any cut will do), the buckets are counted, and a cumulative
count over the buckets says which of them hold an asked rank; the others are never ordered.  Equal
values are counted once first, so a value that holds a third of all rows is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .ordering import MOST_CUTS, PICK_ONE_IN, SPREAD, _cut_points, _names


def _in_buckets(counts: DataFrame, part: list[str], one_in: int, most: int) -> DataFrame:
    """``counts`` (part, _v, _c) with ``_b``, the ordered bucket of each value."""
    rows = counts.selectExpr("*", "struct(_v) AS _k")
    cuts = _cut_points(rows, part, one_in, most)
    if part:
        spread = cuts.selectExpr("*", f"explode(sequence(0, {SPREAD - 1})) AS _s")
        cut = rows.selectExpr("*", f"CAST(pmod(xxhash64(_k), {SPREAD}) AS INT) AS _s").join(spread, [*part, "_s"], "left")
    else:
        cut = rows.withColumn("_cuts", cuts.scalar())
    return cut.selectExpr(*[f"`{p}`" for p in part], "_v", "_c", "CASE WHEN _cuts IS NULL THEN 0 ELSE size(filter(_cuts, c -> c <= _k)) END AS _b")


def values_at_ranks(
    df: DataFrame, part: list[str], value: str, asked: DataFrame, rank: str = "rank", *,
    descending: bool = False, out: str = "at_rank", one_in: int = PICK_ONE_IN, most: int = MOST_CUTS,
) -> DataFrame:
    """``asked`` (part and a 1-based ``rank``) with the value that stands there and the population's size.

    Ties share a value, so the value at a rank does not depend on their order.  A rank beyond the
    population, or of an unknown one, has none; a null rank has none either.
    """
    turned = f"-CAST(`{value}` AS DOUBLE)" if descending else f"CAST(`{value}` AS DOUBLE)"
    counts = df.where(F.col(value).isNotNull()).groupBy(*part, F.expr(f"{turned} AS _v")).agg(F.expr("count(1) AS _c"))
    placed = settle(_in_buckets(counts, part, one_in, most))
    # A bounded number of buckets per key: their cumulative count is a window over at most ``most`` rows.
    by = f"PARTITION BY {_names(part)}" if part else ""
    buckets = placed.groupBy(*part, "_b").agg(F.sum("_c").alias("_m")).selectExpr(
        *[f"`{p}`" for p in part], "_b", "_m", f"sum(_m) OVER ({by} ORDER BY _b) - _m AS _from", f"sum(_m) OVER ({by}) AS pop_n")
    want = asked.select(*part, rank).where(F.col(rank) >= 1).distinct()
    both = want.join(buckets, part) if part else want.join(F.broadcast(buckets))  # at most ``most`` rows
    hold = settle(both.where((F.col(rank) > F.col("_from")) & (F.col(rank) <= F.col("_from") + F.col("_m"))))
    opened = placed.join(hold.select(*part, "_b", "_from").distinct(), [*part, "_b"])
    inside = f"PARTITION BY {_names([*part, '_b'])}"
    starts = opened.selectExpr(*[f"`{p}`" for p in part], "_b", "_v", f"_from + sum(_c) OVER ({inside} ORDER BY _v) - _c + 1 AS _at", "0 AS _kind")
    asks = hold.selectExpr(*[f"`{p}`" for p in part], "_b", "CAST(NULL AS DOUBLE) AS _v", f"`{rank}` AS _at", "1 AS _kind")
    # The value at a rank is the last one that starts at it or before.
    read = starts.unionByName(asks).selectExpr(*[f"`{p}`" for p in part], "_at", "_kind", f"last(_v, true) OVER ({inside} ORDER BY _at, _kind) AS _v")
    sign = "-" if descending else ""
    found = read.where("_kind = 1").selectExpr(*[f"`{p}`" for p in part], f"_at AS `{rank}`", f"{sign}_v AS `{out}`")
    sizes = buckets.select(*part, "pop_n").distinct()
    answered = asked.join(found, [*part, rank], "left")
    return answered.join(sizes, part, "left") if part else answered.join(F.broadcast(sizes), how="left")


def quantile_table(df: DataFrame, part: list[str], value: str, steps: int = 100, **kw) -> DataFrame:
    """(part, cuts): the values at ranks ceil(q n / steps) for q = 1 .. steps - 1, as an array."""
    n = df.where(F.col(value).isNotNull()).groupBy(*part).agg(F.count("*").alias("_n"))
    asked = n.selectExpr(*[f"`{p}`" for p in part], f"explode(transform(sequence(1, {steps - 1}), q -> struct(q, CAST(ceil(q * _n / {float(steps)}D) AS BIGINT) AS rank))) AS _q").selectExpr(
        *[f"`{p}`" for p in part], "_q.q AS q", "_q.rank AS rank")
    got = values_at_ranks(df, part, value, asked, **kw)
    return got.groupBy(*part).agg(F.expr("transform(array_sort(collect_list(struct(q, at_rank))), x -> x.at_rank) AS cuts"))


def percentile_from(cuts: str, value: str) -> F.Column:
    """How many of the cuts a value lies above: its percentile in whole steps."""
    return F.expr(f"size(filter(`{cuts}`, q -> q < CAST(`{value}` AS DOUBLE)))")
