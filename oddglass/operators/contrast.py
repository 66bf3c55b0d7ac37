"""Split contrasts: both sides of a split from one aggregate, gaps ranked by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import ordering as O
from .rates import AggMetric, SplitSpec

MIN_SIDE = 60
MIN_POPULATION = 40
CONTRAST_FLOOR = 0.85


def two_sides(rows: DataFrame, metric: AggMetric, a: SplitSpec, b: SplitSpec, keys: list[str], floor: int = MIN_SIDE) -> DataFrame:
    """``a_value, b_value, a_n, b_n`` of subjects that qualify on both sides."""
    got = all_contrasts(rows, (metric,), (("pair", a, b),), keys, floor)
    return got.select(*keys, "a_value", "b_value", "a_n", "b_n")


def all_contrasts(rows: DataFrame, metrics, pairs, keys: list[str], floor: int = MIN_SIDE) -> DataFrame:
    """Every coherent metric x pair in one scan: long ``metric_id, pair, keys, a_value, ...``.

    A subject seen on one side only has no gap and is left out.
    """
    cells, aggs = [], []
    for m in metrics:
        for name, a, b in pairs:
            if not (m.accepts(a) and m.accepts(b)):
                continue
            i = len(cells)
            for side, s in (("a", a), ("b", b)):
                aggs += [
                    F.expr(f"count_if(({m.numerator}) AND ({s.predicate()})) AS t{side}{i}"),
                    F.expr(f"count_if(({m.denominator}) AND ({s.predicate()})) AS n{side}{i}")]
            cells.append(
                f"named_struct('metric_id', '{m.id}', 'pair', '{name}', 'scale', {m.scale!r}D, 'stab', {m.stabilization_n}, "
                f"'ta', ta{i}, 'a_n', na{i}, 'tb', tb{i}, 'b_n', nb{i})")
    long = rows.groupBy(*keys).agg(*aggs).selectExpr(*keys, f"inline(array({', '.join(cells)}))").where(f"a_n >= {floor} AND b_n >= {floor}")
    return long.selectExpr("metric_id", "pair", *keys, "stab", "ta * scale / a_n AS a_value", "tb * scale / b_n AS b_value", "a_n", "b_n")


def split_contrast_lens(contrasts: DataFrame, part: list[str], floor: float = CONTRAST_FLOOR, min_population: int = MIN_POPULATION) -> DataFrame:
    """Rank the size of each gap in its own distribution; shrink by the weaker side."""
    gaps = contrasts.withColumn("gap", F.abs(F.round(F.col("a_value") - F.col("b_value"), 9)))
    ranked = O.ecdf(gaps, part, "gap", out="gap_percentile")
    weaker = F.least("a_n", "b_n")
    rarity = X.between01(0.5 + (F.col("gap_percentile") - 0.5) * F.least(F.lit(1.0), weaker / F.col("stab")))
    return ranked.where(F.col("pop_n") >= min_population).withColumn("rarity", rarity).where(F.col("rarity") >= floor)
