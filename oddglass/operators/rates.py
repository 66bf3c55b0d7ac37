"""Rates with explicit denominators, and the aggregates built beside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


SWUNG = one_of("description", X.SWINGS)
MISSED = one_of("description", X.WHIFFS)


@dataclass(frozen=True)
class AggMetric:
    """A rate: how often ``numerator`` holds among rows where ``denominator`` holds (SQL text)."""

    id: str
    numerator: str
    denominator: str
    higher_is_better: bool
    stabilization_n: int
    scale: float = 100.0
    denominator_columns: tuple[str, ...] = ()

    @property
    def floor(self) -> int:
        return max(10, self.stabilization_n // 5)

    def accepts(self, split: "SplitSpec") -> bool:
        """A split on the metric's own denominator column would compare a rate with itself."""
        return split.column not in self.denominator_columns


CHASE_RATE = AggMetric("chase_rate", f"zone > 9 AND {SWUNG}", "zone > 9", False, 250, denominator_columns=("zone_bucket",))
WHIFF_RATE = AggMetric("whiff_rate", MISSED, SWUNG, False, 200)
ZONE_CONTACT = AggMetric(
    "zone_contact", f"zone BETWEEN 1 AND 9 AND {SWUNG} AND NOT ({MISSED})", f"zone BETWEEN 1 AND 9 AND {SWUNG}",
    True, 200, denominator_columns=("zone_bucket",),
)
SWING_RATE = AggMetric("swing_rate", SWUNG, "true", True, 300)
AGG_METRICS = (CHASE_RATE, WHIFF_RATE, ZONE_CONTACT, SWING_RATE)

# The allowed splits; the zone heart is 1-9, the chase zone 11-14.
SPLIT_VALUES: dict[str, dict[str, str]] = {
    "p_throws": {"L": "hand = 'F'", "R": "hand = 'O'"},
    "pitch_class": {name: one_of("pitch_type", codes) for name, codes in X.SPLIT_CLASSES.items()},
    "zone_bucket": {"heart": "zone BETWEEN 1 AND 9", "chase": "zone BETWEEN 11 AND 14"},
}


@dataclass(frozen=True)
class SplitSpec:
    """An allow-listed condition on the event table."""

    column: str
    value: str

    def predicate(self) -> str:
        allowed = SPLIT_VALUES.get(self.column)
        if allowed is None or self.value not in allowed:
            raise ValueError(f"split {self.column}={self.value} is not allowed")
        return allowed[self.value]


CONTRAST_PAIRS = (
    ("platoon", SplitSpec("p_throws", "L"), SplitSpec("p_throws", "R")),
    ("class", SplitSpec("pitch_class", "breaking"), SplitSpec("pitch_class", "fastball")),
    ("zone", SplitSpec("zone_bucket", "chase"), SplitSpec("zone_bucket", "heart")),
)


def ratio_rate(rows: DataFrame, metric: AggMetric, keys: list[str], floor: int | None = None, when: str | None = None) -> DataFrame:
    """``keys, value, n``: one partial-aggregated shuffle, floored on the denominator."""
    if when is not None:
        rows = rows.where(when)
    got = rows.groupBy(*keys).agg(F.expr(f"count_if({metric.numerator}) AS _top"), F.expr(f"count_if({metric.denominator}) AS n"))
    floor = metric.floor if floor is None else floor
    return got.where(f"n >= {floor}").selectExpr(*keys, f"_top * {metric.scale!r}D / n AS value", "n")


def all_rates(rows: DataFrame, metrics=AGG_METRICS, keys: tuple[str, ...] = ("subject_id",), floors: dict[str, int] | None = None, sides: dict[str, str] | None = None) -> DataFrame:
    """Every metric on every named side from one scan: long ``metric_id, side, keys, value, n``.

    All numerators and denominators are conditional counts of one aggregate, so the
    event table is read and shuffled once whatever the number of metrics and splits.
    """
    aggs, cells = [], []
    for m in metrics:
        for side, cond in (sides or {"all": "true"}).items():
            i = len(cells)
            aggs += [F.expr(f"count_if(({m.numerator}) AND ({cond})) AS t{i}"), F.expr(f"count_if(({m.denominator}) AND ({cond})) AS b{i}")]
            cells.append(
                f"named_struct('metric_id', '{m.id}', 'side', '{side}', 'top', t{i}, 'n', b{i}, 'scale', {m.scale!r}D, "
                f"'floor', {(floors or {}).get(m.id, m.floor)}, 'stab', {m.stabilization_n}, 'higher', {str(m.higher_is_better).lower()})")
    long = rows.groupBy(*keys).agg(*aggs).selectExpr(*keys, f"inline(array({', '.join(cells)}))")
    return long.where("n >= floor AND n > 0").selectExpr("metric_id", "side", *keys, "top * scale / n AS value", "n", "stab", "higher")


def split_sides() -> dict[str, str]:
    out = {"all": "true"}
    for _name, a, b in CONTRAST_PAIRS:
        for s in (a, b):
            out[f"{s.column}:{s.value}"] = s.predicate()
    return out


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str, out: str = "mean") -> DataFrame:
    return rows.groupBy(*keys).agg(
        X.ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(out), F.sum(weight).alias("weight")
    )


def career_totals(rows: DataFrame, keys: list[str], value: str, period: str) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.sum(value).alias("total"), F.min(period).alias("first_year"), F.max(period).alias("last_year"))
        .where(F.col("total") > 0)
    )


def coverage_label(measured: Column, qualified: Column, threshold: float = 0.90) -> Column:
    """How the comparison group may honestly be called."""
    m = measured.cast("string")
    return (
        F.when(qualified <= 0, F.concat(m, F.lit(" subjects with event-level data")))
        .when(measured / qualified >= threshold, F.concat(m, F.lit(" subjects (league-wide coverage)")))
        .otherwise(
            F.concat(m, F.lit(" of "), qualified.cast("string"), F.lit(" qualified subjects with event-level data — not the full league"))
        )
    )


def two_level_moves(rows: DataFrame, subject: str, period: str, value: str, year: int, min_prior: int = 1) -> DataFrame:
    """Per subject: this season's value minus the plain mean of the earlier seasons."""
    per = rows.groupBy(subject, period).agg(F.avg(value).alias("v"))
    now, past = F.col(period) == year, F.col(period) < year
    return (
        per.groupBy(subject)
        .agg(
            F.max(F.when(now, F.col("v"))).alias("current"),
            F.avg(F.when(past, F.col("v"))).alias("prior_mean"),
            F.count_if(past).alias("prior_n"),
        )
        .where(F.col("current").isNotNull() & (F.col("prior_n") >= min_prior))
        .withColumn("move", F.col("current") - F.col("prior_mean"))
    )


def league_constant(totals: DataFrame) -> DataFrame:
    """C = league ERA - (13 HR + 3 (BB + HBP) - 2 K) / IP over all pitchers."""
    t = totals.agg(*[F.sum(c).alias(c) for c in ("er", "outs", "hr", "bb", "hbp", "k")])
    ip = F.col("outs") / 3.0
    return t.select(
        X.ratio(F.col("er") * 9.0, ip).alias("league_era"),
        (X.ratio(F.col("er") * 9.0, ip) - X.ratio(13 * F.col("hr") + 3 * (F.col("bb") + F.col("hbp")) - 2 * F.col("k"), ip)).alias("constant"),
    )


def histogram(rows: DataFrame, keys: list[str], value: Column, low: float, high: float, width: float, fast: float | None = None) -> DataFrame:
    """Counts per bin; values are clamped into ``[low, high)`` first."""
    v = F.least(F.greatest(value, F.lit(low)), F.lit(high - 1e-6))
    return rows.groupBy(*keys, (F.floor((v - low) / width) * width + low).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mix_share(rows: DataFrame, keys: list[str], kind: str, floor: float = 0.02) -> DataFrame:
    """Counts and shares per class; classes under ``floor`` are ignored; the largest is marked.

    The window runs over already counted classes, a handful per key.
    """
    per = Window.partitionBy(*keys)
    return (
        rows.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n") / F.sum("n").over(per))
        .where(F.col("share") >= floor)
        .withColumn("is_primary", F.row_number().over(per.orderBy(F.desc("n"), kind)) == 1)
    )


def windowed_agg(rows: DataFrame, keys: list[str], day: str, value: str, as_of: Column, days: int, floor: int, how: str = "avg") -> DataFrame:
    """AVG or SUM from ``days`` days before ``as_of`` to ``as_of``, both included, floored on the row count."""
    recent = rows.where((F.col(day) >= F.date_sub(as_of, days)) & (F.col(day) <= as_of))
    agg = F.sum(value) / F.count(value) if how == "avg" else F.sum(value)
    return recent.groupBy(*keys).agg(agg.alias("value"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= floor)
