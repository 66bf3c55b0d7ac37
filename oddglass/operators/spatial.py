"""Point tables and their summaries, for all subjects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import ordering as O


def grid_mean(rows: DataFrame, keys: list[str], x: Column, z: Column, value: Column, scale: float = 1.0, floor: int = 5) -> DataFrame:
    """3x3 zone grid; a cell with fewer than ``floor`` rows shows no value."""
    inside = rows.where(X.in_zone(x, z))
    got = inside.groupBy(*keys, X.zone_column(x).alias("col"), X.zone_row(z).alias("row")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("_s"))
    return got.select(*keys, "col", "row", "n", F.when(F.col("n") >= floor, X.rnd(F.col("_s") / F.col("n") / scale, 3)).alias("value"))


def region_sum(rows: DataFrame, keys: list[str], x: Column, z: Column, value: Column, swing: Column) -> DataFrame:
    return rows.groupBy(*keys, X.attack_region(x, z).alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), X.r6(F.count_if(swing) / F.count(F.lit(1))).alias("swing_share"))


def rolling_mean(rows: DataFrame, subject: str, order: list[str], value: str, longest: int = 50, shortest: int = 20, **kw) -> DataFrame:
    """Trailing mean over ``min(longest, max(10, n // 4))`` rows, from the first full window on.

    The window length differs per subject, so the mean is the difference of two
    cumulative sums joined on the row number.  A subject with a large share of all
    rows is cut into ordered buckets, each summed in a task of its own.
    """
    cum = O.running_totals(
        rows.select(subject, *order, value), [subject], order, {"s": value, "i": "1L"}, **kw
    )
    n = F.col("whole_i")
    placed = cum.where(n >= shortest).select(
        subject, (F.col("before_i") + 1).alias("x"), (F.col("before_s") + F.col(value)).alias("_to"),
        F.least(F.lit(longest), F.greatest(F.lit(10), F.floor(n / 4))).cast("bigint").alias("w"),
    )
    ends = placed.select(subject, (F.col("x") + F.col("w")).alias("x"), F.col("_to").alias("_from"))
    return (
        placed.where(F.col("x") >= F.col("w")).join(ends, [subject, "x"], "left")
        .select(subject, "x", "w", ((F.col("_to") - F.coalesce(F.col("_from"), F.col("_to") * 0)) / F.col("w")).alias("y"))
    )


# Sample sizes under which a dataset is labelled illustrative.
SMALL_SAMPLE = {"spray": 50, "movement": 200, "hotcold": 150, "batspeed": 100, "rolling": 100, "release": 200, "zone": 100, "launch": 40}
# Which dataset goes with which detector.
COMPANION = {
    "weakness": "hotcold", "cold_streak": "rolling", "hit_streak": "rolling", "barrel_rate": "launch",
    "power_cluster": "launch", "statcast_profile": "swingtake", "xstats_unlucky": "rolling", "pitcher_career_chase": "movement",
}


def small(card: str, n: Column) -> Column:
    return n < SMALL_SAMPLE[card]


def spray(rows: DataFrame, subject: list[str], hc_x: Column, hc_y: Column, stand: Column) -> DataFrame:
    """Field coordinates of each batted ball, and whether it was pulled."""
    x = X.field_x(hc_x)
    pulled = ((stand == "R") & (x < 0)) | ((stand == "L") & (x > 0))
    return rows.where(hc_x.isNotNull() & hc_y.isNotNull()).select(
        *subject, "point_id", "kind", X.rnd(x, 1).alias("x"), X.rnd(X.field_y(hc_y), 1).alias("y"), pulled.alias("pulled"))


def spray_summary(points: DataFrame, subject: list[str]) -> DataFrame:
    n = F.count("*")
    return points.groupBy(*subject).agg(n.alias("n"), X.r6(F.count_if("pulled") / n).alias("pull_rate"), small("spray", n).alias("small"))


def type_summary(rows: DataFrame, keys: list[str], kind: str, measures: dict[str, Column], card: str) -> DataFrame:
    """Mix by type rolled up per subject: number of types at 2 % or more, the primary type
    and its share, and means (sum / count) of the named measures."""
    per = rows.groupBy(*keys, kind).agg(
        F.count("*").alias("_n"),
        *[F.sum(v).alias(f"s_{m}") for m, v in measures.items()], *[F.count(v).alias(f"c_{m}") for m, v in measures.items()])
    # One row per type from here on.
    tot = per.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min_by(kind, F.struct(-F.col("_n"), F.col(kind))).alias("primary_kind"), F.max("_n").alias("_top"),
        F.collect_list("_n").alias("_counts"), *[X.ratio(F.sum(f"s_{m}"), F.sum(f"c_{m}")).alias(m) for m in measures])
    return tot.select(
        *keys, "n", F.size(F.filter("_counts", lambda k: k / F.col("n") >= 0.02)).alias("kinds"), "primary_kind",
        X.r6(F.col("_top") / F.col("n")).alias("primary_share"), *measures, small(card, F.col("n")).alias("small"))


def share_summary(rows: DataFrame, keys: list[str], shares: dict[str, Column], card: str) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("n"), *[X.r6(F.count_if(cond) / n).alias(name) for name, cond in shares.items()], small(card, n).alias("small"))


def companions(findings: DataFrame, datasets: DataFrame) -> DataFrame:
    """Findings beside the dataset that illustrates them, for the same subject and season."""
    card = F.create_map(*[F.lit(k) for pair in COMPANION.items() for k in pair])
    return findings.withColumn("card", card[F.col("detector")]).where(F.col("card").isNotNull()).join(datasets, ["card", "subject_id", "season"])
