"""Streaks, window splits, top-k rules.  Per-key windows run only over rows that a
top-k filter or an aggregate has already bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def active_run(games: DataFrame, subject: str, day: str, ab: str, hits: str, *, hitless: bool = False) -> DataFrame:
    """Length of the run still going at each subject's end: games with a hit, or without.

    Games without an at-bat count neither way.  The day of the last break comes from
    one aggregate; the run is what lies after it.  ``day`` must be unique per subject.
    """
    counted = games.where(F.col(ab) > 0)
    good = (F.col(hits) == 0) if hitless else (F.col(hits) >= 1)
    broke = counted.groupBy(subject).agg(F.max(F.when(~good, F.col(day))).alias("_broke"))
    after = counted.join(broke, subject).where(F.col("_broke").isNull() | (F.col(day) > F.col("_broke")))
    return after.groupBy(subject).agg(
        F.count("*").alias("games"), F.sum(ab).alias("ab"), F.min(day).alias("since"), F.max(day).alias("last"))


def last_games_split(games: DataFrame, subject: str, order: list[str], size: int, sums: dict[str, Column]) -> DataFrame:
    """Totals over the last ``size`` rows and the ``size`` before them, where both are full."""
    w = Window.partitionBy(subject).orderBy(*[F.desc(o) for o in order])
    recent_rows = games.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 2 * size)  # cut before the shuffle
    recent = F.col("_k") <= size
    return (
        recent_rows.groupBy(subject)
        .agg(
            F.count("*").alias("_n"),
            *[F.sum(F.when(~recent, v)).alias(f"{n}_prior") for n, v in sums.items()],
            *[F.sum(F.when(recent, v)).alias(f"{n}_recent") for n, v in sums.items()],
        )
        .where(F.col("_n") == 2 * size).drop("_n")
    )


def last_events_halves(events: DataFrame, subject: str, order: list[str], value: str, window: int, least: int) -> DataFrame:
    """Mean, variance and size of the two halves of the last ``2 * window`` events."""
    w = Window.partitionBy(subject).orderBy(*[F.desc(o) for o in order])
    tail = events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 2 * window)
    size = F.max("_k").over(Window.partitionBy(subject))  # at most 2 * window rows per subject here
    halved = tail.withColumn("_len", size).withColumn("_prior", F.col("_k") > F.col("_len") - F.floor(F.col("_len") / 2))
    v = F.col(value).cast("double")
    out = halved.groupBy(subject).agg(
        *[agg(F.when(cond, v)).alias(f"{name}{tag}") for tag, cond in (("0", F.col("_prior")), ("1", ~F.col("_prior")))
          for name, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    return out.where(F.least("n0", "n1") >= least)


def two_proportion(r0: Column, n0: Column, r1: Column, n1: Column) -> tuple[Column, Column]:
    """(difference, confidence that the two rates differ) by the pooled z-test."""
    p = X.ratio(r0 + r1, n0 + n1)
    se = F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    delta = r1 / n1 - r0 / n0
    z = F.when(se > 0, delta / se).otherwise(0.0)
    return delta, X.two_sided_confidence(z)


def welch(m0: Column, v0: Column, n0: Column, m1: Column, v1: Column, n1: Column) -> tuple[Column, Column]:
    se = F.sqrt(v0 / n0 + v1 / n1)
    delta = m1 - m0
    return delta, F.when(se > 0, X.two_sided_confidence(delta / se)).otherwise(0.0)


def top_with_focal(rows: DataFrame, part: list[str], order: list[Column], focal: Column, k: int = 10, within: int = 25) -> DataFrame:
    """Top ``k``, extended down to the first focal row; only boards with a focal row in the top ``within``."""
    w = Window.partitionBy(*part).orderBy(*order)
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= within).withColumn("is_focal", focal)
    first = F.min(F.when(F.col("is_focal"), F.col("rank"))).over(Window.partitionBy(*part))  # at most `within` rows
    return top.withColumn("_f", first).where(F.col("_f").isNotNull() & (F.col("rank") <= F.greatest(F.lit(k), F.col("_f")))).drop("_f")


def first_focal_in_top(rows: DataFrame, part: list[str], order: list[Column], focal: Column, slice_size: int = 25, within: int = 10) -> DataFrame:
    """The best-placed focal row of each board, if it lies in the top ``within``."""
    w = Window.partitionBy(*part).orderBy(*order)
    top = rows.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= slice_size)).where(focal)
    rest = [c for c in top.columns if c not in part]
    best = top.groupBy(*part).agg(F.min_by(F.struct(*rest), "rank").alias("_r")) if part else top.agg(F.min_by(F.struct(*rest), "rank").alias("_r"))
    return best.select(*part, "_r.*").where(F.col("rank") <= within)


def bottom_with_forced_focal(rows: DataFrame, part: list[str], order: list[Column], focal: Column, k: int = 10) -> DataFrame:
    """The first ``k`` rows; if no focal row is among them the last gives way to the focal one.

    Meant for boards of teams: a board holds one row per team, a bounded handful.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("is_focal", focal)
    has = F.max((F.col("is_focal") & (F.col("rank") <= k)).cast("int")).over(Window.partitionBy(*part))
    first = F.min(F.when(F.col("is_focal"), F.col("rank"))).over(Window.partitionBy(*part))
    kept = ranked.withColumn("_has", has).withColumn("_first", first)
    inside = F.col("rank") <= F.when((F.col("_has") == 1) | F.col("_first").isNull(), k).otherwise(k - 1)
    forced = (F.coalesce(F.col("_has"), F.lit(0)) == 0) & (F.col("rank") == F.col("_first"))
    return kept.where(inside | forced).drop("_has", "_first")


def topk_with_exploration(rows: DataFrame, item: str, adjusted: str, raw: str, k: int, reserved: int) -> DataFrame:
    """``reserved`` slots by raw score first, the rest by adjusted score, ``k`` in all."""
    reserved = min(reserved, k)
    explore = rows.orderBy(F.desc(raw), item).limit(reserved)
    best = rows.orderBy(F.desc(adjusted), item).limit(k)
    both = explore.withColumn("_slot", F.lit(0)).unionByName(best.withColumn("_slot", F.lit(1)))
    once = both.groupBy(*rows.columns).agg(F.min("_slot").alias("_slot"))
    slots = Window.orderBy("_slot", F.when(F.col("_slot") == 0, -F.col(raw)).otherwise(-F.col(adjusted)), item)  # at most 2k rows
    return once.withColumn("slot", F.row_number().over(slots)).where(F.col("slot") <= k).withColumn("explored", F.col("_slot") == 0).drop("_slot")


def cooldown(emitted: DataFrame, subject: str, day: str, days: int) -> DataFrame:
    """Per subject and day: was the same subject featured in the ``days`` before?

    Days are made distinct first, so a subject's window holds calendar days, not rows.
    """
    per = emitted.select(subject, day).distinct()
    before = F.lag(day).over(Window.partitionBy(subject).orderBy(day))
    gap = F.datediff(F.col(day), before)
    return per.withColumn("gap", gap).withColumn("suppressed", F.coalesce(F.col("gap") <= days, F.lit(False)))


def games_back(standings: DataFrame, division: str, team: str, wins: str, losses: str) -> DataFrame:
    """Half games behind the division leader (a division holds a handful of teams)."""
    pct = X.ratio(F.col(wins), F.col(wins) + F.col(losses))
    w = Window.partitionBy(division).orderBy(F.desc(pct), F.desc(wins), team)
    led = standings.withColumn("_lw", F.first(wins).over(w)).withColumn("_ll", F.first(losses).over(w))
    return led.withColumn("rank", F.row_number().over(w)).withColumn(
        "games_back", ((F.col("_lw") - F.col(wins)) + (F.col(losses) - F.col("_ll"))) / 2).drop("_lw", "_ll")
