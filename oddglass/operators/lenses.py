"""Rarity lenses over the long metric table, false-discovery control, causal checks.

``rows`` has ``metric_id, subject_id, value, n, higher, stab`` and any period
columns; ``part`` names the columns of one population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import settle
from . import ordering as O

EXTREME_FLOOR = 0.80
ELITE_PERCENTILE = 85.0
PROXIMITY = 0.10


MOVE_UNITS = 1e9  # moves are summed in whole parts of this size


def exact_mean(value: Column) -> Column:
    """A mean that does not depend on the order of the rows."""
    return F.sum(F.round(value * MOVE_UNITS).cast("bigint")) / MOVE_UNITS / F.count(value)


def extremeness(rows: DataFrame, part: list[str], floor: float = EXTREME_FLOOR) -> DataFrame:
    """Percentile in the population, shrunk toward one half by the subject's own sample."""
    ranked = O.ecdf(rows, part, "value", better="higher")
    rarity = "least(greatest(0.5D + (pct - 0.5D) * least(1.0D, n / stab), 0.0D), 1.0D)"
    enough = ranked.where("pop_n >= 10 AND n >= greatest(10, floor(stab / 5))")
    return enough.selectExpr("*", f"{rarity} AS rarity", "'extremeness' AS lens").where(f"rarity >= {floor}")


def rank(rows: DataFrame, part: list[str], subject: str = "subject_id") -> DataFrame:
    """Top quartile, at most 15 deep: only those rows are ever ordered."""
    sign = F.when(F.col("higher"), -F.col("value")).otherwise(F.col("value"))
    sizes = rows.groupBy(*part).agg(F.count("*").alias("pop_n"))
    w = Window.partitionBy(*part).orderBy("_o", subject)
    top = rows.withColumn("_o", sign).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 15).drop("_o")
    cutoff = F.least(F.lit(15), F.greatest(F.lit(1), F.floor(F.col("pop_n") / 4)))
    return (
        top.join(sizes, part).where(F.col("rank") <= cutoff)
        .withColumn("rarity", F.greatest(F.lit(0.0), 1.0 - (F.col("rank") - 1) / cutoff)).withColumn("lens", F.lit("rank"))
    )


def pace(rows: DataFrame, value: str, games: str, season_games: int, milestone: float) -> DataFrame:
    run = F.col(value) * season_games / F.col(games)
    rarity = F.when(F.col(value) >= milestone, F.lit(0.95)).when(
        run >= milestone, F.least(F.lit(0.90), 0.5 + (run - milestone) / F.greatest(F.lit(milestone), F.lit(1.0))))
    live = rows.where((F.col(games) >= 10) & (F.col(games) < season_games))
    return live.withColumn("pace", run).withColumn("rarity", rarity).where(F.col("rarity").isNotNull()).withColumn("lens", F.lit("pace"))


def milestone_proximity(rows: DataFrame, value: str, milestones: list[float], proximity: float = PROXIMITY) -> DataFrame:
    laid = rows.withColumn("milestone", F.explode(F.array(*[F.lit(float(m)) for m in milestones if m > 0])))
    away = (F.col("milestone") - F.col(value)) / F.col("milestone")
    near = laid.where((away > 0) & (away <= proximity))
    return near.withColumn("rarity", 0.80 + 0.15 * (1.0 - away / proximity)).withColumn("lens", F.lit("milestone_proximity"))


def percentile_elite(rows: DataFrame, percentile: Column, threshold: float = ELITE_PERCENTILE) -> DataFrame:
    """For values already oriented as 0-100 percentiles."""
    return (
        rows.withColumn("percentile", percentile).where(F.col("percentile") >= threshold)
        .withColumn("rarity", F.least(F.col("percentile") / 100.0, F.lit(0.99))).withColumn("lens", F.lit("percentile_elite"))
    )


def bh(rows: DataFrame, family: list[str], p: str, ties: list[str], alpha: float = 0.05, mode: str = "per_rank") -> DataFrame:
    """Benjamini-Hochberg within each family.

    ``per_rank`` keeps every rank that passes its own line, ``step_up`` all ranks up
    to the largest passing one.
    """
    # The hits are few beside the population they came from; written once, they are
    # read by each branch below without running the lenses again.
    placed = O.ordinal(settle(rows), family, [p, *ties], out="bh_rank", size="bh_m")
    own = F.col(p) <= F.col("bh_rank") / F.col("bh_m") * alpha
    if mode == "per_rank":
        return placed.withColumn("survives", own)
    if mode != "step_up":
        raise ValueError(f"unknown mode {mode}")
    last = placed.where(own).groupBy(*family).agg(F.max("bh_rank").alias("_last"))
    return placed.join(last, family, "left").withColumn("survives", F.coalesce(F.col("bh_rank") <= F.col("_last"), F.lit(False))).drop("_last")


def bh_feasible(population: Column, battery: Column, alpha: float = 0.05) -> Column:
    return (population > 0) & (battery > 0) & (1.0 / F.when(population > 0, population) <= alpha / F.when(battery > 0, battery))


def expected_false(battery: Column, floor: float) -> Column:
    return battery * max(0.0, 1.0 - floor)


def cohort_drift(moves: DataFrame, move: str = "move", least: int = 20) -> DataFrame:
    """One row: mean and sample SD of the cohort's moves, if it is large enough."""
    return moves.agg(F.avg(move).alias("drift"), F.stddev_samp(move).alias("sd"), F.count(move).alias("cohort")).where(
        (F.col("cohort") >= least) & (F.col("sd") > 0))


def career_shift(moves: DataFrame, least_cohort: int = 30, gate: float = 1.8) -> DataFrame:
    """Own move net of the league's, in cohort SDs.  ``moves`` has ``move`` per subject."""
    from .joins import attach_row
    league = moves.agg(exact_mean(F.col("move")).alias("league_move"), F.stddev_pop("move").alias("sd"), F.count("*").alias("cohort"))
    net = attach_row(moves, league.where((F.col("cohort") >= least_cohort) & (F.col("sd") > 0)))
    net = net.withColumn("net", F.col("move") - F.col("league_move")).withColumn("z", F.col("net") / F.col("sd"))
    return net.where(F.abs("z") >= gate)


def shift_rarity(moves: DataFrame, cap: float = 0.95) -> DataFrame:
    """Share of the cohort that moved less (net of the league), at most ``cap``."""
    from .joins import attach_row
    league = moves.agg(exact_mean(F.col("move")).alias("league_move"))
    sized = attach_row(moves, league).withColumn("_abs", F.round(F.abs(F.col("move") - F.col("league_move")), 9))
    return O.ecdf(sized, [], "_abs", out="_beaten").withColumn("rarity", F.least(F.lit(cap), F.col("_beaten"))).drop("_abs", "_beaten")


def self_surprise(delta: Column, full: float = 0.150) -> Column:
    return 0.8 + F.least(F.lit(0.7), F.abs(delta) / full * 0.7)


def matched_control(
    pairs: DataFrame, probes: DataFrame, subject: str, *, gap_within: int, level_within: int, control_gap: int,
) -> DataFrame:
    """Next-season moves of similar gaps against similar levels without a gap.

    ``pairs`` holds ``subject, gap_u, level_u, move`` and ``probes`` one row per
    subject with ``gap_u, level_u``; gaps and levels are whole millionths.  Both
    cohorts are ranges over one ordered column, so they come from cumulative sums;
    a subject's own seasons (a few) are then taken out again by an equi-join.
    """
    pairs, probes = settle(pairs), settle(probes)  # each is read by several branches
    # Moves are summed as whole billionths: totals and their differences are exact in any order.
    up = pairs.withColumns({"up": (F.col("move") > 0).cast("bigint"), "move_n": F.round(F.col("move") * MOVE_UNITS).cast("bigint")})
    # Both ranges go through one cumulative sum, told apart by the part.
    points = up.select(F.lit("gap").alias("part"), F.col("gap_u").alias("at"), "move_n", "up").unionAll(
        up.where(F.abs("gap_u") <= control_gap).select(F.lit("level").alias("part"), F.col("level_u").alias("at"), "move_n", "up"))
    ask = lambda part, col, within: probes.select(
        F.lit(part).alias("part"), subject, (F.col(col) - within).alias("lo"), (F.col(col) + within).alias("hi"))
    asked = ask("gap", "gap_u", gap_within).unionAll(ask("level", "level_u", level_within))
    got = O.range_totals(points, asked, ["part"], "at", {"move_in": "move_n", "up_in": "up"}, "lo", "hi", [subject], few_parts=True)
    own = up.withColumnsRenamed({"gap_u": "g", "level_u": "l"}).join(probes, subject)
    near = F.abs(F.col("g") - F.col("gap_u")) <= gap_within
    calm = (F.abs(F.col("l") - F.col("level_u")) <= level_within) & (F.abs("g") <= control_gap)
    mine = own.groupBy(subject).agg(*[
        F.coalesce(F.sum(F.when(cond, val)), F.lit(0)).alias(f"{kind}_{name}")
        for kind, cond in (("t", near), ("c", calm))
        for name, val in (("n", F.lit(1)), ("m", F.col("move_n")), ("u", F.col("up")))])
    one = lambda part, name: F.max(F.when(F.col("part") == part, F.col(name)))
    wide = got.groupBy(subject).agg(*[one(p, n).alias(k) for p, a in (("gap", "t"), ("level", "c")) for n, k in (("n_in", f"{a}n"), ("move_in", f"{a}m"), ("up_in", f"{a}u"))])
    out = probes.join(wide, subject, "left").join(mine, subject, "left")
    less = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    out = out.withColumns({"treated_n": less("tn", "t_n").cast("bigint"), "control_n": less("cn", "c_n").cast("bigint")})
    mean = lambda a, b, n: X.ratio(less(a, b).cast("double"), F.col(n))
    return out.withColumns({
        "treated_mean": mean("tm", "t_m", "treated_n") / MOVE_UNITS, "control_mean": mean("cm", "c_m", "control_n") / MOVE_UNITS,
        "treated_up": mean("tu", "t_u", "treated_n"), "control_up": mean("cu", "c_u", "control_n"),
    }).select(*probes.columns, "treated_n", "control_n", "treated_mean", "control_mean", "treated_up", "control_up").withColumn(
        "net", F.col("treated_mean") - F.col("control_mean"))


def year_over_year_z(now: DataFrame, then: DataFrame, subject: str, least: int = 30) -> DataFrame:
    """Own change in a rate divided by the population SD of everyone's changes."""
    from .joins import attach_row
    moves = now.join(then.select(subject, F.col("value").alias("prior_value")), subject).withColumn("delta", F.col("value") - F.col("prior_value"))
    spread = moves.agg(F.stddev_pop("delta").alias("sd"), F.count("*").alias("cohort")).where(F.col("cohort") >= least)
    return attach_row(moves, spread).withColumn("z", F.when(F.col("sd") > 0, F.col("delta") / F.col("sd")).otherwise(0.0))
