"""Named detectors as functions over all teams at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_anchor, best_per_key

# Fixed values of the detectors.
FIRST_SINCE_STEPS = (8.0, 7.0, 6.0, 5.0, 4.0, 3.0)
FIRST_SINCE_DROUGHT = 5
FIRST_SINCE_PRECEDENTS = 4
CHASE_DEPTH = 15
CHASE_GAPS = {"hr": 6, "hits": 40, "rbi": 25, "sb": 8, "doubles": 12, "so": 40, "saves": 8, "wins": 5}
CLUB_RANK = 12
JOINT_CLUB = 6
WEAK_CEILING = 12.0
MILESTONE_GAP = 2.5
MILESTONE_DEPTH = 20


def ladder(totals: DataFrame, part: list[str], total: str, subject: str, depth: int) -> DataFrame:
    """Best-first places down to ``depth`` with the distance to the place above.

    The depth filter cuts each task's rows before the shuffle; what follows runs
    over at most ``depth`` rows per board.
    """
    order = Window.partitionBy(*part).orderBy(F.desc(total), subject)
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    above = Window.partitionBy(*part).orderBy("rank")
    return top.withColumn("gap", F.lag(total).over(above) - F.col(total)).withColumn("chasing", F.lag(subject).over(above)).withColumn("rank", F.col("rank").cast("bigint"))


def career_chase(board: DataFrame, active: Column, gap_limit: Column) -> DataFrame:
    """Active subjects high on an all-time list: record, chase of the next place, or rank."""
    tier = F.when(F.col("rank") == 1, "record").when((F.col("gap") > 0) & (F.col("gap") <= gap_limit), "chase").otherwise("rank")
    return board.where(active).withColumn("tier", tier)


def milestone_club(totals: DataFrame, part: list[str], total: str, subject: str, active: Column, milestones: list[int], gap_limit: float) -> DataFrame:
    """Nearest active subject below a round milestone, if the club stays exclusive."""
    nxt = F.array_min(F.filter(F.array(*[F.lit(m) for m in milestones]), lambda m: m > F.col(total)))
    near = totals.where(active).withColumn("milestone", nxt).withColumn("gap", F.col("milestone") - F.col(total))
    best = best_per_key(near.where(F.col("gap") <= gap_limit).select(*part, subject, "milestone", "gap"), part, -F.col("gap"), [F.col(subject)])
    sizes = totals.groupBy(*part).agg(*[F.count_if(F.col(total) >= m).alias(f"m{m}") for m in milestones])
    club = sizes.select(*part, F.inline(F.array(*[F.struct(F.lit(m).alias("milestone"), F.col(f"m{m}").alias("club_size")) for m in milestones])))
    return best.join(club, [*part, "milestone"]).where(F.col("club_size") + 1 <= CLUB_RANK)


def joint_club(totals: DataFrame, part: list[str], subject: str, a: str, b: str, steps_a: list[int], steps_b: list[int], active: Column, most: int = JOINT_CLUB) -> DataFrame:
    """Smallest club defined by the floored thresholds of two totals of an active subject.

    All threshold pairs are counted by one aggregate, so no subject meets another.
    """
    pairs = [(x, y) for x in steps_a for y in steps_b]
    sizes = totals.groupBy(*part).agg(*[F.count_if((F.col(a) >= x) & (F.col(b) >= y)).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    grid = sizes.select(*part, F.inline(F.array(*[F.struct(F.lit(x).alias("t_a"), F.lit(y).alias("t_b"), F.col(f"c{i}").alias("club")) for i, (x, y) in enumerate(pairs)])))
    floor_to = lambda col, steps: F.array_max(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= F.col(col)))
    mine = totals.where(active).withColumns({"t_a": floor_to(a, steps_a), "t_b": floor_to(b, steps_b)}).where("t_a IS NOT NULL AND t_b IS NOT NULL")
    clubs = mine.join(grid, [*part, "t_a", "t_b"]).where(F.col("club") <= most)
    return best_per_key(clubs.select(*part, subject, "t_a", "t_b", "club"), part, -F.col("club"), [F.col(subject)])


def first_since(history: DataFrame, team: str, period: str, subject: str, value: str, now: int, steps=FIRST_SINCE_STEPS) -> DataFrame:
    """Highest threshold a season crosses, when it had been long or rarely crossed before."""
    level = lambda col: F.array_max(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= col))
    current = history.where(F.col(period) == now).withColumn("threshold", level(F.col(value))).where(F.col("threshold").isNotNull())
    anchored = asof_anchor(current.select(team, period, subject, value, "threshold"), history, team, period, subject, value, row_value="threshold")
    past = history.where(F.col(period) < now)
    counts = lambda keys: past.groupBy(*keys).agg(*[F.count_if(F.col(value) >= s).alias(f"n{i}") for i, s in enumerate(steps)]).select(
        *keys, F.inline(F.array(*[F.struct(F.lit(s).alias("threshold"), F.col(f"n{i}").alias("k")) for i, s in enumerate(steps)])))
    everyone = counts([team]).withColumnRenamed("k", "_all")
    own = counts([team, subject]).withColumnRenamed("k", "_own")
    got = anchored.join(everyone, [team, "threshold"], "left").join(own, [team, subject, "threshold"], "left")
    got = got.withColumn("precedents", F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0)))
    drought = F.col(period) - F.col("anchor_period")
    return got.where(drought.isNull() | (drought >= FIRST_SINCE_DROUGHT) | (F.col("precedents") <= FIRST_SINCE_PRECEDENTS)).select(
        team, period, subject, value, "threshold", "anchor_period", "precedents")


def profile(percentiles: DataFrame, subject: str, least: int = 4) -> DataFrame:
    """Best and average percentile of subjects with enough of them."""
    return percentiles.groupBy(subject).agg(
        F.count("*").alias("metrics"), F.max_by("metric_id", F.struct(F.col("pct"), F.col("metric_id"))).alias("best_metric"),
        F.max("pct").alias("best"), F.avg("pct").alias("average")).where(F.col("metrics") >= least)


def weakest_tool(percentiles: DataFrame, part: list[str], subject: str, ceiling: float = WEAK_CEILING) -> DataFrame:
    """The lowest percentile of each team's regulars, if it is poor enough."""
    low = percentiles.where(F.col("pct") * 100 <= ceiling).select(*part, subject, "metric_id", "pct")
    return best_per_key(low, part, -F.col("pct"), [F.col(subject), F.col("metric_id")])


def day_extremes(games: DataFrame, team: str, period: str, scored: str, allowed: str) -> DataFrame:
    """Record and extreme margins of each team over one calendar day of all years."""
    margin = F.col(scored) - F.col(allowed)
    return games.groupBy(team).agg(
        F.count_if(margin > 0).alias("wins"), F.count_if(margin <= 0).alias("losses"),
        F.max(margin).alias("best_margin"), F.max_by(period, F.struct(margin, F.col(period))).alias("best_year"),
        F.min(margin).alias("worst_margin"), F.min_by(period, F.struct(margin, F.col(period))).alias("worst_year"))


def on_this_day(rows: DataFrame, day: str, month: int, dom: int, year: int, leap_to_march: bool = False) -> DataFrame:
    """Rows of one calendar day; Feb 29 is read as Mar 1 in other years, if asked."""
    same = (F.month(day) == month) & (F.dayofmonth(day) == dom)
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if leap_to_march and (month, dom) == (3, 1) and not leap:
        same = same | ((F.month(day) == 2) & (F.dayofmonth(day) == 29))
    return rows.where(same)
