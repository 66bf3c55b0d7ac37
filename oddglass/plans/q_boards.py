"""Registered queries: all leaderboards (D3) and the team panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import ordering as O
from ..operators import windows as W
from ..operators.joins import best_per_key
from .q_detectors import NOW, PLAYER_LUCK, with_league
from .q_scalars import PITCHING_SQL, pitching
from .registry import query
from .roles import in_years

c = F.col


@dataclass(frozen=True)
class Board:
    """A leaderboard: its statistic over a population's totals, how it is written, and which end leads."""

    stat: str
    group: str
    value: str
    shown: str  # whole, average (three places, no leading zero) or runs (two places)
    low: bool = False


# Names of the statistics, and how each is written.
BOARDS = (
    Board("hits", "hitting", "hits", "whole"), Board("atBats", "hitting", "ab", "whole"), Board("walks", "hitting", "bb", "whole"), Board("games", "hitting", "days", "whole"),
    Board("battingAverage", "hitting", "hits / ab", "average"), Board("onBasePercentage", "hitting", "(hits + bb) / (ab + bb)", "average"),
    Board("onBasePlusSlugging", "hitting", "hits / ab + (hits + bb) / (ab + bb)", "average"), Board("runs", "hitting", "floor(price_c / 100)", "whole"),
    Board("earnedRunAverage", "pitching", "er * 27 / outs", "runs", True), Board("whip", "pitching", "(bb + hr) * 3 / outs", "runs", True),
    Board("strikeOuts", "pitching", "k", "whole"), Board("wins", "pitching", "er", "whole"),
)
HITTERS_SQL = f"(SELECT subject_id, c_nationkey = 0 AS is_focal, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(bb) AS BIGINT) AS bb, count(*) AS days, CAST(sum(price_c) AS BIGINT) AS price_c FROM @games JOIN customer ON c_custkey = subject_id WHERE year(game_date) = {NOW} GROUP BY 1, 2)"
PITCHERS_SQL = f"(SELECT p.*, s_nationkey < 5 AS is_focal FROM ({PITCHING_SQL}) p JOIN supplier ON s_suppkey = subject_id)"
SHOWN_SQL = "CASE shown WHEN 'whole' THEN CAST(CAST(v AS BIGINT) AS VARCHAR) WHEN 'runs' THEN printf('%.2f', round(v, 2)) ELSE regexp_replace(printf('%.3f', round(v, 3)), '^0', '') END"


def boards_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{b.stat}' AS stat, '{b.shown}' AS shown, subject_id, is_focal, CAST({b.value} AS DOUBLE) AS v, {'' if b.low else '-'}CAST({b.value} AS DOUBLE) AS o FROM {HITTERS_SQL if b.group == 'hitting' else PITCHERS_SQL} AS p" for b in BOARDS)
    return f"""SELECT stat, subject_id, rank, is_focal, {SHOWN_SQL} AS shown FROM (SELECT *, min(CASE WHEN is_focal THEN rank END) OVER (PARTITION BY stat) AS f FROM (
 SELECT *, row_number() OVER (PARTITION BY stat ORDER BY o, subject_id) AS rank FROM ({parts})) WHERE rank <= 25) WHERE f IS NOT NULL AND rank <= greatest(10, f)"""


def long_boards(rows, group: str):
    """Every board of a group in one pass over its totals."""
    own = [b for b in BOARDS if b.group == group]
    cell = lambda b: F.struct(F.lit(b.stat).alias("stat"), F.lit(b.shown).alias("shown"), F.expr(b.value).cast("double").alias("v"), F.lit(b.low).alias("low"))
    return rows.select("subject_id", "is_focal", F.inline(F.array(*[cell(b) for b in own])))


@query("D3b_all_leaderboards", boards_sql())
def d3b(t):
    """Twelve boards over two populations: top ten, on to the first focal subject, where one is in the top 25."""
    games = in_years(t.orders, "o_orderdate", NOW).groupBy(c("o_custkey").alias("subject_id"), c("o_orderdate").cast("date").alias("day")).agg(
        F.count("*").alias("ab"), F.count_if(c("o_orderstatus") == "F").alias("hits"), F.count_if(c("o_orderpriority") == "1-URGENT").alias("bb"), F.sum(F.floor(c("o_totalprice") * 100 + 0.5)).alias("price_c"))
    team = t.customer.select(c("c_custkey").alias("subject_id"), (c("c_nationkey") == 0).alias("is_focal"))
    hitters = games.join(team, "subject_id").groupBy("subject_id", "is_focal").agg(*[F.sum(k).alias(k) for k in ("hits", "ab", "bb", "price_c")], F.count("*").alias("days"))
    club = t.supplier.select(c("s_suppkey").alias("subject_id"), (c("s_nationkey") < 5).alias("is_focal"))
    rows = long_boards(hitters, "hitting").unionByName(long_boards(pitching(t).join(club, "subject_id"), "pitching"))
    key = F.when(c("low"), c("v")).otherwise(-c("v"))
    top = W.top_with_focal(rows.withColumn("focal", c("is_focal")).drop("is_focal"), ["stat"], [key, c("subject_id")], c("focal"))
    written = F.when(c("shown") == "whole", c("v").cast("bigint").cast("string")).when(c("shown") == "runs", F.format_string("%.2f", X.rnd("v", 2))).otherwise(
        F.regexp_replace(F.format_string("%.3f", X.rnd("v", 3)), "^0", ""))
    return top.select("stat", "subject_id", c("rank").cast("bigint").alias("rank"), "is_focal", written.alias("shown"))


# ---- panels -------------------------------------------------------------------
# The bars' statistics and labels, and whether more is better.
BARS = (("est_woba", "xwOBA", True), ("hard_hit_percent", "Hard-Hit%", True), ("brl_percent", "Barrel%", True), ("chase_percent", "Chase%", False), ("k_percent", "K%", False))
DAILY = 12
BAR_SQL = " UNION ALL ".join(f"SELECT subject_id, team, '{label}' AS label, {i} AS place, {'' if high else '-'}{m} AS v FROM @stats WHERE year = {NOW} AND pa >= 40 AND {m} IS NOT NULL" for i, (m, label, high) in enumerate(BARS, 1))


@query("G12b_team_panels", f"""SELECT 'daily' AS panel, team, CAST(game_date AS VARCHAR) AS label, place, round(rate, 6) AS value FROM (SELECT team, game_date, rate, row_number() OVER (PARTITION BY team ORDER BY game_date DESC) AS place FROM (SELECT c_nationkey AS team, game_date, sum(hits) / sum(ab) AS rate FROM @games JOIN customer ON c_custkey = subject_id WHERE year(game_date) = {NOW} GROUP BY 1, 2 HAVING sum(ab) > 0)) WHERE place <= {DAILY}
 UNION ALL SELECT 'contact', team, CAST(subject_id AS VARCHAR), place, round(exit_velocity, 6) FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round_even(exit_velocity, 9) DESC, subject_id) AS place FROM @stats WHERE year = {NOW} AND pa >= 40) WHERE place <= 5
 UNION ALL SELECT 'percentile', b.team, label, place, round(100 * pct, 0) FROM (SELECT *, (rank() OVER (PARTITION BY label ORDER BY v) - 1) / count(*) OVER (PARTITION BY label) AS pct FROM ({BAR_SQL})) b
  JOIN (SELECT team, subject_id FROM {PLAYER_LUCK} QUALIFY row_number() OVER (PARTITION BY team ORDER BY abs(owed) DESC, subject_id) = 1) p ON p.subject_id = b.subject_id""")
def g12b(t):
    """For each team: its rate on its last twelve days, its five hardest hitters, and the percentile bars of
    the player who is owed (or owes) most."""
    who = t.customer.select(c("c_custkey").alias("subject_id"), c("c_nationkey").alias("team"))
    now = t.games.where(F.year("game_date") == NOW).join(who, "subject_id").groupBy("team", "game_date").agg(F.sum("hits").alias("h"), F.sum("ab").alias("ab")).where("ab > 0")
    last = Window.partitionBy("team").orderBy(F.desc("game_date"))
    panel = lambda df, name, label, value: df.select(F.lit(name).alias("panel"), "team", label.cast("string").alias("label"), c("place").cast("bigint").alias("place"), value.alias("value"))
    daily = panel(now.withColumn("place", F.row_number().over(last)).where(c("place") <= DAILY), "daily", c("game_date"), X.r6(c("h") / c("ab")))
    s = t.stats_in(NOW).where("pa >= 40")
    hardest = Window.partitionBy("team").orderBy(F.desc(F.bround("exit_velocity", 9)), "subject_id")
    contact = panel(s.withColumn("place", F.row_number().over(hardest)).where("place <= 5"), "contact", c("subject_id"), X.r6("exit_velocity"))
    cells = [F.struct(F.lit(label).alias("metric"), F.lit(i).alias("place"), (c(m) if high else -c(m)).alias("v")) for i, (m, label, high) in enumerate(BARS, 1)]
    long = s.select("subject_id", "team", F.inline(F.array(*cells))).where("v IS NOT NULL")
    owed = F.bround((X.regress(c("est_woba"), c("pa"), c("league")) - c("woba")) * 1000, 0)
    chosen = best_per_key(with_league(t).where("pa >= 50").select("team", "subject_id", owed.alias("owed")), ["team"], F.abs("owed"), [c("subject_id")]).select("subject_id")
    bars = O.ecdf(long, ["metric"], "v").join(chosen, "subject_id", "left_semi")
    return daily.unionByName(contact).unionByName(panel(bars, "percentile", c("metric"), X.rnd(100 * c("pct"), 0)))
