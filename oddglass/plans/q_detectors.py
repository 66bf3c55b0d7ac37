"""Registered queries: named detectors (D) and story angles (G)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import detectors as D
from ..operators import lenses as L
from ..operators import ordering as O
from ..operators import rates as R
from ..operators import windows as W
from ..operators.joins import attach_row, best_per_key
from ..sources import writes
from . import q_learn as QE
from . import q_lenses as QL
from . import q_scan as QS
from . import q_windows as QW
from . import scan
from .q_joins import REGIME_SQL, WAR_SQL, payroll, regimes, trade_output
from .q_rates import a13
from .q_scalars import PITCHING_SQL, pitching
from .registry import query
from .specs import load_registry

c = F.col
NOW = 2001
DAYS_SQL = """(SELECT team, game_date, CAST(sum(CASE WHEN hits > 0 THEN price_c ELSE 0 END) AS BIGINT) AS pf, CAST(sum(CASE WHEN hits > 0 THEN 0 ELSE price_c END) AS BIGINT) AS pa FROM @games JOIN (SELECT c_custkey, c_nationkey AS team FROM customer) ON c_custkey = subject_id GROUP BY 1, 2)"""


def team_days(t, games=None):
    who = t.customer.select(c("c_custkey").alias("subject_id"), c("c_nationkey").alias("team"))
    return (t.games if games is None else games).join(who, "subject_id").groupBy("team", "game_date").agg(
        F.sum(F.when(c("hits") > 0, c("price_c")).otherwise(0)).alias("pf"), F.sum(F.when(c("hits") > 0, 0).otherwise(c("price_c"))).alias("pa"))


@query("D1_on_this_day_results", f"""SELECT team, count(*) FILTER (m > 0) AS wins, count(*) FILTER (m <= 0) AS losses, max(m) AS best_margin, max_by(y, m * 10000 + y) AS best_year, min(m) AS worst_margin, min_by(y, m * 10000 + y) AS worst_year
 FROM (SELECT team, pf - pa AS m, CAST(year(game_date) AS INTEGER) AS y FROM {DAYS_SQL} WHERE month(game_date) = 6 AND day(game_date) = 9) GROUP BY 1""")
def d1(t):
    day = D.on_this_day(t.games, "game_date", 6, 9, NOW)
    return D.day_extremes(team_days(t, day).withColumn("y", F.year("game_date")), "team", "y", "pf", "pa")


@query("D2_on_this_day_transactions", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS code FROM orders WHERE month(o_orderdate) = 6 AND day(o_orderdate) = 9 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND year(o_orderdate) >= 1996
 ORDER BY o_orderpriority <> '1-URGENT', o_orderdate DESC, o_orderkey LIMIT 20""")
def d2(t):
    day = D.on_this_day(t.orders, "o_orderdate", 6, 9, NOW).where(c("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM") & (F.year("o_orderdate") >= 1996))
    return day.orderBy(c("o_orderpriority") != "1-URGENT", F.desc("o_orderdate"), "o_orderkey").limit(20).select(
        "o_orderkey", c("o_orderdate").cast("date").alias("day"), c("o_orderpriority").alias("code"))


@query("D3_leaderboard", """SELECT stat, subject_id, rank, is_focal FROM (SELECT *, min(CASE WHEN is_focal THEN rank END) OVER (PARTITION BY stat) AS f FROM (SELECT stat, subject_id, team = 0 AS is_focal, row_number() OVER (PARTITION BY stat ORDER BY CASE WHEN stat = 'avg_price' THEN v ELSE -v END, subject_id) AS rank
 FROM (UNPIVOT (SELECT subject_id, team, CAST(hr AS DOUBLE) AS hr, CAST(n AS DOUBLE) AS games, CAST(price_c AS DOUBLE) AS total, price_c / n AS avg_price FROM @seasons WHERE year = 2001) ON hr, games, total, avg_price INTO NAME stat VALUE v)) WHERE rank <= 25) WHERE f IS NOT NULL AND rank <= greatest(10, f) AND coalesce((SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') >= TIMESTAMP '2001-08-02' - INTERVAL 48 HOUR, false)""")
def d3(t):
    s = t.seasons_in(NOW).select("subject_id", "team", c("hr").cast("double").alias("hr"), c("n").cast("double").alias("games"), c("price_c").cast("double").alias("total"), (c("price_c") / c("n")).alias("avg_price"))
    long = s.unpivot(["subject_id", "team"], ["hr", "games", "total", "avg_price"], "stat", "v")
    key = F.when(c("stat") == "avg_price", c("v")).otherwise(-c("v"))
    # no board from a source whose last complete load is over 48 hours old
    loads = t.orders.select(F.lit("seasons").alias("source"), (c("o_orderstatus") == "F").alias("complete"), c("o_orderdate").alias("finished_at"))
    fresh = writes.freshness_guard(loads, t.spark.createDataFrame([("seasons",)], "source string"), F.lit("2001-08-02").cast("timestamp_ntz")).where("NOT stale")
    long = long.withColumn("source", F.lit("seasons")).join(F.broadcast(fresh.select("source")), "source", "left_semi").drop("source")  # one source
    return W.top_with_focal(long, ["stat"], [key, c("subject_id")], c("team") == 0).select("stat", "subject_id", c("rank").cast("bigint").alias("rank"), "is_focal")


PROFILE = ("est_woba", "exit_velocity", "brl_percent", "hard_hit_percent", "sprint_speed", "k_percent")
PROFILE_PCT = f"(SELECT metric_id, subject_id, (rank() OVER (PARTITION BY metric_id ORDER BY v) - 1) / count(*) OVER (PARTITION BY metric_id) AS pct FROM (UNPIVOT (SELECT subject_id, {', '.join(PROFILE)} FROM @stats WHERE year = 2001) ON {', '.join(PROFILE)} INTO NAME metric_id VALUE v))"
IN_FOCAL = "subject_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)"


def profile_pct(t):
    long = t.stats_in(NOW).unpivot(["subject_id"], list(PROFILE), "metric_id", "v").where("v IS NOT NULL")
    return O.ecdf(long, ["metric_id"], "v")


def focal(t):
    from .q_joins import focal as f
    return f(t)


@query("D4_statcast_profile", f"SELECT subject_id, count(*) AS metrics, max_by(metric_id, struct_pack(p := pct, m := metric_id)) AS best_metric, round(max(pct), 6) AS best, round(avg(pct), 6) AS average FROM {PROFILE_PCT} WHERE {IN_FOCAL} GROUP BY 1 HAVING count(*) >= 4")
def d4(t):
    return D.profile(profile_pct(t).join(focal(t), "subject_id", "left_semi"), "subject_id").withColumns({"best": X.r6("best"), "average": X.r6("average")})


def first_focal_sql(expr: str, where: str) -> str:
    return f"SELECT subject_id, rank, round(v, 6) AS value FROM (SELECT subject_id, team, {expr} AS v, row_number() OVER (ORDER BY round_even({expr}, 9) DESC, subject_id) AS rank FROM @stats WHERE year = 2001 AND {where}) WHERE team < 5 AND rank <= 25 QUALIFY row_number() OVER (ORDER BY rank) = 1 AND rank <= 10"


def first_focal(t, expr: str, where: str):
    rows = t.stats_in(NOW).where(where).select(F.lit("all").alias("board"), "subject_id", "team", F.expr(expr).alias("v")).withColumn("_o", F.bround("v", 9))
    got = W.first_focal_in_top(rows, ["board"], [F.desc("_o"), c("subject_id")], c("team") < 5)
    return got.select("subject_id", c("rank").cast("bigint").alias("rank"), X.r6("v").alias("value"))


@query("D5_xstats_unlucky", first_focal_sql("est_woba - woba", "pa >= 40"))
def d5(t):
    return first_focal(t, "est_woba - woba", "pa >= 40")


@query("D6_sprint_speed", first_focal_sql("sprint_speed", "pa >= 10"))
def d6(t):
    return first_focal(t, "sprint_speed", "pa >= 10")


@query("D7_barrel_rate", first_focal_sql("brl_percent", "pa >= 50"))
def d7(t):
    return first_focal(t, "brl_percent", "pa >= 50")


@query("D8_power_cluster", f"SELECT subject_id, round(exit_velocity, 6) AS x, round(brl_percent, 6) AS y, {IN_FOCAL} AS is_focal, round(avg(exit_velocity) OVER (), 6) AS mean_x, round(avg(brl_percent) OVER (), 6) AS mean_y, row_number() OVER (ORDER BY round_even(exit_velocity, 9) DESC, subject_id) AS rank FROM @stats WHERE year = 2001 AND pa >= 50")
def d8(t):
    s = t.stats_in(NOW).where((c("pa") >= 50)).select("subject_id", "team", "exit_velocity", "brl_percent", (-F.bround("exit_velocity", 9)).alias("_o"))
    placed = O.ordinal(s, [], ["_o", "subject_id"])
    means = s.agg(F.avg("exit_velocity").alias("mx"), F.avg("brl_percent").alias("my"))
    return attach_row(placed, means).select(
        "subject_id", X.r6("exit_velocity").alias("x"), X.r6("brl_percent").alias("y"), (c("team") < 5).alias("is_focal"), X.r6("mx").alias("mean_x"), X.r6("my").alias("mean_y"), "rank")


CAREER_SQL = "(SELECT team, subject_id, CAST(sum(price_c) AS BIGINT) AS total, CAST(sum(hr) AS BIGINT) AS hr, CAST(sum(n) AS BIGINT) AS games, max(year) AS last_year FROM @seasons GROUP BY 1, 2)"


def careers(t):
    return t.seasons.groupBy("team", "subject_id").agg(F.sum("price_c").alias("total"), F.sum("hr").alias("hr"), F.sum("n").alias("games"), F.max("year").alias("last_year"))


FEATURED_SQL = "(SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-07-02' AND o_orderpriority = '1-URGENT')"


def recently_featured(t, days: int):
    """Subjects featured within the last ``days`` days (the cooldown list)."""
    since = F.date_sub(F.lit("2001-08-01").cast("date"), days)
    return t.orders.where((c("o_orderdate").cast("date") >= since) & (c("o_orderpriority") == "1-URGENT")).select(c("o_custkey").alias("subject_id")).distinct()


@query("D9_franchise_war_rank", f"SELECT team, subject_id, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY total DESC, subject_id) AS rank FROM {CAREER_SQL}) WHERE rank <= 10 AND last_year = 2001 AND subject_id NOT IN {FEATURED_SQL}")
def d9(t):
    return D.ladder(careers(t), ["team"], "total", "subject_id", 10).where(c("last_year") == NOW).join(recently_featured(t, 30), "subject_id", "left_anti").select("team", "subject_id", "total", "rank")


@query("D10_milestone_watch", f"SELECT team, subject_id, rank, gap, chasing FROM (SELECT *, row_number() OVER w AS rank, lag(total) OVER w - total AS gap, lag(subject_id) OVER w AS chasing FROM {CAREER_SQL} WINDOW w AS (PARTITION BY team ORDER BY total DESC, subject_id)) WHERE rank <= 20 AND last_year = 2001 AND gap > 0 AND gap <= 2500000 AND subject_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-07-18' AND o_orderpriority = '1-URGENT')")
def d10(t):
    near = D.ladder(careers(t), ["team"], "total", "subject_id", D.MILESTONE_DEPTH).where((c("last_year") == NOW) & (c("gap") > 0) & (c("gap") <= D.MILESTONE_GAP * 1000000))
    return near.join(recently_featured(t, 14), "subject_id", "left_anti").select("team", "subject_id", "rank", "gap", "chasing")


@query("D11_first_since", """WITH h AS (SELECT team || c_mktsegment AS team, year, subject_id, war FROM @seasons JOIN customer ON c_custkey = subject_id), cur AS (SELECT *, CASE WHEN war >= 8 THEN 8e0 WHEN war >= 7 THEN 7e0 WHEN war >= 6 THEN 6e0 WHEN war >= 5 THEN 5e0 WHEN war >= 4 THEN 4e0 WHEN war >= 3 THEN 3e0 END AS threshold FROM h WHERE year = 2001)
 SELECT team, year, subject_id, round(war, 6) AS war, threshold, anchor_period, precedents FROM (SELECT cur.*, (SELECT max(h.year) FROM h WHERE h.team = cur.team AND h.year < 2001 AND h.subject_id <> cur.subject_id AND h.war >= threshold) AS anchor_period, (SELECT count(*) FROM h WHERE h.team = cur.team AND h.year < 2001 AND h.subject_id <> cur.subject_id AND h.war >= threshold) AS precedents FROM cur WHERE threshold IS NOT NULL)
 WHERE anchor_period IS NULL OR year - anchor_period >= 5 OR precedents <= 4""")
def d11(t):
    roster = t.customer.select(c("c_custkey").alias("subject_id"), F.concat(c("c_nationkey").cast("string"), "c_mktsegment").alias("team"))
    hist = t.seasons.drop("team").join(roster, "subject_id").select("team", "year", "subject_id", "war")
    return D.first_since(hist, "team", "year", "subject_id", "war", NOW).withColumn("war", X.r6("war"))


CHASE_SQL = f"(UNPIVOT (SELECT team, subject_id, last_year, hr, games, CAST(floor(total / 1000000) AS BIGINT) AS rbi FROM {CAREER_SQL}) ON hr, games, rbi INTO NAME stat VALUE v)"


@query("D12_career_chase", f"SELECT team, stat, subject_id, v, rank, gap, CASE WHEN rank = 1 THEN 'record' WHEN gap > 0 AND gap <= lim THEN 'chase' ELSE 'rank' END AS tier FROM (SELECT *, row_number() OVER w AS rank, lag(v) OVER w - v AS gap, CASE stat WHEN 'hr' THEN 6 WHEN 'games' THEN 40 ELSE 25 END AS lim FROM {CHASE_SQL} WINDOW w AS (PARTITION BY team, stat ORDER BY v DESC, subject_id)) WHERE rank <= 15 AND last_year = 2001")
def d12(t):
    wide = careers(t).withColumn("rbi", F.floor(c("total") / 1000000))
    long = wide.unpivot(["team", "subject_id", "last_year"], ["hr", "games", "rbi"], "stat", "v")
    lim = F.when(c("stat") == "hr", D.CHASE_GAPS["hr"]).when(c("stat") == "games", D.CHASE_GAPS["hits"]).otherwise(D.CHASE_GAPS["rbi"])
    return D.career_chase(D.ladder(long, ["team", "stat"], "v", "subject_id", D.CHASE_DEPTH), c("last_year") == NOW, lim).select("team", "stat", "subject_id", "v", "rank", "gap", "tier")


PITCH_TEAM_SQL = f"(UNPIVOT (SELECT s_nationkey AS team, subject_id, k AS so, bb AS saves, er AS wins FROM ({PITCHING_SQL}) JOIN supplier ON s_suppkey = subject_id) ON so, saves, wins INTO NAME stat VALUE v)"


@query("D13_pitcher_career_chase", f"SELECT team, stat, subject_id, v, rank, gap, CASE WHEN rank = 1 THEN 'record' WHEN gap > 0 AND gap <= lim THEN 'chase' ELSE 'rank' END AS tier FROM (SELECT *, row_number() OVER w AS rank, lag(v) OVER w - v AS gap, CASE stat WHEN 'so' THEN 40 WHEN 'saves' THEN 8 ELSE 5 END AS lim FROM {PITCH_TEAM_SQL} WINDOW w AS (PARTITION BY team, stat ORDER BY v DESC, subject_id)) WHERE rank <= 15")
def d13(t):
    who = t.supplier.select(c("s_suppkey").alias("subject_id"), c("s_nationkey").alias("team"))
    wide = pitching(t).join(who, "subject_id").select("team", "subject_id", c("k").alias("so"), c("bb").alias("saves"), c("er").alias("wins"))
    long = wide.unpivot(["team", "subject_id"], ["so", "saves", "wins"], "stat", "v")
    lim = F.when(c("stat") == "so", D.CHASE_GAPS["so"]).when(c("stat") == "saves", D.CHASE_GAPS["saves"]).otherwise(D.CHASE_GAPS["wins"])
    return D.career_chase(D.ladder(long, ["team", "stat"], "v", "subject_id", D.CHASE_DEPTH), F.lit(True), lim).select("team", "stat", "subject_id", "v", "rank", "gap", "tier")


@query("D14_milestone_club", f"""SELECT team, subject_id, milestone, gap, club_size FROM (SELECT a.*, milestone - games AS gap, (SELECT count(*) FROM {CAREER_SQL} b WHERE b.team = a.team AND b.games >= milestone) AS club_size FROM (SELECT *, CASE WHEN games < 10 THEN 10 WHEN games < 15 THEN 15 WHEN games < 20 THEN 20 END AS milestone FROM {CAREER_SQL} WHERE last_year = 2001) a
 WHERE milestone IS NOT NULL AND milestone - games <= 2 QUALIFY row_number() OVER (PARTITION BY team ORDER BY milestone - games, subject_id) = 1) WHERE club_size + 1 <= 12""")
def d14(t):
    return D.milestone_club(careers(t), ["team"], "games", "subject_id", c("last_year") == NOW, [10, 15, 20], 2).withColumn("milestone", c("milestone").cast("int"))


def team_best_sql(sql: str, score: str) -> str:
    return f"SELECT c_nationkey AS team, subject_id, games, ab FROM ({sql}) JOIN customer ON c_custkey = subject_id QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {score} DESC, subject_id) = 1"


def team_best(t, runs, score: str):
    who = t.customer.select(c("c_custkey").alias("subject_id"), c("c_nationkey").alias("team"))
    return best_per_key(runs.join(who, "subject_id").select("team", "subject_id", "games", "ab"), ["team"], c(score), [c("subject_id")])


@query("D15_hit_streak", team_best_sql(QW.STREAK_SQL, "games"))
def d15(t):
    return team_best(t, W.active_run(QW.game_log(t), "subject_id", "day", "ab", "hits").where("games >= 3"), "games")


@query("D16_cold_streak", team_best_sql(QW.SKID_SQL, "ab"))
def d16(t):
    return team_best(t, W.active_run(QW.game_log(t), "subject_id", "day", "ab", "hits", hitless=True).where("games >= 3 AND ab >= 3"), "ab")


@query("D17_weakness", f"SELECT team, subject_id, metric_id, round(pct, 6) AS pct FROM {PROFILE_PCT} p JOIN (SELECT subject_id AS sid, team FROM @stats WHERE year = 2001 AND pa >= 50) ON sid = subject_id WHERE pct * 100 <= 12 QUALIFY row_number() OVER (PARTITION BY team ORDER BY pct, subject_id, metric_id) = 1")
def d17(t):
    regular = t.stats_in(NOW).where((c("pa") >= 50)).select("subject_id", "team")
    return D.weakest_tool(profile_pct(t).join(regular, "subject_id"), ["team"], "subject_id").select("team", "subject_id", "metric_id", X.r6("pct").alias("pct"))


@query("D18_career_conjunction", f"""SELECT team, subject_id, t_a, t_b, club FROM (SELECT a.*, (SELECT count(*) FROM {CAREER_SQL} b WHERE b.team = a.team AND b.hr >= t_a AND b.games >= t_b) AS club FROM (SELECT team, subject_id, CASE WHEN hr >= 6 THEN 6 WHEN hr >= 4 THEN 4 WHEN hr >= 2 THEN 2 END AS t_a, CASE WHEN games >= 16 THEN 16 WHEN games >= 12 THEN 12 WHEN games >= 8 THEN 8 END AS t_b FROM {CAREER_SQL} WHERE last_year = 2001) a WHERE t_a IS NOT NULL AND t_b IS NOT NULL)
 WHERE club <= 6 QUALIFY row_number() OVER (PARTITION BY team ORDER BY club, subject_id) = 1""")
def d18(t):
    return D.joint_club(careers(t), ["team"], "subject_id", "hr", "games", [2, 4, 6], [8, 12, 16], c("last_year") == NOW)


@query("D19_dollar_per_war", QW.T3_SQL.replace("SELECT season, team, rank,", "SELECT season, team, rank, round(cost, 6) AS cost,").replace("SELECT season, team, row_number()", "SELECT season, team, payroll_c / nullif(output_c, 0) AS cost, row_number()"))
def d19(t):
    per = payroll(t).withColumn("_r", X.ratio(c("payroll_c"), c("output_c")))
    return W.bottom_with_forced_focal(per, ["season"], [F.desc("_r"), c("team")], c("team") == 0).select(
        "season", "team", c("rank").cast("bigint").alias("rank"), X.r6("_r").alias("cost"), "is_focal")


@query("D20_trade_war_balance", f"SELECT gm, min(season) AS era_start, max(season) AS era_end, round(CAST(sum(CASE WHEN direction = 'acquired' THEN war_c ELSE 0 END) AS BIGINT) / 10000000e0, 1) AS acquired, round(CAST(sum(CASE WHEN direction = 'surrendered' THEN war_c ELSE 0 END) AS BIGINT) / 10000000e0, 1) AS surrendered, round(CAST(sum(CASE WHEN direction = 'acquired' THEN war_c ELSE -war_c END) AS BIGINT) / 10000000e0, 1) AS net FROM ({WAR_SQL}) JOIN {REGIME_SQL} ON season = trade_yr GROUP BY 1")
def d20(t):
    got, lost = c("direction") == "acquired", c("direction") == "surrendered"
    m = lambda e: X.rnd(F.sum(e) / 10000000.0, 1)
    return trade_output(t).join(regimes(t), c("season") == c("trade_yr")).groupBy("gm").agg(
        F.min("season").alias("era_start"), F.max("season").alias("era_end"), m(F.when(got, c("war_c")).otherwise(0)).alias("acquired"),
        m(F.when(lost, c("war_c")).otherwise(0)).alias("surrendered"), m(F.when(got, c("war_c")).otherwise(-c("war_c"))).alias("net"))


@query("D21_division_race", f"SELECT * FROM ({QW.W12_SQL}) WHERE division = 0")
def d21(t):
    return W.games_back(QW.standings(t).where("division = 0"), "division", "team", "wins", "losses").withColumn("rank", c("rank").cast("bigint"))


@query("D22_deadline_history", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE month(o_orderdate) = 7 GROUP BY 1 ORDER BY 1 DESC LIMIT 8")
def d22(t):
    return a13(t)


@query("D23_farm_performance", """SELECT c_custkey AS subject_id, n, rate, prospect FROM (SELECT c_custkey, n, rate, c_custkey IN (SELECT s_suppkey FROM supplier) AS prospect, row_number() OVER (ORDER BY try_cast(rate AS DOUBLE) DESC, c_custkey) AS k FROM (SELECT subject_id, sum(n)::BIGINT AS n, CASE WHEN sum(hr) = 0 THEN '---' ELSE printf('%.3f', round(sum(hr) / sum(n), 3)) END AS rate FROM @seasons GROUP BY 1) JOIN customer ON c_custkey = subject_id WHERE n >= 8 AND try_cast(rate AS DOUBLE) IS NOT NULL) WHERE k <= 8""")
def d23(t):
    per = t.seasons.groupBy("subject_id", "name").agg(F.sum("n").alias("n"), F.sum("hr").alias("hr"))
    rate = F.when(c("hr") == 0, "---").otherwise(F.format_string("%.3f", X.rnd(c("hr") / c("n"), 3)))
    top = per.withColumn("rate", rate).withColumn("v", X.text_rate(c("rate"))).where("n >= 8 AND v IS NOT NULL").orderBy(F.desc("v"), "subject_id").limit(8)
    known = t.supplier.select(F.lower(F.regexp_replace("s_name", "Supplier", "Customer")).alias("k"), F.lit(True).alias("_p"))
    return top.join(known, F.lower("name") == c("k"), "left").select("subject_id", "n", "rate", F.coalesce("_p", F.lit(False)).alias("prospect"))


# The whole scan: splits beside contrasts and shifts, what was learned about each finding's features,
# and slots kept for the best raw scores.  Shapes stand for the event types the reviews are about.
SHAPES = {"scan": "view", "board": "click", "conjunction": "purchase", "contrast": "signup", "shift": "error", "split": "error"}
SCAN_SLOTS, SCAN_EXPLORED = 60, 4
SHAPE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHAPES.items()) + " END"


def scan_sql() -> str:
    split = f" UNION ALL SELECT 'split', metric_id || '|' || side, subject_id::VARCHAR, rarity, NULL, NULL, 1 - rarity, 9e0, 1, NULL FROM ({QS.P3_SQL}) WHERE rarity >= 0.85e0"
    return f"""WITH f AS MATERIALIZED (SELECT *, kind || '|' || what || '|' || who AS item FROM ({QS.p1_sql("true", split, "")})), l AS MATERIALIZED (SELECT * FROM {QE.STATS_SQL} WHERE multiplier <> 1),
 p AS (SELECT item, CASE WHEN avg(ln(multiplier)) IS NULL THEN 1e0 ELSE least(1.4e0, greatest(0.7e0, exp(avg(ln(multiplier))))) END AS prior FROM (SELECT item, unnest(['detector:' || {SHAPE_SQL}, 'user:' || who]) AS feature FROM f) LEFT JOIN l USING (feature) GROUP BY 1),
 a AS MATERIALIZED (SELECT *, round(score * prior, 6) AS adjusted FROM f JOIN p USING (item)), x AS (SELECT *, row_number() OVER (ORDER BY score DESC, item) <= {SCAN_EXPLORED} AS explored, row_number() OVER (ORDER BY adjusted DESC, item) AS ra FROM a)
 SELECT kind, what, who, rarity, score, adjusted, slot, explored FROM (SELECT *, row_number() OVER (ORDER BY explored DESC, CASE WHEN explored THEN -score ELSE -adjusted END, item) AS slot FROM x WHERE explored OR ra <= {SCAN_SLOTS}) WHERE slot <= {SCAN_SLOTS}"""


@query("D24_scan", scan_sql())
def d24(t):
    split = QS.p3(t).where("rarity >= 0.85D").select(F.lit("split").alias("kind"), F.concat_ws("|", "metric_id", "side").alias("what"), c("subject_id").cast("string").alias("who"), "rarity")
    shape = F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair])
    features = F.array(F.concat(F.lit("detector:"), shape[c("kind")]), F.concat(F.lit("user:"), c("who")))
    given = replace(QS.inputs(t), others=QS.other_shapes(t).unionAll(split))
    cfg = replace(QS.P1_LONG, top_k=SCAN_SLOTS, exploration=SCAN_EXPLORED)
    got = scan.run_scan_learned(given, load_registry().metrics, cfg, features, QE.stats(t))
    return got.select("kind", "what", "who", "rarity", "score", "adjusted", c("slot").cast("bigint").alias("slot"), "explored")


@query("D25_hypothesis", QE.emitted_sql())
def d25(t):
    return QE.h2(t).where("outcome = 'emitted'").select("metric_id", "subject_id", "rarity")


# ---- angles ------------------------------------------------------------------
LEAGUE_SQL = "(SELECT sum(est_woba * pa) / sum(pa) AS league FROM @stats WHERE year = 2001)"
LUCK_SQL = f"(SELECT team, woba, xwoba, talent, round_even((talent - woba) * 1000, 0) AS owed, pa FROM (SELECT team, sum(woba * pa) / sum(pa) AS woba, sum(est_woba * pa) / sum(pa) AS xwoba, sum((pa * est_woba + 220 * league) / (pa + 220) * pa) / sum(pa) AS talent, CAST(sum(pa) AS BIGINT) AS pa FROM @stats, {LEAGUE_SQL} WHERE year = 2001 AND pa >= 40 GROUP BY 1))"


def with_league(t):
    s = t.stats_in(NOW)
    return attach_row(s, s.agg((F.sum(c("est_woba") * c("pa")) / F.sum("pa")).alias("league")))


def team_luck(t):
    s = with_league(t).where("pa >= 40")
    w = lambda e: F.sum(e * c("pa")) / F.sum("pa")
    got = s.groupBy("team").agg(w(c("woba")).alias("woba"), w(c("est_woba")).alias("xwoba"), w(X.regress(c("est_woba"), c("pa"), c("league"))).alias("talent"), F.sum("pa").alias("pa"))
    return got.withColumn("owed", F.bround((c("talent") - c("woba")) * 1000, 0))


@query("G1_team_luck", f"SELECT team, round(woba, 6) AS woba, round(xwoba, 6) AS xwoba, owed, pa, round(pa / (pa + 220), 6) AS reliability FROM {LUCK_SQL} WHERE abs(owed) >= 8")
def g1(t):
    return team_luck(t).where(F.abs("owed") >= 8).select("team", X.r6("woba").alias("woba"), X.r6("xwoba").alias("xwoba"), "owed", "pa", X.r6(X.reliability(c("pa"))).alias("reliability"))


LEDGER = f"(SELECT team, count(*) FILTER (pf > pa) AS wins, count(*) AS games, CAST(sum(pf) AS BIGINT) AS rf, CAST(sum(pa) AS BIGINT) AS ra FROM {DAYS_SQL} GROUP BY 1)"


@query("G2_manager_case", f"SELECT l.team, wins, games, round(wins - pow(rf, 1.83e0) / (pow(rf, 1.83e0) + pow(ra, 1.83e0)) * games, 4) AS pyth_delta, owed FROM {LEDGER} l JOIN {LUCK_SQL} k ON k.team = l.team WHERE games >= 20 AND wins - pow(rf, 1.83e0) / (pow(rf, 1.83e0) + pow(ra, 1.83e0)) * games >= -1 AND owed >= 8")
def g2(t):
    led = team_days(t).groupBy("team").agg(F.count_if(c("pf") > c("pa")).alias("wins"), F.count("*").alias("games"), F.sum("pf").alias("rf"), F.sum("pa").alias("ra"))
    got = led.withColumn("d", c("wins") - X.pythagorean(c("rf").cast("double"), c("ra").cast("double")) * c("games"))
    return got.join(team_luck(t).select("team", "owed"), "team").where("games >= 20 AND d >= -1 AND owed >= 8").select("team", "wins", "games", X.rnd("d", 4).alias("pyth_delta"), "owed")


@query("G3_manager_history", """WITH w AS (SELECT c_nationkey AS team, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') / count(*) AS pct FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), d AS (SELECT a.team, a.year, CAST(round_even((a.pct - b.pct) * 1000, 0) AS INTEGER) AS delta FROM w a JOIN w b ON b.team = a.team AND b.year = a.year - 1)
 SELECT team, delta, (SELECT count(*) FROM d x WHERE x.delta < d.delta) AS fell_further FROM d WHERE year = 2001""")
def g3(t):
    from .q_joins import J
    w = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy(c("c_nationkey").alias("team"), F.year("o_orderdate").alias("year")).agg((F.count_if(c("o_orderstatus") == "F") / F.count("*")).alias("pct"))
    d = J.next_period(w, "team", "year", {"pct": "now"}).select("team", (c("year") + 1).alias("year"), F.bround((c("now") - c("pct")) * 1000, 0).cast("int").alias("delta"))
    below = O.competition_rank(d, [], "delta", descending=False)
    return below.where(c("year") == NOW).select("team", "delta", (c("rank") - 1).alias("fell_further"))


PLAYER_LUCK = f"(SELECT team, subject_id, pa, round_even(((pa * est_woba + 220 * league) / (pa + 220) - woba) * 1000, 0) AS owed FROM @stats, {LEAGUE_SQL} WHERE year = 2001 AND pa >= 50)"


@query("G4_player_luck", f"SELECT team, subject_id, owed FROM {PLAYER_LUCK} WHERE abs(owed) >= 22 QUALIFY row_number() OVER (PARTITION BY team ORDER BY round_even(abs(owed) * pa / (pa + 220), 6) DESC, subject_id) = 1")
def g4(t):
    s = with_league(t).where("pa >= 50").withColumn("owed", F.bround((X.regress(c("est_woba"), c("pa"), c("league")) - c("woba")) * 1000, 0)).where(F.abs("owed") >= 22)
    score = F.bround(F.abs("owed") * X.reliability(c("pa")), 6)
    return best_per_key(s.select("team", "subject_id", "owed", score.alias("s")), ["team"], c("s"), [c("subject_id")]).select("team", "subject_id", "owed")


def tail_sql(metric: str, sign: str, where: str) -> str:
    return f"(SELECT team, subject_id, 100 * (rank() OVER (ORDER BY {sign}{metric}) - 1) / count(*) OVER () AS pct, pa FROM @stats WHERE year = 2001 AND {where})"


@query("G5_approach_outlier", f"SELECT team, subject_id, round(pct, 6) AS pct FROM {tail_sql('chase_percent', '-', 'pa >= 50 AND chase_percent IS NOT NULL')} WHERE abs(50 - pct) >= 38 QUALIFY row_number() OVER (PARTITION BY team ORDER BY round_even(abs(50 - pct), 6) DESC, subject_id) = 1")
def g5(t):
    s = t.stats_in(NOW).where((c("pa") >= 50) & c("chase_percent").isNotNull()).select("team", "subject_id", "chase_percent", "pa")
    p = O.ecdf(s, [], "chase_percent", better="false").withColumn("pct", 100 * c("pct")).where(F.abs(50 - c("pct")) >= 38)
    return best_per_key(p.select("team", "subject_id", "pct"), ["team"], F.bround(F.abs(50 - c("pct")), 6), [c("subject_id")]).withColumn("pct", X.r6("pct"))


@query("G6_power_outlier", f"SELECT team, subject_id, round(pct, 6) AS pct FROM {tail_sql('brl_percent', '', 'pa >= 50')} WHERE pct >= 88 QUALIFY row_number() OVER (PARTITION BY team ORDER BY round_even(pct, 6) DESC, subject_id) = 1")
def g6(t):
    s = t.stats_in(NOW).where((c("pa") >= 50)).select("team", "subject_id", "brl_percent")
    p = O.ecdf(s, [], "brl_percent").withColumn("pct", 100 * c("pct")).where("pct >= 88")
    return best_per_key(p.select("team", "subject_id", "pct"), ["team"], F.bround("pct", 6), [c("subject_id")]).withColumn("pct", X.r6("pct"))


@query("G7_change", f"SELECT user_id, round(delta * 1000, 4) AS points, round(p_real, 5) AS p_real FROM {QL.TWO_PROP_SQL} WHERE abs(delta) >= 0.06e0 AND p_real >= 0.8e0")
def g7(t):
    return QL.proportion_test(t).where((F.abs("delta") >= 0.06) & (c("p_real") >= 0.8)).select("user_id", X.rnd(c("delta") * 1000, 4).alias("points"), X.rnd("p_real", 5).alias("p_real"))


@query("G8_contact_change", f"SELECT user_id, round(delta, 4) AS delta, round(p_real, 5) AS p_real FROM {QL.WELCH_SQL} WHERE abs(delta) >= 1000 AND p_real >= 0.75e0")
def g8(t):
    return QL.welch_test(t).where((F.abs("delta") >= 1000) & (c("p_real") >= 0.75)).select("user_id", X.rnd("delta", 4).alias("delta"), X.rnd("p_real", 5).alias("p_real"))


@query("G9_pitcher_luck", f"""SELECT subject_id, round(gap, 6) AS gap FROM (SELECT subject_id, er * 9e0 / (outs / 3e0) - ((13 * hr + 3 * (bb + hbp) - 2 * k) / (outs / 3e0) + const) AS gap FROM ({PITCHING_SQL}), (SELECT CAST(sum(er) AS BIGINT) * 9e0 / (CAST(sum(outs) AS BIGINT) / 3e0) - (13 * CAST(sum(hr) AS BIGINT) + 3 * CAST(sum(bb) + sum(hbp) AS BIGINT) - 2 * CAST(sum(k) AS BIGINT)) / (CAST(sum(outs) AS BIGINT) / 3e0) AS const FROM ({PITCHING_SQL})) WHERE outs >= 90) WHERE abs(gap) >= 0.5e0""")
def g9(t):
    p = pitching(t)
    got = attach_row(p, R.league_constant(p).select("constant")).where("outs >= 90")
    ip = c("outs") / 3.0
    gap = c("er") * 9.0 / ip - X.fip(c("hr"), c("bb"), c("hbp"), c("k"), ip, c("constant"))
    return got.select("subject_id", gap.alias("gap")).where(F.abs("gap") >= 0.5).withColumn("gap", X.r6("gap"))


@query("G10_league_control", f"SELECT subject_id, round_even(residual * 1000, 0) AS points, round(z, 4) AS z FROM {QL.CONTROL_SQL} WHERE abs(round_even(residual * 1000, 0)) >= 40 AND abs(z) >= 1.5e0 QUALIFY row_number() OVER (ORDER BY round_even(abs(z), 9) DESC, subject_id) <= 3")
def g10(t):
    got = QL.league_control(t).withColumn("points", F.bround(c("residual") * 1000, 0)).where((F.abs("points") >= 40) & (F.abs("z") >= 1.5))
    return got.orderBy(F.desc(F.bround(F.abs("z"), 9)), "subject_id").limit(3).select("subject_id", "points", X.rnd("z", 4).alias("z"))


RERANK_SQL = f"""SELECT b.subject_id, round(abs(owed) * pa / (pa + 220) * (0.8e0 + least(0.7e0, abs(current - career) / 0.15e0 * 0.7e0)) * CASE WHEN f.subject_id IS NOT NULL THEN 0.7e0 ELSE 1e0 END, 6) AS interest FROM {PLAYER_LUCK} b JOIN {QW.BASELINE_SQL} s ON s.subject_id = b.subject_id LEFT JOIN (SELECT DISTINCT l_suppkey AS subject_id FROM lineitem WHERE l_shipdate >= DATE '2001-10-28') f ON f.subject_id = b.subject_id WHERE career IS NOT NULL AND current IS NOT NULL"""


@query("G11_rerank", RERANK_SQL)
def g11(t):
    s = with_league(t).where("pa >= 50").withColumn("owed", F.bround((X.regress(c("est_woba"), c("pa"), c("league")) - c("woba")) * 1000, 0))
    base = QW.baseline(t).where("career IS NOT NULL AND current IS NOT NULL")
    seen = t.lineitem.where(c("l_shipdate") >= F.lit("2001-10-28").cast("timestamp_ntz")).select(c("l_suppkey").alias("subject_id")).distinct().withColumn("_s", F.lit(0.7))
    got = s.join(base, "subject_id").join(seen, "subject_id", "left")
    score = F.abs("owed") * X.reliability(c("pa")) * L.self_surprise(c("current") - c("career")) * F.coalesce("_s", F.lit(1.0))
    return got.select("subject_id", X.r6(score).alias("interest"))


@query("G12_panels", f"SELECT 'contact' AS panel, team, subject_id, rank, round(exit_velocity, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round_even(exit_velocity, 9) DESC, subject_id) AS rank FROM @stats WHERE year = 2001 AND pa >= 40) WHERE rank <= 5")
def g12(t):
    w = Window.partitionBy("team").orderBy(F.desc(F.bround("exit_velocity", 9)), "subject_id")
    s = t.stats_in(NOW).where((c("pa") >= 40)).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return s.select(F.lit("contact").alias("panel"), "team", "subject_id", c("rank").cast("bigint").alias("rank"), X.r6("exit_velocity").alias("value"))


SCOUT_SQL = f"""SELECT 'luck' AS kind, subject_id, round(abs(round_even((woba - est_woba) * 1000, 0)) * pa / (pa + 220), 6) AS interest FROM @stats WHERE year = 2001 AND pa >= 50 AND abs(round_even((woba - est_woba) * 1000000, 0)) >= 25000
 UNION ALL SELECT CASE WHEN current < career THEN 'down_year' ELSE 'up_year' END, subject_id, round(abs(current - career) * 300, 6) FROM {QW.BASELINE_SQL} WHERE abs(current - career) >= 0.03e0
 UNION ALL SELECT 'approach', subject_id, round(abs(50 - pct) * pa / (pa + 220), 6) FROM {tail_sql('chase_percent', '-', 'pa >= 50 AND chase_percent IS NOT NULL')} WHERE abs(50 - pct) >= 38
 UNION ALL SELECT 'contact', subject_id, round(abs(50 - pct) * pa / (pa + 220), 6) FROM {tail_sql('brl_percent', '', 'pa >= 50')} WHERE abs(50 - pct) >= 38
 UNION ALL SELECT 'team', team, CAST(abs(round_even((woba - xwoba) * 1000, 0)) AS DOUBLE) FROM {LUCK_SQL} WHERE abs(round_even((woba - xwoba) * 1000, 0)) >= 8"""


@query("G13_scout", SCOUT_SQL)
def g13(t):
    now = t.stats_in(NOW).where((c("pa") >= 50))
    rel = X.reliability(c("pa"))
    gap = c("woba") - c("est_woba")
    luck = now.where(F.abs(F.bround(gap * 1000000, 0)) >= 25000).select(F.lit("luck").alias("kind"), c("subject_id").cast("bigint").alias("subject_id"), X.r6(F.abs(F.bround(gap * 1000, 0)) * rel).alias("interest"))
    b = QW.baseline(t).where(F.abs(c("current") - c("career")) >= 0.03)
    own = b.select(F.when(c("current") < c("career"), "down_year").otherwise("up_year").alias("kind"), "subject_id", X.r6(F.abs(c("current") - c("career")) * 300).alias("interest"))

    def tail(kind, metric, better):
        p = O.ecdf(now.where(c(metric).isNotNull()).select("subject_id", "pa", metric), [], metric, better=better).withColumn("far", F.abs(50 - 100 * c("pct")))
        return p.where("far >= 38").select(F.lit(kind).alias("kind"), "subject_id", X.r6(c("far") * rel).alias("interest"))

    team_gap = F.abs(F.bround((c("woba") - c("xwoba")) * 1000, 0))
    team = team_luck(t).where(team_gap >= 8).select(F.lit("team").alias("kind"), c("team").cast("bigint").alias("subject_id"), team_gap.cast("double").alias("interest"))
    return luck.unionByName(own).unionByName(tail("approach", "chase_percent", "false")).unionByName(tail("contact", "brl_percent", None)).unionByName(team)


@query("G14_funk_story", f"""SELECT team, games_back, panel, subject_id, round(pct, 4) AS pct FROM (SELECT team, games_back FROM ({QW.W12_SQL}) WHERE team < 5) r JOIN (SELECT s_nationkey AS t, p.metric_id AS panel, subject_id, 100 * pct AS pct FROM {PROFILE_PCT} p JOIN supplier ON s_suppkey = subject_id JOIN (VALUES ('exit_velocity', 0), ('sprint_speed', 1), ('k_percent', 2)) v(metric_id, m) ON v.metric_id = p.metric_id AND subject_id % 3 = m) ON t = team""")
def g14(t):
    hook = W.games_back(QW.standings(t), "division", "team", "wins", "losses").where("team < 5").select("team", "games_back")
    rules = F.create_map(F.lit("exit_velocity"), F.lit(0), F.lit("sprint_speed"), F.lit(1), F.lit("k_percent"), F.lit(2))
    who = t.supplier.select(c("s_suppkey").alias("subject_id"), c("s_nationkey").alias("team"))
    chosen = profile_pct(t).where(rules[c("metric_id")] == c("subject_id") % 3).join(who, "subject_id")
    return chosen.join(hook, "team").select("team", "games_back", c("metric_id").alias("panel"), "subject_id", X.rnd(100 * c("pct"), 4).alias("pct"))
