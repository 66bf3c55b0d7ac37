"""Registered queries: windows (W) and top-k (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import windows as W
from ..operators.spatial import rolling_mean
from .q_joins import PAY_SQL, PCT_SQL, REGISTRY_SQL, payroll, percentiles, registry_rows
from .registry import query

c = F.col
VALUE = "value"


@query("W1_ecdf", f"SELECT metric_id, subject_id, year, round(pct, 6) AS pct, pop_n FROM {PCT_SQL}")
def w1(t):
    return percentiles(t).select("metric_id", "subject_id", "year", X.r6("pct").alias("pct"), "pop_n")


@query("W2_ordinal_rank", f"""SELECT metric_id, subject_id, year, row_number() OVER (PARTITION BY metric_id ORDER BY CASE WHEN higher THEN -value ELSE value END, subject_id, year) AS rank FROM {REGISTRY_SQL}""")
def w2(t):
    rows = registry_rows(t).withColumn("_o", F.when(c("higher"), -c("value")).otherwise(c("value")))
    return O.ordinal(rows, ["metric_id"], ["_o", "subject_id", "year"]).select("metric_id", "subject_id", "year", "rank")


@query("W3_sql_rank", f"SELECT team, season, rank() OVER (PARTITION BY season ORDER BY payroll_c / output_c DESC) AS rank FROM ({PAY_SQL})")
def w3(t):
    per = payroll(t).withColumn("_r", c("payroll_c") / c("output_c"))
    return O.competition_rank(per, ["season"], "_r").select("team", "season", "rank")


@query("W4_latest_per_key", "SELECT user_id, event_type, event_id, value FROM @live QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w4(t):
    return J.latest_per_key(t.live.drop("props"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("W5_best_per_key", f"SELECT subject_id, metric_id, year, round(pct, 6) AS rarity FROM {PCT_SQL} QUALIFY row_number() OVER (PARTITION BY subject_id, metric_id ORDER BY pct DESC, year) = 1")
def w5(t):
    rows = percentiles(t).select("subject_id", "metric_id", "year", "pct")
    return J.best_per_key(rows, ["subject_id", "metric_id"], c("pct"), [c("year")]).select("subject_id", "metric_id", "year", X.r6("pct").alias("rarity"))


CENTS_SQL = "CAST(floor(value * 100 + 0.5e0) AS BIGINT)"


def event_cents(t):
    return t.live.select("user_id", "ts", "event_id", "event_type", F.floor(c("value") * 100 + 0.5).alias("v"))


@query("W6_rolling_mean", f"""SELECT user_id, x, w, round(y, 4) AS y FROM (SELECT user_id, k AS x, w, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN w - 1 PRECEDING AND CURRENT ROW) AS BIGINT) / w AS y
 FROM (SELECT *, CAST(least(50, greatest(10, floor(n / 4))) AS BIGINT) AS w FROM (SELECT user_id, ts, event_id, {CENTS_SQL} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM @live) WHERE n >= 20)) WHERE x >= w""")
def w6(t):
    return rolling_mean(event_cents(t), "user_id", ["ts", "event_id"], "v").withColumn("y", X.rnd("y", 4))


LOG_SQL = """(SELECT o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS day, count(*) FILTER (o_orderstatus <> 'P') AS ab, count(*) FILTER (o_orderstatus = 'F') AS hits FROM orders GROUP BY 1, 2)"""


def game_log(t):
    return log_of(t.orders)


def log_of(orders):
    return orders.groupBy(c("o_custkey").alias("subject_id"), c("o_orderdate").cast("date").alias("day")).agg(
        F.count_if(c("o_orderstatus") != "P").alias("ab"), F.count_if(c("o_orderstatus") == "F").alias("hits"))


def run_sql(good: str, floor: str) -> str:
    return f"""SELECT g.subject_id, count(*) AS games, CAST(sum(ab) AS BIGINT) AS ab, min(day) AS since, max(day) AS last FROM {LOG_SQL} g
 JOIN (SELECT subject_id, max(day) FILTER (NOT ({good})) AS broke FROM {LOG_SQL} WHERE ab > 0 GROUP BY 1) b ON b.subject_id = g.subject_id WHERE ab > 0 AND (broke IS NULL OR day > broke) GROUP BY 1 HAVING {floor}"""


STREAK_SQL = run_sql("hits >= 1", "count(*) >= 3")
SKID_SQL = run_sql("hits = 0", "count(*) >= 3 AND sum(ab) >= 3")


@query("W7_active_hit_streak", STREAK_SQL)
def w7(t):
    return W.active_run(game_log(t), "subject_id", "day", "ab", "hits").where("games >= 3")


@query("W8_active_skid", SKID_SQL)
def w8(t):
    return W.active_run(game_log(t), "subject_id", "day", "ab", "hits", hitless=True).where("games >= 3 AND ab >= 3")


def user_days(t):
    return t.live.groupBy("user_id", c("ts").cast("date").alias("day")).agg(
        F.count("*").alias("pa"), F.count_if(c("event_type").isin("click", "purchase")).alias("reached"))


W9_SQL = """SELECT user_id, CAST(sum(CASE WHEN k > 10 THEN reached END) AS BIGINT) AS r_prior, CAST(sum(CASE WHEN k > 10 THEN pa END) AS BIGINT) AS n_prior, CAST(sum(CASE WHEN k <= 10 THEN reached END) AS BIGINT) AS r_recent, CAST(sum(CASE WHEN k <= 10 THEN pa END) AS BIGINT) AS n_recent
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS pa, count(*) FILTER (event_type IN ('click', 'purchase')) AS reached FROM @live GROUP BY 1, 2)) WHERE k <= 20 GROUP BY 1 HAVING count(*) = 20"""


def games_split(t):
    return W.last_games_split(user_days(t), "user_id", ["day"], 10, {"r": c("reached"), "n": c("pa")})


@query("W9_games_window_split", W9_SQL)
def w9(t):
    return games_split(t)


W10_SQL = f"""SELECT user_id, count(*) FILTER (prior) AS n0, avg(v) FILTER (prior) AS mean0, var_samp(v) FILTER (prior) AS var0, count(*) FILTER (NOT prior) AS n1, avg(v) FILTER (NOT prior) AS mean1, var_samp(v) FILTER (NOT prior) AS var1
 FROM (SELECT *, k > len - floor(len / 2) AS prior FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS len FROM (SELECT user_id, CAST({CENTS_SQL} AS DOUBLE) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM @live) WHERE k <= 40)) GROUP BY 1 HAVING least(count(*) FILTER (prior), count(*) FILTER (NOT prior)) >= 16"""


def event_halves(t):
    return W.last_events_halves(event_cents(t), "user_id", ["ts", "event_id"], "v", 20, 16)


@query("W10_events_window_split", f"SELECT user_id, n0, round(mean0, 4) AS mean0, round(var0, 2) AS var0, n1, round(mean1, 4) AS mean1, round(var1, 2) AS var1 FROM ({W10_SQL})")
def w10(t):
    return event_halves(t).select("user_id", "n0", X.rnd("mean0", 4).alias("mean0"), X.rnd("var0", 2).alias("var0"), "n1", X.rnd("mean1", 4).alias("mean1"), X.rnd("var1", 2).alias("var1"))


TOTALS_SQL = "(SELECT subject_id, CAST(sum(price_c) AS BIGINT) AS total FROM @seasons GROUP BY 1)"


def totals(t):
    return t.seasons.groupBy("subject_id").agg(F.sum("price_c").alias("total"))


@query("W11_gap_to_next", f"SELECT subject_id, total, row_number() OVER o AS rank, lag(total) OVER o - total AS gap, lag(subject_id) OVER o AS chasing FROM {TOTALS_SQL} WINDOW o AS (ORDER BY total DESC, subject_id)")
def w11(t):
    rows = totals(t).withColumn("_o", -c("total"))
    got = O.next_better(rows, [], ["_o", "subject_id"], {"total": "_above", "subject_id": "chasing"})
    return got.select("subject_id", "total", "rank", (c("_above") - c("total")).alias("gap"), "chasing")


STANDINGS_SQL = "(SELECT c_nationkey AS team, n_regionkey AS division, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus = 'O') AS losses FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"


def standings(t):
    who = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select("c_custkey", c("c_nationkey").alias("team"), c("n_regionkey").alias("division"))
    return t.orders.join(who, c("o_custkey") == c("c_custkey")).groupBy("team", "division").agg(
        F.count_if(c("o_orderstatus") == "F").alias("wins"), F.count_if(c("o_orderstatus") == "O").alias("losses"))


W12_SQL = f"SELECT team, division, wins, losses, row_number() OVER d AS rank, ((first(wins) OVER d - wins) + (losses - first(losses) OVER d)) / 2 AS games_back FROM {STANDINGS_SQL} WINDOW d AS (PARTITION BY division ORDER BY wins / nullif(wins + losses, 0) DESC, wins DESC, team)"


@query("W12_games_back", W12_SQL)
def w12(t):
    return W.games_back(standings(t), "division", "team", "wins", "losses")


BASELINE_SQL = "(SELECT subject_id, max(woba) FILTER (year = 2001) AS current, sum(woba * pa) FILTER (year < 2001) / sum(pa) FILTER (year < 2001) AS career FROM @stats GROUP BY 1)"


def baseline(t, year: int = 2001):
    past = c("year") < year
    return t.stats.groupBy("subject_id").agg(
        F.max(F.when(c("year") == year, c("woba"))).alias("current"),
        X.ratio(F.sum(F.when(past, c("woba") * c("pa"))), F.sum(F.when(past, c("pa")))).alias("career"))


@query("W13_career_baseline", f"SELECT subject_id, round(current, 6) AS current, round(career, 6) AS career, round(current - career, 6) AS delta FROM {BASELINE_SQL} WHERE current IS NOT NULL AND career IS NOT NULL")
def w13(t):
    return baseline(t).where("current IS NOT NULL AND career IS NOT NULL").select(
        "subject_id", X.r6("current").alias("current"), X.r6("career").alias("career"), X.r6(c("current") - c("career")).alias("delta"))


@query("W14_bh_rank", f"""SELECT metric_id, subject_id, year, row_number() OVER (PARTITION BY metric_id ORDER BY round_even(1 - pct, 9), subject_id, year) AS bh_rank, count(*) OVER (PARTITION BY metric_id) AS bh_m FROM {PCT_SQL}""")
def w14(t):
    rows = percentiles(t).select("metric_id", "subject_id", "year", F.bround(1 - c("pct"), 9).alias("p"))
    return O.ordinal(rows, ["metric_id"], ["p", "subject_id", "year"], out="bh_rank", size="bh_m").drop("p")


@query("W15_cooldown", """SELECT user_id, day, CAST(day - lag(day) OVER w AS INTEGER) AS gap, coalesce(day - lag(day) OVER w <= 3, false) AS suppressed FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM @live WHERE event_type = 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def w15(t):
    ev = t.live.where("event_type = 'purchase'").select("user_id", c("ts").cast("date").alias("day"))
    return W.cooldown(ev, "user_id", "day", 3)


# ---- top-k -------------------------------------------------------------------
def board_sql(k: int, within: int) -> str:
    return f"""SELECT year, subject_id, hr, rank, is_focal FROM (SELECT *, min(CASE WHEN is_focal THEN rank END) OVER (PARTITION BY year) AS f FROM (SELECT year, subject_id, hr, row_number() OVER (PARTITION BY year ORDER BY hr DESC, price_c DESC, subject_id) AS rank, team = 0 AS is_focal FROM @seasons) WHERE rank <= {within}) WHERE f IS NOT NULL AND rank <= greatest({k}, f)"""


ORDER = lambda: [F.desc("hr"), F.desc("price_c"), c("subject_id")]


@query("T1_leaderboard_with_focal", board_sql(10, 25))
def t1(t):
    return W.top_with_focal(t.seasons, ["year"], ORDER(), c("team") == 0).select("year", "subject_id", "hr", c("rank").cast("bigint").alias("rank"), "is_focal")


FOCAL_TOP_SQL = """SELECT year, subject_id, hr, rank FROM (SELECT year, subject_id, hr, team, row_number() OVER (PARTITION BY year ORDER BY hr DESC, price_c DESC, subject_id) AS rank FROM @seasons) WHERE team = 0 AND rank <= 25 QUALIFY row_number() OVER (PARTITION BY year ORDER BY rank) = 1 AND rank <= 10"""


@query("T2_topn_first_focal", FOCAL_TOP_SQL)
def t2(t):
    return W.first_focal_in_top(t.seasons, ["year"], ORDER(), c("team") == 0).select("year", "subject_id", "hr", c("rank").cast("bigint").alias("rank"))


T3_SQL = f"""SELECT season, team, rank, team = 0 AS is_focal FROM (SELECT *, max(CASE WHEN team = 0 AND rank <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY season) AS has, min(CASE WHEN team = 0 THEN rank END) OVER (PARTITION BY season) AS f
 FROM (SELECT season, team, row_number() OVER (PARTITION BY season ORDER BY payroll_c / nullif(output_c, 0) DESC, team) AS rank FROM ({PAY_SQL}))) WHERE rank <= CASE WHEN has = 1 OR f IS NULL THEN 10 ELSE 9 END OR (has = 0 AND rank = f)"""


@query("T3_bottom_n_forced_focal", T3_SQL)
def t3(t):
    per = payroll(t).withColumn("_r", X.ratio(c("payroll_c"), c("output_c")))
    return W.bottom_with_forced_focal(per, ["season"], [F.desc("_r"), c("team")], c("team") == 0).select("season", "team", c("rank").cast("bigint").alias("rank"), "is_focal")


@query("T4_argmax_story", "SELECT year, subject_id, round(est_woba - woba, 6) AS gap FROM @stats QUALIFY row_number() OVER (PARTITION BY year ORDER BY round(abs(est_woba - woba) * pa / (pa + 220), 9) DESC, subject_id) = 1")
def t4(t):
    gap = c("est_woba") - c("woba")
    rows = t.stats.select("year", "subject_id", gap.alias("gap"), X.rnd(F.abs(gap) * X.reliability(c("pa")), 9).alias("score"))
    return J.best_per_key(rows, ["year"], c("score"), [c("subject_id")]).select("year", "subject_id", X.r6("gap").alias("gap"))


T5_SQL = """WITH s AS (SELECT subject_id, CAST(sum(price_c) AS BIGINT) AS raw, CAST(sum(price_c) * (1 + subject_id % 5) AS BIGINT) AS adj FROM @seasons GROUP BY subject_id),
 e AS (SELECT * FROM s ORDER BY raw DESC, subject_id LIMIT 2), b AS (SELECT * FROM s ORDER BY adj DESC, subject_id LIMIT 12),
 u AS (SELECT subject_id, raw, adj, min(slot) AS slot FROM (SELECT *, 0 AS slot FROM e UNION ALL SELECT *, 1 FROM b) GROUP BY 1, 2, 3)
 SELECT subject_id, raw, adj, explored, k AS slot FROM (SELECT *, slot = 0 AS explored, row_number() OVER (ORDER BY slot, CASE WHEN slot = 0 THEN -raw ELSE -adj END, subject_id) AS k FROM u) WHERE k <= 12"""


@query("T5_topk_with_exploration", T5_SQL)
def t5(t):
    rows = t.seasons.groupBy("subject_id").agg(F.sum("price_c").alias("raw")).withColumn("adj", c("raw") * (1 + c("subject_id") % 5))
    return W.topk_with_exploration(rows, "subject_id", "adj", "raw", 12, 2).withColumn("slot", c("slot").cast("bigint"))


@query("T7_priority_pick", """SELECT user_id, day, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS k FROM @live) WHERE k = 1""")
def t7(t):
    state = F.when(c("event_type") == "purchase", 0).when(c("event_type") == "click", 1).otherwise(2)
    return t.live.groupBy("user_id", c("ts").cast("date").alias("day")).agg(F.min_by("event_id", F.struct(state, c("ts"), c("event_id"))).alias("event_id"))


@query("T8_collapse_to_board", f"""SELECT metric_id, year, subject_id, count(*) OVER (PARTITION BY metric_id, year) AS hits, row_number() OVER (PARTITION BY metric_id, year ORDER BY pct DESC, subject_id) AS place FROM {PCT_SQL} p JOIN supplier ON s_suppkey = subject_id WHERE s_nationkey < 5 AND pct >= 0.8e0 QUALIFY hits >= 3""")
def t8(t):
    from ..operators.scan import collapse_boards
    from .q_joins import focal
    hits = percentiles(t).where("pct >= 0.8D").join(focal(t), "subject_id", "left_semi")
    return collapse_boards(hits, ["metric_id", "year"], "pct", "subject_id", 3).select("metric_id", "year", "subject_id", "hits", "place")
