"""Registered queries: aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import ordering as O
from ..operators import rates as R
from ..operators.joins import attach_row
from .q_scalars import PITCHING_SQL, pitching
from .registry import query

c = F.col
SWUNG = "description IN ('swinging_strike', 'foul')"
WHIFF = "description = 'swinging_strike'"
# metric id -> (numerator, denominator, floor, stabilization, higher is better), as check SQL
METRIC_SQL = {
    "chase_rate": (f"zone > 9 AND {SWUNG}", "zone > 9", 50, 250, False),
    "whiff_rate": (WHIFF, SWUNG, 40, 200, False),
    "zone_contact": (f"zone BETWEEN 1 AND 9 AND {SWUNG} AND NOT ({WHIFF})", f"zone BETWEEN 1 AND 9 AND {SWUNG}", 40, 200, True),
    "swing_rate": (SWUNG, "true", 60, 300, True),
}
SIDE_SQL = {
    "all": "true", "p_throws:L": "hand = 'F'", "p_throws:R": "hand = 'O'",
    "pitch_class:breaking": "pitch_type = 'SL'", "pitch_class:fastball": "pitch_type = 'FF'",
    "zone_bucket:chase": "zone BETWEEN 11 AND 14", "zone_bucket:heart": "zone BETWEEN 1 AND 9",
}


def rate_sql(metric: str, where: str = "true", floor: int | None = None, keys: str = "subject_id") -> str:
    top, bottom, low, _stab, _higher = METRIC_SQL[metric]
    low = low if floor is None else floor
    return (
        f"SELECT {keys}, count(*) FILTER ({top}) * 100e0 / nullif(count(*) FILTER ({bottom}), 0) AS value, count(*) FILTER ({bottom}) AS n "
        f"FROM @pitches WHERE {where} GROUP BY ALL HAVING count(*) FILTER ({bottom}) >= {low}"
    )


def _rate_query(name, metric):
    @query(name, f"SELECT subject_id, season, round(value, 6) AS value, n FROM ({rate_sql(metric.id, floor=20, keys='subject_id, season')})")
    def run(t):
        return R.ratio_rate(t.pitches, metric, ["subject_id", "season"], floor=20).withColumn("value", X.r6(c("value")))


@query("A1_ratio_rate", f"SELECT subject_id, round(value, 6) AS value, n FROM ({rate_sql('whiff_rate')})")
def a1(t):
    return R.ratio_rate(t.pitches, R.WHIFF_RATE, ["subject_id"]).withColumn("value", X.r6(c("value")))


_rate_query("A1a_chase_rate", R.CHASE_RATE)
_rate_query("A1b_whiff_rate", R.WHIFF_RATE)
_rate_query("A1c_zone_contact", R.ZONE_CONTACT)
_rate_query("A1d_swing_rate", R.SWING_RATE)


@query("A2_rate_bounded", "SELECT metric_id, count(*) AS subjects, count(*) FILTER (value > 100 + 1e-9) AS over FROM ("
       + " UNION ALL ".join(f"SELECT '{m}' AS metric_id, value FROM ({rate_sql(m)})" for m in METRIC_SQL) + ") GROUP BY 1")
def a2(t):
    return R.all_rates(t.pitches).groupBy("metric_id").agg(
        F.count("*").alias("subjects"), F.count_if(c("value") > 100 + 1e-9).alias("over"))


@query("A3_split_sweep", " UNION ALL ".join(
    f"SELECT '{m}' AS metric_id, '{s}' AS side, subject_id, round(value, 6) AS value, n FROM ({rate_sql(m, w, floor=10)})"
    for m in METRIC_SQL for s, w in SIDE_SQL.items() if not (s.startswith("zone_bucket") and m in ("chase_rate", "zone_contact"))))
def a3(t):
    sides = R.split_sides()
    free = [m for m in R.AGG_METRICS if not m.denominator_columns]
    tied = [m for m in R.AGG_METRICS if m.denominator_columns]
    floors = {m.id: 10 for m in R.AGG_METRICS}
    # One scan for all: incoherent cells (a metric split on its own denominator) are left out.
    got = R.all_rates(t.pitches, R.AGG_METRICS, floors=floors, sides=sides)
    bad = c("metric_id").isin(*[m.id for m in tied]) & c("side").startswith("zone_bucket")
    assert free
    return got.where(~bad).select("metric_id", "side", "subject_id", X.r6(c("value")).alias("value"), "n")


LABEL_SQL = """CASE WHEN qualified <= 0 THEN measured || ' subjects with event-level data' WHEN measured / qualified >= 0.9e0 THEN measured || ' subjects (league-wide coverage)'
 ELSE measured || ' of ' || qualified || ' qualified subjects with event-level data — not the full league' END"""


@query("A4_population_label", f"""SELECT season, measured, qualified, {LABEL_SQL} AS label FROM (
 SELECT season, count(*) AS measured FROM ({rate_sql('zone_contact', floor=15, keys='subject_id, season')}) GROUP BY 1) JOIN (SELECT year, count(*) AS qualified FROM @stats WHERE pa >= 60 GROUP BY 1) ON year = season""")
def a4(t):
    got = R.ratio_rate(t.pitches, R.ZONE_CONTACT, ["subject_id", "season"], floor=15).groupBy("season").agg(F.count("*").alias("measured"))
    want = t.pitches.groupBy("subject_id", "season").agg(F.count("*").alias("pa")).where("pa >= 60").groupBy("season").agg(F.count("*").alias("qualified"))
    return got.join(want, "season").select("season", "measured", "qualified", R.coverage_label(c("measured"), c("qualified")).alias("label"))


@query("A5_weighted_mean", "SELECT team, year, round(sum(woba * pa) / sum(pa), 6) AS mean, CAST(sum(pa) AS BIGINT) AS weight FROM @stats GROUP BY 1, 2")
def a5(t):
    return R.weighted_mean(t.stats, ["team", "year"], "woba", "pa").withColumn("mean", X.r6(c("mean")))


@query("A6_career_totals", "SELECT subject_id, CAST(sum(hr) AS BIGINT) AS total, min(year) AS first_year, max(year) AS last_year FROM @seasons GROUP BY 1 HAVING sum(hr) > 0")
def a6(t):
    return R.career_totals(t.seasons, ["subject_id"], "hr", "year")


@query("A7_per_year_totals", "SELECT subject_id, year, round(war, 6) AS total FROM @seasons WHERE war >= 8")
def a7(t):
    return t.seasons.where("war >= 8").select("subject_id", "year", X.r6(c("war")).alias("total"))


MOVES_SQL = """SELECT subject_id, max(v) FILTER (year = 2001) AS current, avg(v) FILTER (year < 2001) AS prior_mean, count(*) FILTER (year < 2001) AS prior_n FROM (SELECT subject_id, year, avg(ba) AS v FROM @stats GROUP BY 1, 2) GROUP BY 1"""


@query("A8_two_level_mean", f"SELECT count(*) AS cohort, round(avg(current - prior_mean), 6) AS league_move, round(stddev_pop(current - prior_mean), 6) AS sd FROM ({MOVES_SQL}) WHERE current IS NOT NULL AND prior_n >= 3")
def a8(t):
    return R.two_level_moves(t.stats, "subject_id", "year", "ba", 2001, 3).agg(
        F.count("*").alias("cohort"), X.r6(F.avg("move")).alias("league_move"), X.r6(F.stddev_pop("move")).alias("sd"))


@query("A9_count_distinct_coverage", " UNION ALL ".join(f"SELECT '{n}' AS tab, count(*) AS n_rows, count(DISTINCT {y}) AS seasons, count(DISTINCT {s}) AS subjects, CAST(max({d}) AS DATE) AS latest FROM {n}" for n, y, s, d in (
    ("orders", "year(o_orderdate)", "o_custkey", "o_orderdate"), ("lineitem", "year(l_shipdate)", "l_suppkey", "l_shipdate"), ("events", "year(ts)", "user_id", "ts"))))
def a9(t):
    def one(name, df, day, subject):
        return df.agg(
            F.count("*").alias("n_rows"), F.countDistinct(F.year(day)).alias("seasons"),
            F.countDistinct(subject).alias("subjects"), F.max(c(day)).cast("date").alias("latest"),
        ).select(F.lit(name).alias("tab"), "*")
    return (one("orders", t.orders, "o_orderdate", "o_custkey").unionByName(one("lineitem", t.lineitem, "l_shipdate", "l_suppkey"))
            .unionByName(one("events", t.events, "ts", "user_id")))


@query("A10_league_constant", f"""SELECT round(er * 9e0 / (outs / 3e0), 6) AS league_era, round(er * 9e0 / (outs / 3e0) - (13 * hr + 3 * (bb + hbp) - 2 * k) / (outs / 3e0), 6) AS constant
 FROM (SELECT CAST(sum(er) AS BIGINT) AS er, CAST(sum(outs) AS BIGINT) AS outs, CAST(sum(hr) AS BIGINT) AS hr, CAST(sum(bb) AS BIGINT) AS bb, CAST(sum(hbp) AS BIGINT) AS hbp, CAST(sum(k) AS BIGINT) AS k FROM ({PITCHING_SQL}))""")
def a10(t):
    return R.league_constant(pitching(t)).select(X.r6(c("league_era")).alias("league_era"), X.r6(c("constant")).alias("constant"))


@query("A11_daily_team_rate", """SELECT team, game_date, rate FROM (SELECT c_nationkey AS team, game_date, round(CAST(sum(hits) AS BIGINT) / nullif(CAST(sum(ab) AS BIGINT), 0), 6) AS rate,
 row_number() OVER (PARTITION BY c_nationkey ORDER BY game_date DESC) AS k FROM @games JOIN customer ON c_custkey = subject_id GROUP BY 1, 2) WHERE k <= 12""")
def a11(t):
    per = t.games.join(t.customer.select(c("c_custkey").alias("subject_id"), c("c_nationkey").alias("team")), "subject_id").groupBy("team", "game_date").agg(
        X.r6(F.sum("hits") / F.nullif(F.sum("ab"), F.lit(0))).alias("rate"))
    w = Window.partitionBy("team").orderBy(F.desc("game_date"))
    return per.withColumn("k", F.row_number().over(w)).where("k <= 12").drop("k")


@query("A12_game_ledger", """SELECT team, count(*) FILTER (pf > pa) AS wins, count(*) FILTER (pf <= pa) AS losses, CAST(sum(pf) AS BIGINT) AS runs_for, CAST(sum(pa) AS BIGINT) AS runs_against,
 count(*) FILTER (pf > pa AND pf - pa <= 500000) AS close_w, count(*) FILTER (pf <= pa AND pa - pf <= 500000) AS close_l
 FROM (SELECT team, game_date, CAST(sum(CASE WHEN side = 'home' THEN p ELSE 0 END) AS BIGINT) AS pf, CAST(sum(CASE WHEN side = 'away' THEN p ELSE 0 END) AS BIGINT) AS pa
  FROM (SELECT c_nationkey AS team, game_date, CASE WHEN hits > 0 THEN 'home' ELSE 'away' END AS side, price_c AS p FROM @games JOIN customer ON c_custkey = subject_id) GROUP BY 1, 2) GROUP BY 1""")
def a12(t):
    who = t.customer.select(c("c_custkey").alias("subject_id"), c("c_nationkey").alias("team"))
    day = t.games.join(who, "subject_id").groupBy("team", "game_date").agg(
        F.sum(F.when(c("hits") > 0, c("price_c")).otherwise(0)).alias("pf"), F.sum(F.when(c("hits") > 0, 0).otherwise(c("price_c"))).alias("pa"))
    won, gap = c("pf") > c("pa"), F.abs(c("pf") - c("pa"))
    return day.groupBy("team").agg(
        F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.sum("pf").alias("runs_for"), F.sum("pa").alias("runs_against"),
        F.count_if(won & (gap <= 500000)).alias("close_w"), F.count_if(~won & (gap <= 500000)).alias("close_l"))


@query("A13_count_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE month(o_orderdate) = 7 GROUP BY 1 ORDER BY 1 DESC LIMIT 8")
def a13(t):
    return t.orders.where(F.month("o_orderdate") == 7).groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(8)


@query("A14_label_counts", """SELECT lang, source, count(*) AS n, round(avg(CASE WHEN toxic = 1 THEN 1e0 ELSE 0e0 END), 6) AS block_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""")
def a14(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source").agg(
        F.count("*").alias("n"), X.r6(F.avg(F.when(c("toxic") == 1, 1.0).otherwise(0.0))).alias("block_rate"))


@query("A15_scorecard", """SELECT detector, correct, incorrect, push, round(correct / nullif(correct + incorrect, 0), 6) AS accuracy FROM (
 SELECT o_orderpriority AS detector, count(*) FILTER (o_orderstatus = 'F') AS correct, count(*) FILTER (o_orderstatus = 'O') AS incorrect, count(*) FILTER (o_orderstatus = 'P') AS push FROM orders GROUP BY 1)""")
def a15(t):
    n = lambda s: F.count_if(c("o_orderstatus") == s)
    got = t.orders.groupBy(c("o_orderpriority").alias("detector")).agg(n("F").alias("correct"), n("O").alias("incorrect"), n("P").alias("push"))
    return got.withColumn("accuracy", X.r6(X.ratio(c("correct"), c("correct") + c("incorrect"))))


@query("A16_histogram", """SELECT subject_id, bin, count(*) AS n FROM (SELECT subject_id, floor((least(greatest(speed, 50e0), 90e0 - 1e-6) - 50) / 2e0) * 2 + 50e0 AS bin FROM @pitches) GROUP BY 1, 2""")
def a16(t):
    return R.histogram(t.pitches, ["subject_id"], c("speed"), 50.0, 90.0, 2.0).withColumn("bin", c("bin").cast("double"))


CELL_SQL = """CAST(least(floor((0.83e0 - plate_x) / (1.66e0 / 3)), 2) AS INTEGER) AS col, CAST(least(floor((3.5e0 - plate_z) / (2e0 / 3)), 2) AS INTEGER) AS row"""


@query("A17_grid_mean", f"""SELECT subject_id, season, col, row, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(CAST(sum(price_c) AS BIGINT) / count(*) / 100, 3) END AS value
 FROM (SELECT subject_id, season, price_c, {CELL_SQL} FROM @pitches WHERE plate_x BETWEEN -0.83e0 AND 0.83e0 AND plate_z BETWEEN 1.5e0 AND 3.5e0) GROUP BY 1, 2, 3, 4""")
def a17(t):
    from ..operators.spatial import grid_mean
    return grid_mean(t.pitches, ["subject_id", "season"], c("plate_x"), c("plate_z"), c("price_c"), scale=100)


REGION = "CASE WHEN r <= 0.67e0 THEN 'heart' WHEN r <= 1.33e0 THEN 'shadow' WHEN r <= 2 THEN 'chase' ELSE 'waste' END"


@query("A18_region_sum", f"""SELECT subject_id, {REGION} AS region, count(*) AS n, CAST(sum(price_c) AS BIGINT) AS total, round(count(*) FILTER ({SWUNG}) / count(*), 6) AS swing_share
 FROM (SELECT *, greatest(abs(plate_x) / 0.83e0, abs(plate_z - 2.5e0)) AS r FROM @pitches) GROUP BY 1, 2""")
def a18(t):
    from ..operators.spatial import region_sum
    return region_sum(t.pitches, ["subject_id"], c("plate_x"), c("plate_z"), c("price_c"), c("description").isin(*X.SWINGS))


MIX_SQL = """SELECT subject_id, pitch_type, n, share, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, pitch_type) = 1 AS is_primary FROM (
 SELECT subject_id, pitch_type, n, n / sum(n) OVER (PARTITION BY subject_id) AS share FROM (SELECT subject_id, pitch_type, count(*) AS n FROM @pitches GROUP BY 1, 2)) WHERE share >= 0.02e0"""


@query("A19_mix_share", f"SELECT subject_id, pitch_type, n, round(share, 6) AS share, is_primary FROM ({MIX_SQL})")
def a19(t):
    return R.mix_share(t.pitches, ["subject_id"], "pitch_type").withColumn("share", X.r6(c("share")))


@query("A20_exact_quantile_cut", """SELECT metric, round(quantile_cont(v, 0.9), 6) AS cut FROM (UNPIVOT (SELECT exit_velocity, sprint_speed, k_percent FROM @stats) ON exit_velocity, sprint_speed, k_percent INTO NAME metric VALUE v) GROUP BY 1""")
def a20(t):
    long = t.stats.unpivot(["subject_id"], ["exit_velocity", "sprint_speed", "k_percent"], "metric", "v").select("metric", "v")
    return O.quantile_cut(long, ["metric"], "v", 0.9).withColumn("cut", X.r6(c("cut")))


@query("A21_union_labels", """SELECT doc_id, count(*) AS decisions, max(promoted) AS promoted FROM (
 SELECT doc_id, quality = 1 AS promoted FROM labels UNION ALL SELECT doc_id, false AS promoted FROM documents WHERE n_chars < 200) GROUP BY 1""")
def a21(t):
    a = t.labels.select("doc_id", (c("quality") == 1).alias("promoted"))
    b = t.documents.where("n_chars < 200").select("doc_id", F.lit(False).alias("promoted"))
    return a.unionByName(b).groupBy("doc_id").agg(F.count("*").alias("decisions"), F.max("promoted").alias("promoted"))


@query("A22_club_size", """SELECT CAST(milestone AS INTEGER) AS milestone, count(*) FILTER (total >= milestone) AS members, count(*) FILTER (total >= milestone AND games >= milestone * 2) AS joint
 FROM (SELECT subject_id, sum(hr) AS total, sum(n) AS games FROM @seasons GROUP BY 1) JOIN (VALUES (3), (5), (8), (10)) m(milestone) ON true GROUP BY 1""")
def a22(t):
    per = t.seasons.groupBy("subject_id").agg(F.sum("hr").alias("total"), F.sum("n").alias("games"))
    marks = (3, 5, 8, 10)
    one = per.agg(*[F.count_if(c("total") >= m).alias(f"m{m}") for m in marks], *[F.count_if((c("total") >= m) & (c("games") >= 2 * m)).alias(f"j{m}") for m in marks])
    rows = F.array(*[F.struct(F.lit(m).alias("milestone"), c(f"m{m}").alias("members"), c(f"j{m}").alias("joint")) for m in marks])
    return one.select(F.inline(rows))


@query("A23_exposure_latest", """SELECT user_id, event_type, max(ts) AS captured_at FROM @live GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25""")
def a23(t):
    return t.live.groupBy("user_id", "event_type").agg(F.max("ts").alias("captured_at")).orderBy(F.desc("captured_at"), "user_id", "event_type").limit(25)


@query("A24a_view_all_candidates", "SELECT subject_id, year, round(war, 3) AS novelty_score FROM @seasons ORDER BY war DESC, subject_id, year LIMIT 200")
def a24a(t):
    return t.seasons.orderBy(F.desc("war"), "subject_id", "year").limit(200).select("subject_id", "year", X.rnd("war", 3).alias("novelty_score"))


@query("A24b_view_leaderboard", """SELECT year, subject_id, team, hr AS value, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY hr DESC, subject_id) AS k FROM @seasons) WHERE k <= 30 ORDER BY year DESC, k LIMIT 300""")
def a24b(t):
    w = Window.partitionBy("year").orderBy(F.desc("hr"), "subject_id")  # row_number <= 30 is cut before the shuffle
    return t.seasons.withColumn("rank", F.row_number().over(w)).where("rank <= 30").orderBy(F.desc("year"), "rank").limit(300).select(
        "year", "subject_id", "team", c("hr").alias("value"), c("rank").cast("bigint").alias("rank"))


@query("A24c_view_franchise_total", """SELECT name, round(CAST(sum(price_c) AS BIGINT) / 10000000e0, 1) AS career_war, min(year) AS first_yr, max(year) AS last_yr, count(DISTINCT year) AS seasons
 FROM @seasons WHERE team = 0 AND war > 0 GROUP BY name, subject_id ORDER BY CAST(sum(price_c) AS BIGINT) DESC, subject_id LIMIT 30""")
def a24c(t):
    got = t.seasons.where("team = 0 AND war > 0").groupBy("name", "subject_id").agg(
        F.sum("price_c").alias("p"), F.min("year").alias("first_yr"), F.max("year").alias("last_yr"), F.countDistinct("year").alias("seasons"))
    return got.orderBy(F.desc("p"), "subject_id").limit(30).select("name", X.rnd(c("p") / 10000000.0, 1).alias("career_war"), "first_yr", "last_yr", "seasons")


@query("A24d_view_cost_per_output", """SELECT season, team, payroll_m, total_war, round(payroll_m / nullif(total_war, 0), 2) AS m_per_war FROM (
 SELECT year AS season, team, round(CAST(sum(CAST(floor(bal * 100 + 0.5e0) AS BIGINT)) AS BIGINT) / 100e3, 1) AS payroll_m, round(CAST(sum(greatest(price_c, 0)) AS BIGINT) / 10000000e0, 1) AS total_war
 FROM @seasons JOIN (SELECT c_custkey, c_acctbal AS bal FROM customer) ON c_custkey = subject_id GROUP BY 1, 2) WHERE season = (SELECT max(year) - 1 FROM @seasons) ORDER BY m_per_war DESC, team LIMIT 30""")
def a24d(t):
    pay = t.customer.select(c("c_custkey").alias("subject_id"), F.floor(c("c_acctbal") * 100 + 0.5).alias("bal_c"))
    last = t.orders.agg((F.max(F.year("o_orderdate")) - 1).alias("_y"))
    per = t.seasons.join(pay, "subject_id").groupBy(c("year").alias("season"), "team").agg(
        X.rnd(F.sum("bal_c") / 100e3, 1).alias("payroll_m"), X.rnd(F.sum(F.greatest("price_c", F.lit(0))) / 10000000.0, 1).alias("total_war"))
    got = attach_row(per, last).where("season = _y").withColumn("m_per_war", X.rnd(X.ratio(c("payroll_m"), c("total_war")), 2))
    return got.drop("_y").orderBy(F.desc("m_per_war"), "team").limit(30)


@query("A24e_view_draft_history", """SELECT d.doc_id, quality, substr(text, 1, 100) AS caption_preview FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY d.doc_id DESC LIMIT 100""")
def a24e(t):
    top = t.documents.select("doc_id", "text").orderBy(F.desc("doc_id")).limit(100)  # limit first: the left join adds no rows per id
    return top.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "quality", F.substring("text", 1, 100).alias("caption_preview"))


@query("A25_windowed_agg", """SELECT user_id, round(CAST(sum(c) AS BIGINT) / count(*) / 100, 6) AS value, count(*) AS n FROM (SELECT user_id, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS c, CAST(ts AS DATE) AS d FROM @live)
 WHERE d >= (SELECT CAST(max(ts) AS DATE) - 14 FROM @live) AND d <= (SELECT CAST(max(ts) AS DATE) FROM @live) GROUP BY 1 HAVING count(*) >= 8""")
def a25(t):
    ev = t.live.select("user_id", c("ts").cast("date").alias("d"), F.floor(c("value") * 100 + 0.5).alias("v"))
    ev = attach_row(ev, t.live.agg(F.max("ts").cast("date").alias("as_of")))
    return R.windowed_agg(ev, ["user_id"], "d", "v", c("as_of"), 14, 8).withColumn("value", X.r6(c("value") / 100))
