"""Registered queries: spatial datasets (V) and the study (Y)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import rates as R
from ..operators import spatial as V
from ..operators import study as Y
from ..session import settle
from .q_lenses import APPROACH_SQL, COMPS_SQL, approach, comps
from .q_rates import CELL_SQL, REGION, SWUNG
from .q_windows import CENTS_SQL, event_cents
from .registry import query

c = F.col
KEYS = ["subject_id", "season"]
SPRAY_SQL = """(SELECT label, vec_id AS point_id, CASE vec_id % 5 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'triple' WHEN 3 THEN 'hr' ELSE 'out' END AS kind, round(fx, 1) AS x, round((198.27e0 - hy) * 2.5e0, 1) AS y, (vec_id % 2 = 0 AND fx < 0) OR (vec_id % 2 = 1 AND fx > 0) AS pulled
 FROM (SELECT *, (125 + x * 250 - 125.42e0) * 2.5e0 AS fx, 150 + y * 100 AS hy FROM @points))"""


def spray_points(t):
    m = c("vec_id") % 5
    ev = F.when(m == 0, "single").when(m == 1, "double").when(m == 2, "triple").when(m == 3, "home_run").otherwise("field_out")
    rows = t.points.withColumn("point_id", c("vec_id")).withColumn("kind", X.hit_kind(ev))
    return V.spray(rows, ["label"], 125 + c("x") * 250, 150 + c("y") * 100, F.when(c("vec_id") % 2 == 0, "R").otherwise("L"))


@query("V1_spray", f"SELECT * FROM {SPRAY_SQL}")
def v1(t):
    return spray_points(t)


@query("V1b_spray_summary", f"SELECT label, count(*) AS n, round(count(*) FILTER (pulled) / count(*), 6) AS pull_rate, count(*) < 50 AS small FROM {SPRAY_SQL} GROUP BY 1")
def v1b(t):
    return V.spray_summary(spray_points(t), ["label"])


def type_sql(extra: str, floor: int, keys: str = "subject_id, season") -> str:
    return f"""SELECT {keys}, n, kinds, primary_kind, round(top / n, 6) AS primary_share, {extra}, n < {floor} AS small FROM (SELECT {keys}, CAST(sum(k) AS BIGINT) AS n, max(k) AS top, CAST(count(*) FILTER (k / tot >= 0.02e0) AS INTEGER) AS kinds, min(pitch_type) FILTER (r = 1) AS primary_kind, sum(sf) AS sf, sum(cf) AS cf, sum(sz) AS sz
 FROM (SELECT *, sum(k) OVER (PARTITION BY {keys}) AS tot, row_number() OVER (PARTITION BY {keys} ORDER BY k DESC, pitch_type) AS r FROM (SELECT {keys}, pitch_type, count(*) AS k, CAST(sum(price_c) FILTER (pitch_type = 'FF') AS BIGINT) AS sf, count(*) FILTER (pitch_type = 'FF') AS cf, CAST(sum(tax_c) AS BIGINT) AS sz FROM @pitches GROUP BY ALL)) GROUP BY ALL)"""


@query("V2_movement", type_sql("round(CAST(sf AS BIGINT) / CAST(cf AS BIGINT) / 100000e0, 3) AS fastball", 200))
def v2(t):
    fast = F.when(X.pitch_family(c("pitch_type")) == "fastball", c("price_c"))
    return V.type_summary(t.pitches, KEYS, "pitch_type", {"fastball": fast}, "movement").withColumn("fastball", X.rnd(c("fastball") / 100000.0, 3))


@query("V2b_movement_points", "SELECT vec_id, label, round(x * 12, 1) AS brk_x, round(z * 12, 1) AS brk_z FROM @points")
def v2b(t):
    return t.points.select("vec_id", "label", X.rnd(X.inches(c("x")), 1).alias("brk_x"), X.rnd(X.inches(c("z")), 1).alias("brk_z"))


@query("V3_hotcold", f"""SELECT subject_id, season, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n < 5) AS suppressed, round(CAST(sum(s) AS BIGINT) / CAST(sum(n) AS BIGINT) / 100, 3) AS mean, sum(n) < 150 AS small FROM (SELECT subject_id, season, col, row, count(*) AS n, sum(price_c) AS s FROM (
 SELECT subject_id, season, price_c, {CELL_SQL} FROM @pitches WHERE plate_x BETWEEN -0.83e0 AND 0.83e0 AND plate_z BETWEEN 1.5e0 AND 3.5e0) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")
def v3(t):
    x, z = c("plate_x"), c("plate_z")
    cells = t.pitches.where(X.in_zone(x, z)).groupBy(*KEYS, X.zone_column(x).alias("col"), X.zone_row(z).alias("row")).agg(F.count("*").alias("k"), F.sum("price_c").alias("s"))
    return cells.groupBy(*KEYS).agg(
        F.sum("k").alias("n"), F.count_if(c("k") < 5).alias("suppressed"), X.rnd(F.sum("s") / F.sum("k") / 100, 3).alias("mean"), V.small("hotcold", F.sum("k")).alias("small"))


@query("V4_batspeed", "SELECT subject_id, season, count(*) AS n, round(CAST(sum(price_c) AS BIGINT) / count(*) / 100000e0, 3) AS mean, round(count(*) FILTER (price_c >= 7500000) / count(*), 6) AS fast, count(*) < 100 AS small FROM @pitches WHERE price_c >= 5000000 GROUP BY 1, 2")
def v4(t):
    n = F.count("*")
    return t.pitches.where("price_c >= 5000000").groupBy(*KEYS).agg(
        n.alias("n"), X.rnd(F.sum("price_c") / n / 100000.0, 3).alias("mean"), X.r6(F.count_if(c("price_c") >= 7500000) / n).alias("fast"), V.small("batspeed", n).alias("small"))


@query("V4b_batspeed_bins", "SELECT subject_id, season, bin + 1 AS x, count(*) AS n FROM (SELECT subject_id, season, floor((least(greatest(speed, 50e0), 90e0 - 1e-6) - 50) / 2e0) * 2 + 50e0 AS bin FROM @pitches WHERE price_c >= 5000000) GROUP BY 1, 2, 3")
def v4b(t):
    bins = R.histogram(t.pitches.where("price_c >= 5000000"), KEYS, c("speed"), 50.0, 90.0, 2.0)
    return bins.select(*KEYS, (c("bin") + 1).cast("double").alias("x"), "n")


@query("V5_swingtake", f"SELECT subject_id, season, {REGION} AS region, count(*) AS n, CAST(sum(price_c) AS BIGINT) AS total, round(count(*) FILTER ({SWUNG}) / count(*), 6) AS swing_share FROM (SELECT *, greatest(abs(plate_x) / 0.83e0, abs(plate_z - 2.5e0)) AS r FROM @pitches WHERE hand = 'F') GROUP BY 1, 2, 3")
def v5(t):
    return V.region_sum(t.pitches.where("hand = 'F'"), KEYS, c("plate_x"), c("plate_z"), c("price_c"), c("description").isin(*X.SWINGS))


@query("V6_rolling", f"""SELECT user_id, max(x) AS n, round(max_by(y, x), 4) AS latest, round(max(y), 4) AS peak, max(x) < 100 AS small FROM (SELECT user_id, k AS x, w, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN w - 1 PRECEDING AND CURRENT ROW) AS BIGINT) / w AS y
 FROM (SELECT *, CAST(least(50, greatest(10, floor(n / 4))) AS BIGINT) AS w FROM (SELECT user_id, ts, event_id, {CENTS_SQL} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM @live) WHERE n >= 20)) WHERE x >= w GROUP BY 1""")
def v6(t):
    line = V.rolling_mean(event_cents(t), "user_id", ["ts", "event_id"], "v")
    return line.groupBy("user_id").agg(F.max("x").alias("n"), X.rnd(F.max_by("y", "x"), 4).alias("latest"), X.rnd(F.max("y"), 4).alias("peak"), V.small("rolling", F.max("x")).alias("small"))


@query("V7_release", type_sql("round(CAST(sz AS BIGINT) / n, 6) AS height", 200))
def v7(t):
    return V.type_summary(t.pitches, KEYS, "pitch_type", {"height": c("tax_c")}, "release").withColumn("height", X.r6("height"))


INZ = "plate_x BETWEEN -0.83e0 AND 0.83e0 AND plate_z BETWEEN 1.5e0 AND 3.5e0"


@query("V8_zone", f"SELECT subject_id, season, count(*) AS n, round(count(*) FILTER ({INZ}) / count(*), 6) AS in_zone, count(*) < 100 AS small FROM @pitches WHERE pitch_type = 'FF' GROUP BY 1, 2")
def v8(t):
    return V.share_summary(t.pitches.where("pitch_type = 'FF'"), KEYS, {"in_zone": X.in_zone(c("plate_x"), c("plate_z"))}, "zone")


@query("V9_launch", "SELECT subject_id, season, count(*) AS n, round(count(*) FILTER (zone = 6) / count(*), 6) AS barrel, round(count(*) FILTER (price_c >= 9500000) / count(*), 6) AS hard_hit, count(*) < 40 AS small FROM @pitches GROUP BY 1, 2")
def v9(t):
    return V.share_summary(t.pitches, KEYS, {"barrel": c("zone") == 6, "hard_hit": c("price_c") >= 9500000}, "launch")


@query("V10_hr", "SELECT subject_id, season, count(*) AS n, round(max(price_c) / 100e0, 2) AS longest, round(CAST(sum(price_c) AS BIGINT) / count(*) / 100, 4) AS mean FROM @pitches WHERE zone = 5 AND description <> 'ball' GROUP BY 1, 2")
def v10(t):
    return t.pitches.where("zone = 5 AND description <> 'ball'").groupBy(*KEYS).agg(
        F.count("*").alias("n"), X.rnd(F.max("price_c") / 100.0, 2).alias("longest"), X.rnd(F.sum("price_c") / F.count("*") / 100, 4).alias("mean"))


@query("V11_companion", """SELECT f.subject_id, f.season, detector, f.card, n FROM (SELECT subject_id, year AS season, CASE subject_id % 4 WHEN 0 THEN 'weakness' WHEN 1 THEN 'barrel_rate' WHEN 2 THEN 'pitcher_career_chase' ELSE 'milestone_watch' END AS detector, CASE subject_id % 4 WHEN 0 THEN 'hotcold' WHEN 1 THEN 'launch' WHEN 2 THEN 'movement' END AS card FROM @stats) f
 JOIN (SELECT subject_id, season, 'hotcold' AS card, count(*) FILTER (plate_x BETWEEN -0.83e0 AND 0.83e0 AND plate_z BETWEEN 1.5e0 AND 3.5e0) AS n FROM @pitches GROUP BY 1, 2 UNION ALL SELECT subject_id, season, 'launch', count(*) FROM @pitches GROUP BY 1, 2 UNION ALL SELECT subject_id, season, 'movement', count(*) FROM @pitches GROUP BY 1, 2) d
 ON d.card = f.card AND d.subject_id = f.subject_id AND d.season = f.season""")
def v11(t):
    per = t.pitches.groupBy(*KEYS).agg(F.count("*").alias("_all"), F.count_if(X.in_zone(c("plate_x"), c("plate_z"))).alias("_zone"))
    sets = per.select(*KEYS, F.inline(F.array(
        F.struct(F.lit("hotcold").alias("card"), c("_zone").alias("n")), F.struct(F.lit("launch").alias("card"), c("_all").alias("n")), F.struct(F.lit("movement").alias("card"), c("_all").alias("n")))))
    s = c("subject_id") % 4
    det = F.when(s == 0, "weakness").when(s == 1, "barrel_rate").when(s == 2, "pitcher_career_chase").otherwise("milestone_watch")
    finds = per.select(*KEYS, det.alias("detector"))
    return V.companions(finds, sets).select("subject_id", "season", "detector", "card", "n")


# ---- study -----------------------------------------------------------------
NOW = 2001
MICRO = """(SELECT subject_id, pa, CAST(round_even((est_woba - woba) * 1000000, 0) AS BIGINT) AS gap_u, abs(CAST(round_even((est_ba - ba) * 1000000, 0) AS BIGINT)) AS ba_gap_u, abs(CAST(round_even((hard_hit_percent / 100 - sprint_speed / 60) * 1000000, 0) AS BIGINT)) AS slg_gap_u, exit_velocity, brl_percent FROM @stats WHERE year = 2001)"""
MIN_PA = 70


def season(t):
    u = lambda e: F.bround(e * 1000000, 0).cast("bigint")
    s = t.stats_in(NOW)
    return s.select("subject_id", "pa", u(c("est_woba") - c("woba")).alias("gap_u"), F.abs(u(c("est_ba") - c("ba"))).alias("ba_gap_u"),
                    F.abs(u(c("hard_hit_percent") / 100 - c("sprint_speed") / 60)).alias("slg_gap_u"), "exit_velocity", "brl_percent")


Y1_SQL = f"(SELECT m.subject_id, m.pa, q.gap_u, gap_percentile, pop_n, CASE WHEN pop_n IS NULL THEN 'insufficient' WHEN abs(q.gap_u) >= 20000 THEN 'fired' ELSE 'quiet' END AS verdict FROM {MICRO} m LEFT JOIN (SELECT subject_id, gap_u, round(100 * (rank() OVER (ORDER BY abs(gap_u)) - 1) / count(*) OVER (), 0) AS gap_percentile, count(*) OVER () AS pop_n FROM {MICRO} WHERE pa >= {MIN_PA}) q USING (subject_id))"


@query("Y1_gap", f"SELECT * FROM {Y1_SQL}")
def y1(t):
    return Y.gap_node(season(t), MIN_PA)


Y2_SQL = f"(SELECT subject_id, share, CASE WHEN share >= 0.6e0 THEN 'average' WHEN share <= 0.4e0 THEN 'power' WHEN share IS NOT NULL THEN 'both' END AS carrier, CASE WHEN share IS NULL THEN 'quiet' ELSE 'fired' END AS verdict FROM (SELECT subject_id, ba_gap_u / nullif(ba_gap_u + slg_gap_u, 0) AS share FROM {MICRO}))"


@query("Y2_components", f"SELECT subject_id, round(share, 6) AS share, carrier, verdict FROM {Y2_SQL}")
def y2(t):
    return Y.components_node(season(t)).withColumn("share", X.r6("share"))


Y3_SQL = f"(SELECT m.subject_id, ev_pct, brl_pct, pop_n, CASE WHEN pop_n IS NULL OR pop_n < 30 THEN 'insufficient' WHEN ev_pct >= 0.6e0 OR brl_pct >= 0.6e0 THEN 'fired' ELSE 'quiet' END AS verdict FROM {MICRO} m LEFT JOIN (SELECT subject_id, (rank() OVER (ORDER BY exit_velocity) - 1) / count(*) OVER () AS ev_pct, (rank() OVER (ORDER BY brl_percent) - 1) / count(*) OVER () AS brl_pct, count(*) OVER () AS pop_n FROM {MICRO} WHERE pa >= 60) q USING (subject_id))"


@query("Y3_contact", f"SELECT subject_id, round(ev_pct, 6) AS ev_pct, round(brl_pct, 6) AS brl_pct, pop_n, verdict FROM {Y3_SQL}")
def y3(t):
    return Y.contact_node(season(t), "exit_velocity", "brl_percent", "pa", floor=60).select("subject_id", X.r6("ev_pct").alias("ev_pct"), X.r6("brl_pct").alias("brl_pct"), "pop_n", "verdict")


Y4_SQL = f"(SELECT m.subject_id, delta, z, cohort, CASE WHEN z IS NULL THEN 'insufficient' WHEN abs(z) >= 1 THEN 'fired' ELSE 'quiet' END AS verdict FROM {MICRO} m LEFT JOIN (SELECT * FROM {APPROACH_SQL} WHERE cohort >= 30) a USING (subject_id))"


@query("Y4_approach", f"SELECT subject_id, round(delta, 6) AS delta, round(z, 6) AS z, cohort, verdict FROM {Y4_SQL}")
def y4(t):
    return Y.approach_node(season(t).select("subject_id"), approach(t)).select("subject_id", X.r6("delta").alias("delta"), X.r6("z").alias("z"), "cohort", "verdict")


Y5_SQL = f"(SELECT m.subject_id, coalesce(treated_n, 0) AS treated_n, coalesce(control_n, 0) AS control_n, treated_mean - control_mean AS net, CASE WHEN coalesce(treated_n, 0) < 20 OR coalesce(control_n, 0) < 20 THEN 'insufficient' WHEN abs(treated_mean - control_mean) >= 0.01e0 THEN 'fired' ELSE 'quiet' END AS verdict FROM {MICRO} m LEFT JOIN {COMPS_SQL} USING (subject_id))"


@query("Y5_comps", f"SELECT subject_id, treated_n, control_n, round(net, 6) AS net, verdict FROM {Y5_SQL}")
def y5(t):
    return Y.comps_node(season(t).select("subject_id"), comps(t)).select("subject_id", "treated_n", "control_n", X.r6("net").alias("net"), "verdict")


def dossiers(t):
    s = settle(season(t))  # one season table, four readers
    who = s.select("subject_id")
    return Y.dossier({
        "gap": Y.gap_node(s, MIN_PA), "components": Y.components_node(s), "contact": Y.contact_node(s, "exit_velocity", "brl_percent", "pa", floor=60),
        "approach": Y.approach_node(who, approach(t)), "comps": Y.comps_node(who, comps(t))})


NODES_SQL = f"(SELECT subject_id, 'gap' AS node, verdict FROM {Y1_SQL} UNION ALL SELECT subject_id, 'components', verdict FROM {Y2_SQL} UNION ALL SELECT subject_id, 'contact', verdict FROM {Y3_SQL} UNION ALL SELECT subject_id, 'approach', verdict FROM {Y4_SQL} UNION ALL SELECT subject_id, 'comps', verdict FROM {Y5_SQL})"
DOSSIER_SQL = f"(SELECT subject_id, count(*) FILTER (verdict = 'fired') AS fired, count(*) FILTER (verdict = 'insufficient') AS insufficient, count(*) FILTER (verdict = 'fired' AND node <> 'comps') AS panels, bool_or(node = 'gap' AND verdict = 'fired') AS gap_fired, substr(sha256(string_agg(node || ':' || verdict, ',' ORDER BY node || ':' || verdict)), 1, 16) AS digest FROM {NODES_SQL} GROUP BY 1)"


@query("Y6_dossier", f"SELECT * FROM {DOSSIER_SQL}")
def y6(t):
    return dossiers(t)


@query("Y7_compose_gate", f"SELECT subject_id, panels FROM {DOSSIER_SQL} WHERE gap_fired AND panels >= 3")
def y7(t):
    return Y.publishable(dossiers(t)).select("subject_id", "panels")
