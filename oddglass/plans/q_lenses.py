"""Registered queries: lenses and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import contrast as C
from ..operators import lenses as L
from ..operators import rates as R
from ..operators import windows as W
from .q_joins import COHORT_SQL, PCT_SQL, REGISTRY_SQL, cohort_moves, percentiles, registry_rows
from .q_rates import METRIC_SQL, MOVES_SQL, rate_sql
from .q_scalars import confidence_sql, family_sql
from .q_windows import BASELINE_SQL, W9_SQL, W10_SQL, baseline, event_halves, games_split
from .registry import query

c = F.col

RATE_ROWS_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric_id, subject_id, value, n, {d[3]} AS stab, {str(d[4]).lower()} AS higher FROM ({rate_sql(m)})" for m, d in METRIC_SQL.items()) + ")"
EXTREME_SQL = f"""(SELECT *, 0.5e0 + (pct - 0.5e0) * least(1, n / stab) AS rarity FROM (SELECT *, (rank() OVER (PARTITION BY metric_id ORDER BY CASE WHEN higher THEN value ELSE -value END) - 1) / count(*) OVER (PARTITION BY metric_id) AS pct, count(*) OVER (PARTITION BY metric_id) AS pop_n FROM {RATE_ROWS_SQL})
 WHERE pop_n >= 10 AND n >= greatest(10, floor(stab / 5)))"""


def rate_rows(t):
    return R.all_rates(t.pitches)


@query("L1_extremeness", f"SELECT metric_id, subject_id, round(value, 6) AS value, n, round(pct, 6) AS pct, round(rarity, 6) AS rarity FROM {EXTREME_SQL} WHERE rarity >= 0.8e0")
def l1(t):
    return L.extremeness(rate_rows(t), ["metric_id"]).select(
        "metric_id", "subject_id", X.r6("value").alias("value"), "n", X.r6("pct").alias("pct"), X.r6("rarity").alias("rarity"))


RANK_SQL = f"""(SELECT *, 1 - (rank - 1) / least(15, greatest(1, floor(pop_n / 4))) AS rarity FROM (SELECT *, row_number() OVER (PARTITION BY metric_id, year ORDER BY CASE WHEN higher THEN -value ELSE value END, subject_id) AS rank, count(*) OVER (PARTITION BY metric_id, year) AS pop_n FROM {REGISTRY_SQL}) WHERE rank <= least(15, greatest(1, floor(pop_n / 4))))"""


@query("L2_rank", f"SELECT metric_id, year, subject_id, rank, round(rarity, 6) AS rarity FROM {RANK_SQL}")
def l2(t):
    return L.rank(registry_rows(t), ["metric_id", "year"]).select("metric_id", "year", "subject_id", c("rank").cast("bigint").alias("rank"), X.r6("rarity").alias("rarity"))


@query("L3_pace", """SELECT subject_id, season, round(pace, 6) AS pace, round(CASE WHEN k >= 40 THEN 0.95e0 ELSE least(0.9e0, 0.5e0 + (pace - 40) / 40) END, 6) AS rarity
 FROM (SELECT *, k * 162e0 / n AS pace FROM (SELECT subject_id, season, count(*) AS n, count(*) FILTER (description = 'swinging_strike') AS k FROM @pitches GROUP BY 1, 2)) WHERE n >= 10 AND n < 162 AND (k >= 40 OR pace >= 40)""")
def l3(t):
    per = t.pitches.groupBy("subject_id", "season").agg(F.count("*").alias("n"), F.count_if(c("description") == "swinging_strike").alias("k"))
    return L.pace(per, "k", "n", 162, 40.0).select("subject_id", "season", X.r6("pace").alias("pace"), X.r6("rarity").alias("rarity"))


@query("L4_milestone_proximity", """SELECT subject_id, year, milestone, round(0.8e0 + 0.15e0 * (1 - (milestone - k_percent) / milestone / 0.1e0), 6) AS rarity FROM @stats, (VALUES (30e0), (40e0)) m(milestone)
 WHERE (milestone - k_percent) / milestone > 0 AND (milestone - k_percent) / milestone <= 0.1e0""")
def l4(t):
    return L.milestone_proximity(t.stats, "k_percent", [30.0, 40.0]).select("subject_id", "year", "milestone", X.r6("rarity").alias("rarity"))


@query("L5_percentile_elite", f"SELECT metric_id, subject_id, year, round(least(pct, 0.99e0), 6) AS rarity FROM {PCT_SQL} WHERE pct * 100 >= 85")
def l5(t):
    return L.percentile_elite(percentiles(t), c("pct") * 100).select("metric_id", "subject_id", "year", X.r6("rarity").alias("rarity"))


PAIR_SQL = (("platoon", "hand = 'F'", "hand = 'O'"), ("class", "pitch_type = 'SL'", "pitch_type = 'FF'"), ("zone", "zone BETWEEN 11 AND 14", "zone BETWEEN 1 AND 9"))
CONTRASTS_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric_id, '{p}' AS pair, x.subject_id, x.value AS a_value, y.value AS b_value, x.n AS a_n, y.n AS b_n, {d[3]} AS stab FROM ({rate_sql(m, a, 60)}) x JOIN ({rate_sql(m, b, 60)}) y ON y.subject_id = x.subject_id"
    for m, d in METRIC_SQL.items() for p, a, b in PAIR_SQL if not (p == "zone" and m in ("chase_rate", "zone_contact"))) + ")"
CONTRAST_LENS_SQL = f"""(SELECT *, 0.5e0 + (gap_percentile - 0.5e0) * least(1, least(a_n, b_n) / stab) AS rarity FROM (SELECT *, (rank() OVER (PARTITION BY metric_id, pair ORDER BY gap) - 1) / count(*) OVER (PARTITION BY metric_id, pair) AS gap_percentile, count(*) OVER (PARTITION BY metric_id, pair) AS pop_n
 FROM (SELECT *, round_even(abs(a_value - b_value), 9) AS gap FROM {CONTRASTS_SQL})) WHERE pop_n >= 40)"""


def contrasts(t):
    return C.all_contrasts(t.pitches, R.AGG_METRICS, R.CONTRAST_PAIRS, ["subject_id"])


@query("L6_split_contrast", f"SELECT metric_id, pair, subject_id, round(a_value, 6) AS a_value, round(b_value, 6) AS b_value, a_n, b_n, round(gap_percentile, 6) AS gap_percentile, round(rarity, 6) AS rarity FROM {CONTRAST_LENS_SQL} WHERE rarity >= 0.85e0")
def l6(t):
    return C.split_contrast_lens(contrasts(t), ["metric_id", "pair"]).select(
        "metric_id", "pair", "subject_id", *[X.r6(k).alias(k) for k in ("a_value", "b_value", "gap_percentile", "rarity")], "a_n", "b_n")


FAMILY_OF = family_sql("metric_id")
HITS_SQL = f"(SELECT {FAMILY_OF} AS family, metric_id, subject_id, year, pct AS rarity, round_even(1 - pct, 9) AS p, pop_n FROM {PCT_SQL} WHERE pct >= 0.85e0)"
BH_SQL = f"(SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, metric_id, subject_id, year) AS bh_rank, count(*) OVER (PARTITION BY family) AS bh_m FROM {HITS_SQL})"


def family_hits(t, floor: float = 0.85):
    return percentiles(t).where(c("pct") >= floor).select(
        X.metric_family(c("metric_id")).alias("family"), "metric_id", "subject_id", "year", c("pct").alias("rarity"), F.bround(1 - c("pct"), 9).alias("p"), "pop_n")


@query("L7_bh_fdr", f"SELECT family, metric_id, subject_id, year, bh_rank, bh_m, p <= bh_rank / bh_m * 0.05e0 AS survives FROM {BH_SQL}")
def l7(t):
    return L.bh(family_hits(t), ["family"], "p", ["metric_id", "subject_id", "year"]).select("family", "metric_id", "subject_id", "year", "bh_rank", "bh_m", "survives")


@query("L7b_bh_step_up", f"SELECT family, metric_id, subject_id, year, bh_rank <= coalesce(max(CASE WHEN p <= bh_rank / bh_m * 0.2e0 THEN bh_rank END) OVER (PARTITION BY family), 0) AS survives FROM {BH_SQL}")
def l7b(t):
    return L.bh(family_hits(t), ["family"], "p", ["metric_id", "subject_id", "year"], alpha=0.2, mode="step_up").select("family", "metric_id", "subject_id", "year", "survives")


@query("L8_bh_feasible", f"SELECT family, max(pop_n) AS population, count(*) AS battery, 1 / max(pop_n) <= 0.05e0 / count(*) AS feasible FROM {HITS_SQL} GROUP BY 1")
def l8(t):
    per = family_hits(t).groupBy("family").agg(F.max("pop_n").alias("population"), F.count("*").alias("battery"))
    return per.withColumn("feasible", L.bh_feasible(c("population"), c("battery")))


@query("L9_expected_false", f"SELECT metric_id, year, count(*) AS battery, round(count(*) * 0.15e0, 6) AS expected FROM {PCT_SQL} GROUP BY 1, 2")
def l9(t):
    return registry_rows(t).groupBy("metric_id", "year").agg(F.count("*").alias("battery")).withColumn("expected", X.r6(L.expected_false(c("battery"), 0.85)))


Z_SQL = "(r_recent / n_recent - r_prior / n_prior) / sqrt((r_prior + r_recent) / (n_prior + n_recent) * (1 - (r_prior + r_recent) / (n_prior + n_recent)) * (1e0 / n_prior + 1e0 / n_recent))"
TWO_PROP_SQL = f"(SELECT user_id, n_prior, n_recent, r_recent / n_recent - r_prior / n_prior AS delta, {confidence_sql('z')} AS p_real FROM (SELECT *, {Z_SQL} AS z FROM ({W9_SQL}) WHERE r_prior + r_recent > 0 AND r_prior + r_recent < n_prior + n_recent))"


def proportion_test(t):
    delta, real = W.two_proportion(c("r_prior"), c("n_prior"), c("r_recent"), c("n_recent"))
    live = games_split(t).where("r_prior + r_recent > 0 AND r_prior + r_recent < n_prior + n_recent")
    return live.select("user_id", "n_prior", "n_recent", delta.alias("delta"), real.alias("p_real"))


@query("L10_two_proportion", f"SELECT user_id, round(delta, 6) AS delta, round(p_real, 5) AS p_real FROM {TWO_PROP_SQL}")
def l10(t):
    return proportion_test(t).select("user_id", X.r6("delta").alias("delta"), X.rnd("p_real", 5).alias("p_real"))


WELCH_SQL = f"(SELECT user_id, n0, n1, mean1 - mean0 AS delta, {confidence_sql('((mean1 - mean0) / sqrt(var0 / n0 + var1 / n1))')} AS p_real FROM ({W10_SQL}) WHERE var0 / n0 + var1 / n1 > 0)"


def welch_test(t):
    h = event_halves(t).where("var0 / n0 + var1 / n1 > 0")
    delta, real = W.welch(c("mean0"), c("var0"), c("n0"), c("mean1"), c("var1"), c("n1"))
    return h.select("user_id", "n0", "n1", delta.alias("delta"), real.alias("p_real"))


@query("L11_welch", f"SELECT user_id, round(delta, 4) AS delta, round(p_real, 5) AS p_real FROM {WELCH_SQL}")
def l11(t):
    return welch_test(t).select("user_id", X.rnd("delta", 4).alias("delta"), X.rnd("p_real", 5).alias("p_real"))


FIELD_SQL = f"(SELECT * FROM ({COHORT_SQL}) WHERE prior_ab >= 2 AND recent_ab >= 2 AND subject_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 0))"
DRIFT_SQL = f"(SELECT avg(move) AS drift, stddev_samp(move) AS sd, count(*) AS cohort FROM {FIELD_SQL} HAVING count(*) >= 20)"


def own_team(t):
    return t.customer.where("c_nationkey = 0").select(c("c_custkey").alias("subject_id"))


def drift(t):
    return L.cohort_drift(cohort_moves(t).where("prior_ab >= 2 AND recent_ab >= 2").join(own_team(t), "subject_id", "left_anti"))


@query("L12_cohort_drift", f"SELECT round(drift, 6) AS drift, round(sd, 6) AS sd, cohort FROM {DRIFT_SQL}")
def l12(t):
    return drift(t).select(X.r6("drift").alias("drift"), X.r6("sd").alias("sd"), "cohort")


CONTROL_SQL = f"(SELECT subject_id, move, move - drift AS residual, (move - drift) / sd AS z, prior_ab + recent_ab AS n, cohort FROM ({COHORT_SQL}), {DRIFT_SQL} WHERE prior_ab >= 2 AND recent_ab >= 2 AND subject_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 0))"


def league_control(t):
    from ..operators.joins import attach_row
    own = cohort_moves(t).where("prior_ab >= 2 AND recent_ab >= 2").join(own_team(t), "subject_id", "left_semi")
    got = attach_row(own, drift(t))
    return got.select("subject_id", "move", (c("move") - c("drift")).alias("residual"), ((c("move") - c("drift")) / c("sd")).alias("z"), (c("prior_ab") + c("recent_ab")).alias("n"), "cohort")


@query("L13_league_control", f"SELECT subject_id, round(residual, 6) AS residual, round(z, 6) AS z FROM {CONTROL_SQL} WHERE abs(residual) >= 0.04e0 AND abs(z) >= 1.0e0")
def l13(t):
    return league_control(t).where((F.abs("residual") >= 0.04) & (F.abs("z") >= 1.0)).select("subject_id", X.r6("residual").alias("residual"), X.r6("z").alias("z"))


COHORT_MOVES_SQL = f"(SELECT subject_id, current, prior_mean, prior_n, current - prior_mean AS move FROM ({MOVES_SQL}) WHERE current IS NOT NULL AND prior_n >= 3)"


def career_moves(t):
    return R.two_level_moves(t.stats.where("pa >= 1"), "subject_id", "year", "ba", 2001, 3)


@query("L14_career_shift", f"SELECT subject_id, round(current, 6) AS current, round(prior_mean, 6) AS baseline, round(move - lm, 6) AS net, round((move - lm) / sd, 6) AS z FROM {COHORT_MOVES_SQL}, (SELECT avg(move) AS lm, stddev_pop(move) AS sd, count(*) AS n FROM {COHORT_MOVES_SQL}) WHERE n >= 30 AND abs((move - lm) / sd) >= 1.8e0")
def l14(t):
    return L.career_shift(career_moves(t)).select(
        "subject_id", X.r6("current").alias("current"), X.r6("prior_mean").alias("baseline"), X.r6("net").alias("net"), X.r6("z").alias("z"))


@query("L15_shift_rarity", f"SELECT subject_id, round(least(0.95e0, (rank() OVER (ORDER BY a) - 1) / count(*) OVER ()), 6) AS rarity FROM (SELECT subject_id, round_even(abs(move - lm), 9) AS a FROM {COHORT_MOVES_SQL}, (SELECT avg(move) AS lm FROM {COHORT_MOVES_SQL}))")
def l15(t):
    return L.shift_rarity(career_moves(t)).select("subject_id", X.r6("rarity").alias("rarity"))


@query("L16_self_surprise", f"SELECT subject_id, round(0.8e0 + least(0.7e0, abs(current - career) / 0.15e0 * 0.7e0), 6) AS multiplier FROM {BASELINE_SQL} WHERE current IS NOT NULL AND career IS NOT NULL")
def l16(t):
    return baseline(t).where("current IS NOT NULL AND career IS NOT NULL").select(
        "subject_id", X.r6(L.self_surprise(c("current") - c("career"))).alias("multiplier"))


@query("L16b_team_surprise", """SELECT team, round(0.8e0 + least(0.7e0, abs((g - m) / sd) / 2.5e0 * 0.7e0), 6) AS multiplier FROM (SELECT team, sum((woba - est_woba) * pa) / sum(pa) AS g FROM @stats WHERE year = 2001 GROUP BY 1), (SELECT avg(woba - est_woba) AS m, stddev_pop(woba - est_woba) AS sd FROM @stats WHERE year = 2001 AND pa >= 40)""")
def l16b(t):
    from ..operators.joins import attach_row
    now = t.stats_in(2001).withColumn("g", c("woba") - c("est_woba"))
    league = now.where("pa >= 40").agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("sd"))
    team = R.weighted_mean(now, ["team"], "g", "pa", "g")
    z = (c("g") - c("m")) / c("sd")
    return attach_row(team, league).select("team", X.r6(L.self_surprise(z, 2.5)).alias("multiplier"))


MICRO_SQL = "(SELECT subject_id, year, pa, woba, CAST(round_even((est_woba - woba) * 1000000, 0) AS BIGINT) AS gap_u, CAST(round_even(woba * 1000000, 0) AS BIGINT) AS level_u FROM @stats)"
PAIRS_SQL = f"(SELECT a.subject_id AS sid, a.gap_u AS g, a.level_u AS l, b.woba - a.woba AS move FROM {MICRO_SQL} a JOIN {MICRO_SQL} b ON b.subject_id = a.subject_id AND b.year = a.year + 1 WHERE a.year < 2001)"
COMPS_SQL = f"""(SELECT p.subject_id, gap_u, level_u, count(*) FILTER (abs(g - gap_u) <= 12000) AS treated_n, count(*) FILTER (abs(l - level_u) <= 20000 AND abs(g) <= 5000) AS control_n,
 avg(move) FILTER (abs(g - gap_u) <= 12000) AS treated_mean, avg(move) FILTER (abs(l - level_u) <= 20000 AND abs(g) <= 5000) AS control_mean,
 avg(CASE WHEN move > 0 THEN 1e0 ELSE 0e0 END) FILTER (abs(g - gap_u) <= 12000) AS treated_up, avg(CASE WHEN move > 0 THEN 1e0 ELSE 0e0 END) FILTER (abs(l - level_u) <= 20000 AND abs(g) <= 5000) AS control_up
 FROM {MICRO_SQL} p JOIN {PAIRS_SQL} s ON sid <> p.subject_id WHERE year = 2001 GROUP BY 1, 2, 3)"""


def micro(t):
    u = lambda e: F.bround(e * 1000000, 0).cast("bigint")
    return t.stats.select("subject_id", "year", "woba", u(c("est_woba") - c("woba")).alias("gap_u"), u(c("woba")).alias("level_u"))


def comps(t, year: int = 2001):
    from ..operators.joins import next_period
    m = micro(t)
    pairs = next_period(m, "subject_id", "year", {"woba": "next_woba"}).where(c("year") < year).select(
        "subject_id", "gap_u", "level_u", (c("next_woba") - c("woba")).alias("move"))
    probes = m.where(c("year") == year).select("subject_id", "gap_u", "level_u")
    return L.matched_control(pairs, probes, "subject_id", gap_within=12000, level_within=20000, control_gap=5000)


@query("L17_matched_control", f"SELECT subject_id, treated_n, control_n, round(treated_mean, 6) AS treated_mean, round(control_mean, 6) AS control_mean, round(treated_up, 6) AS treated_up, round(control_up, 6) AS control_up, abs(treated_mean - control_mean) >= 0.01e0 AS fired FROM {COMPS_SQL} WHERE treated_n >= 20 AND control_n >= 20")
def l17(t):
    return comps(t).where("treated_n >= 20 AND control_n >= 20").select(
        "subject_id", "treated_n", "control_n", *[X.r6(k).alias(k) for k in ("treated_mean", "control_mean", "treated_up", "control_up")], (F.abs("net") >= 0.010).alias("fired"))


def chase_year(y: int) -> str:
    return rate_sql("chase_rate", f"season = {y}", 10)


APPROACH_SQL = f"(SELECT *, count(*) OVER () AS cohort, delta / stddev_pop(delta) OVER () AS z FROM (SELECT a.subject_id, a.value, b.value AS prior_value, a.n, a.value - b.value AS delta FROM ({chase_year(2001)}) a JOIN ({chase_year(2000)}) b ON b.subject_id = a.subject_id))"


def approach(t, year: int = 2001):
    # Both years from one scan: the year is a key of the aggregate.
    two = R.ratio_rate(t.pitches_in(year - 1, year), R.CHASE_RATE, ["subject_id", "season"], floor=10)
    return L.year_over_year_z(two.where(c("season") == year).drop("season"), two.where(c("season") == year - 1), "subject_id")


@query("L18_cohort_z_year_over_year", f"SELECT subject_id, round(delta, 6) AS delta, round(z, 6) AS z, cohort FROM {APPROACH_SQL} WHERE cohort >= 30")
def l18(t):
    return approach(t).select("subject_id", X.r6("delta").alias("delta"), X.r6("z").alias("z"), "cohort")
