"""Registered queries: stated numbers against a second route (C6, C8, C10), fixed cohorts.

Each states a set of findings with faults planted in known rows and derives every number again by
another way; what comes out are the faults, and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import audit as A
from ..operators import cohort as CO
from ..operators import ordering as O
from ..operators import reconcile as RC
from ..operators import selection as SEL
from ..operators.joins import attach_row
from ..operators.rates import league_constant
from ..session import shared_dir
from . import q_windows as QW
from .q_detectors import NOW, with_league
from .q_scalars import PITCHING_SQL, pitching
from .registry import query

c = F.col

# How far two routes to one number may lie apart, by its class.
TOLERANCE = {"rate": 0.002, "points": 2.0, "percentile": 1.0, "runs": 0.02}
RANK_TOLERANCE = {"count": 0.0, "rate": 0.001, "war": 0.1}


def spoil(column, fault, by):
    """A stated number, wrong by ``by`` in the rows where ``fault`` holds."""
    return column + F.when(fault, by).otherwise(0.0)


# ---- windows ------------------------------------------------------------------
def change_stated(t):
    """Findings on a changed rate: the two rates, their difference in points, and the days they cite."""
    split = QW.games_split(t)
    r0, r1 = c("r_prior") / c("n_prior"), c("r_recent") / c("n_recent")
    u = c("user_id")
    numbers = split.select(
        "user_id", X.rnd(r0, 3).alias("prior"), spoil(X.rnd(r1, 3), u % 7 == 0, 0.01).alias("recent"), spoil(F.bround(F.abs(r1 - r0) * 1000, 0), u % 11 == 0, 3.0).alias("points"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("day"))
    days = QW.user_days(t).withColumn("k", F.row_number().over(newest)).where("k <= 20").withColumn("window", F.when(c("k") <= 10, "recent").otherwise("prior"))
    cited = RC.cited_ends(days, ["user_id"], ["day"])
    # Findings whose cited days the source no longer holds.
    stale = F.when((u % 13 == 0) & (c("window") == "prior"), F.date_sub("first_day", 4000)).otherwise(c("first_day"))
    return numbers, cited.withColumn("first_day", stale).join(split.select("user_id"), "user_id", "left_semi")


def by_window(sums, names):
    """One row per user, each sum once for each window."""
    of = lambda w, n: F.max(F.when(c("window") == w, c(n))).alias(f"{n}_{w}")
    return sums.groupBy("user_id").agg(*[of(w, n) for w in ("prior", "recent") for n in names])


def change_again(t, cited):
    got = by_window(RC.sums_between(QW.user_days(t), ["user_id"], ["day"], {"n": "pa", "r": "reached"}, cited), ("n", "r"))
    r0, r1 = c("r_prior") / c("n_prior"), c("r_recent") / c("n_recent")
    return got.select("user_id", X.rnd(r0, 3).alias("prior"), X.rnd(r1, 3).alias("recent"), F.bround(F.abs(r1 - r0) * 1000, 0).alias("points"))


def contact_stated(t):
    half = QW.event_halves(t)
    u = c("user_id")
    numbers = half.select("user_id", X.rnd("mean0", 4).alias("prior"), spoil(X.rnd("mean1", 4), u % 5 == 0, 10.0).alias("recent"), X.rnd(F.abs(c("mean1") - c("mean0")), 4).alias("points"))
    newest, whole = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")), Window.partitionBy("user_id")
    tail = QW.event_cents(t).withColumn("k", F.row_number().over(newest)).where("k <= 40").withColumn("len", F.max("k").over(whole))
    tail = tail.withColumn("window", F.when(c("k") > c("len") - F.floor(c("len") / 2), "prior").otherwise("recent"))
    return numbers, RC.cited_ends(tail, ["user_id"], ["ts", "event_id"]).join(half.select("user_id"), "user_id", "left_semi")


def contact_again(t, cited):
    got = by_window(RC.sums_between(QW.event_cents(t).select("user_id", "ts", "event_id", "v"), ["user_id"], ["ts", "event_id"], {"n": "1L", "s": "v"}, cited), ("n", "s"))
    m0, m1 = c("s_prior") / c("n_prior"), c("s_recent") / c("n_recent")
    return got.select("user_id", X.rnd(m0, 4).alias("prior"), X.rnd(m1, 4).alias("recent"), X.rnd(F.abs(m1 - m0), 4).alias("points"))


WINDOWS_SQL = f"""WITH s AS (SELECT user_id, round(r_prior / n_prior, 3) AS p, round(r_recent / n_recent, 3) AS r, round_even(abs(r_recent / n_recent - r_prior / n_prior) * 1000, 0) AS d FROM ({QW.W9_SQL})),
 h AS (SELECT user_id, round(mean0, 4) AS p, round(mean1, 4) AS r FROM ({QW.W10_SQL}))
 SELECT 'change' AS kind, user_id, 'prior' AS number, p AS stated, CAST(NULL AS DOUBLE) AS again FROM s WHERE user_id % 13 = 0
 UNION ALL SELECT 'change', user_id, 'recent', r + 0.01e0, r FROM s WHERE user_id % 7 = 0
 UNION ALL SELECT 'change', user_id, 'points', d + CASE WHEN user_id % 11 = 0 THEN 3e0 ELSE 0e0 END, CASE WHEN user_id % 13 = 0 THEN NULL ELSE d END FROM s WHERE user_id % 11 = 0 OR user_id % 13 = 0
 UNION ALL SELECT 'contact', user_id, 'recent', r + 10e0, r FROM h WHERE user_id % 5 = 0"""


@query("C10b_reconcile_windows", WINDOWS_SQL)
def c10b(t):
    stated, cited = change_stated(t)
    change = A.reconcile(stated, change_again(t, cited), ["user_id"], {"prior": TOLERANCE["rate"], "recent": TOLERANCE["rate"], "points": TOLERANCE["points"]})
    stated, cited = contact_stated(t)
    contact = A.reconcile(stated, contact_again(t, cited), ["user_id"], {n: TOLERANCE["rate"] for n in ("prior", "recent", "points")})
    return change.select(F.lit("change").alias("kind"), "*").unionByName(contact.select(F.lit("contact").alias("kind"), "*"))


# ---- the fixed cohort -------------------------------------------------------------
PLAYOFF = 8  # places of a year that count as a team that was handed over strong
LEVEL_SQL = "(SELECT *, row_number() OVER (PARTITION BY year ORDER BY -pct, team) AS place FROM (SELECT c_nationkey AS team, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') / count(*) AS pct FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2))"
HANDED_SQL = f"(SELECT a.team, a.year, a.pct, b.pct AS inherited, b.place, CAST(round_even((a.pct - b.pct) * 1000, 0) AS INTEGER) AS delta FROM {LEVEL_SQL} a JOIN {LEVEL_SQL} b ON b.team = a.team AND b.year = a.year - 1)"
REFERENCE_SQL = f"(SELECT * FROM {HANDED_SQL} WHERE year < {NOW} AND place <= {PLAYOFF})"


def team_years(t):
    """A team's share of good results by year, and the day its inherited level is looked up at."""
    w = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy(c("c_nationkey").alias("team"), F.year("o_orderdate").alias("year")).agg(
        (F.count_if(c("o_orderstatus") == "F") / F.count("*")).alias("pct"))
    return w.withColumn("day", F.make_date(c("year"), F.lit(7), F.lit(1)))


def inherited(t):
    """The dated reference dimension: each team's level and place, valid through the year after."""
    places = O.ordinal(team_years(t).withColumn("neg", -c("pct")), ["year"], ["neg", "team"], out="place", few_parts=False)
    return CO.dated_levels(places, "team", "year", "pct", ["place"])


def reference(t):
    """The cohort: all teams handed over strong, in years before the judged one."""
    got = CO.reference_cohort(team_years(t), inherited(t), "team", "day", c("year") >= NOW, c("place") <= PLAYOFF, ["inherited", "place"])
    return CO.moved(got, "pct", "inherited").select("team", "year", "pct", "inherited", "place", "delta")


def judged(t):
    own = CO.as_of(team_years(t).where(c("year") == NOW), inherited(t), "team", "day", ["inherited", "place"])
    return CO.moved(own, "pct", "inherited").select("team", "year", "pct", "inherited", "place", "delta")


@query("J15b_fixed_cohort", f"SELECT team, year, round(inherited, 6) AS inherited, round(pct, 6) AS pct, delta, row_number() OVER (ORDER BY delta, team, year) AS drop_rank FROM {REFERENCE_SQL}")
def j15b(t):
    ranked = O.ordinal(reference(t), [], ["delta", "team", "year"], out="drop_rank")
    return ranked.select("team", "year", X.r6("inherited").alias("inherited"), X.r6("pct").alias("pct"), "delta", "drop_rank")


@query("G3b_manager_cohort", f"""SELECT team, delta, f AS fell_further, k AS level_with, n AS cohort_n, CASE WHEN f = 0 THEN 'none' WHEN f = 1 THEN 'one' ELSE 'several' END AS precedents FROM (
 SELECT team, delta, (SELECT count(*) FROM {REFERENCE_SQL} x WHERE x.delta < o.delta) AS f, (SELECT count(*) FROM {REFERENCE_SQL} x WHERE x.delta = o.delta) AS k, (SELECT count(*) FROM {REFERENCE_SQL}) AS n FROM {HANDED_SQL} o WHERE year = {NOW})""")
def g3b(t):
    got = CO.among(reference(t), judged(t), "delta")
    f = c("fell_further")
    precedents = F.when(f == 0, "none").when(f == 1, "one").otherwise("several")
    return got.select("team", "delta", "fell_further", "level_with", "cohort_n", precedents.alias("precedents"))


SPOT_SQL = "(team * 31 + year) % 17"


@query("C10c_reconcile_cohort", f"SELECT year, team, CASE {SPOT_SQL} WHEN 0 THEN 'dropped' WHEN 1 THEN 'doubled' ELSE 'changed' END AS kind, 1 AS cited, CASE {SPOT_SQL} WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS drawn FROM {REFERENCE_SQL} WHERE {SPOT_SQL} < 3")
def c10c(t):
    """The rows a finding drew against the digest of the rows it cites, stored with it and read back."""
    cited = reference(t).select("year", "team", "delta", "place")
    at = f"{shared_dir(t.spark)}/cited-{uuid.uuid4().hex[:10]}"
    RC.digest(cited, ["year"], ["team", "delta", "place"]).write.parquet(at)
    spot = (c("team") * 31 + c("year")) % 17
    drawn = cited.where(spot != 0).withColumn("delta", F.when(spot == 2, c("delta") + 1).otherwise(c("delta")))
    drawn = drawn.unionByName(cited.where(spot == 1))
    off = RC.drifted(t.spark.read.parquet(at), drawn, ["year"], ["team", "delta", "place"]).select("year")
    keep = lambda df: df.join(off, "year", "left_semi")
    return RC.drift_rows(keep(cited), keep(drawn), ["year"], ["team", "delta", "place"], ["team"])


# ---- player and pitcher -----------------------------------------------------------
PLAYER_SQL = f"""WITH s AS (SELECT *, (SELECT sum(est_woba * pa) / sum(pa) FROM @stats WHERE year = {NOW}) AS league FROM @stats WHERE year = {NOW} AND pa >= 50), m AS (
 SELECT subject_id, round(woba, 3) AS woba, round((pa * est_woba + 220 * league) / (pa + 220), 3) AS talent FROM s), b AS (
 SELECT subject_id, rank() OVER (ORDER BY brl_percent) - 1 AS k, count(*) OVER () AS n FROM s), h AS (
 SELECT subject_id, rank() OVER (ORDER BY -chase_percent) - 1 AS k, count(*) OVER () AS n FROM s WHERE chase_percent IS NOT NULL)
 SELECT subject_id, 'woba' AS number, woba + 0.01e0 AS stated, woba AS again FROM m WHERE subject_id % 6 = 0
 UNION ALL SELECT subject_id, 'talent', talent + 0.01e0, talent FROM m WHERE subject_id % 6 = 1
 UNION ALL SELECT subject_id, 'chase', round(100 * k / n, 0) + 9e0, least(99, floor(100 * k / n)) FROM h WHERE subject_id % 6 = 2
 UNION ALL SELECT subject_id, 'barrel', round(100 * k / n, 0) + 9e0, least(99, floor(100 * k / n)) FROM b WHERE subject_id % 6 = 3"""


def player_stated(t):
    """Card numbers of each player: rates, the pulled rate and two percentiles by rank."""
    s = with_league(t).where("pa >= 50")
    u = c("subject_id")
    rates = s.select("subject_id", spoil(X.rnd("woba", 3), u % 6 == 0, 0.01).alias("woba"), spoil(X.rnd(X.regress(c("est_woba"), c("pa"), c("league")), 3), u % 6 == 1, 0.01).alias("talent"))
    chase = O.ecdf(s.where("chase_percent IS NOT NULL").select("subject_id", "chase_percent"), [], "chase_percent", better="false")
    barrel = O.ecdf(s.select("subject_id", "brl_percent"), [], "brl_percent")
    place = lambda df, name, k: df.select("subject_id", spoil(X.rnd(100 * c("pct"), 0), u % 6 == k, 9.0).alias(name))
    return rates.join(place(chase, "chase", 2), "subject_id", "left").join(place(barrel, "barrel", 3), "subject_id")


def player_again(t):
    """The same from single pitches: means of pitch values, the pull as 220 added pitches at the league's
    mean, and percentiles read off a table of 99 cuts found by selection."""
    p = t.pitches_in(NOW)
    league = p.agg(F.avg(c("tax_c") * 0.08).alias("center"))
    per = p.groupBy("subject_id").agg(F.count("*").alias("n"), F.avg(c("disc_c") * 0.064).alias("woba"), F.avg(c("tax_c") * 0.08).alias("x"))
    rates = attach_row(per.where("n >= 50"), league)
    pulled = RC.pulled_by_rows(rates, ["subject_id"], c("x"), c("n"), c("center"), 220)
    out_zone = F.count_if(c("zone") > 9)
    tails = p.groupBy("subject_id").agg(
        F.count("*").alias("n"), (F.count_if(c("price_c") > 8000000) * 100.0 / F.count("*")).alias("barrel"),
        (-100.0 * F.count_if((c("zone") > 9) & (c("description") != "ball")) / F.nullif(out_zone, F.lit(0))).alias("chase")).where("n >= 50")

    def percentile(name):
        cuts = SEL.quantile_table(tails, [], name)
        return attach_row(tails.where(c(name).isNotNull()).select("subject_id", name), cuts).select("subject_id", SEL.percentile_from("cuts", name).cast("double").alias(name))

    return rates.select("subject_id", X.rnd("woba", 3).alias("woba")).join(pulled.select("subject_id", X.rnd("pulled", 3).alias("talent")), "subject_id").join(
        percentile("chase"), "subject_id", "left").join(percentile("barrel"), "subject_id", "left")


@query("C8b_reconcile_player", PLAYER_SQL)
def c8b(t):
    return A.reconcile(player_stated(t), player_again(t), ["subject_id"], {
        "woba": TOLERANCE["rate"], "talent": TOLERANCE["rate"], "chase": TOLERANCE["percentile"], "barrel": TOLERANCE["percentile"]})


PITCHER_SQL = f"""WITH p AS ({PITCHING_SQL}), l AS (SELECT CAST(sum(er) AS BIGINT) * 9e0 / (CAST(sum(outs) AS BIGINT) / 3e0) - (13 * CAST(sum(hr) AS BIGINT) + 3 * CAST(sum(bb) + sum(hbp) AS BIGINT) - 2 * CAST(sum(k) AS BIGINT)) / (CAST(sum(outs) AS BIGINT) / 3e0) AS const FROM p),
 m AS (SELECT subject_id, round(er * 9e0 / (outs / 3e0), 2) AS era, round((13 * hr + 3 * (bb + hbp) - 2 * k) / (outs / 3e0) + const, 2) AS fip FROM p, l WHERE outs >= 90)
 SELECT subject_id, 'fip' AS number, fip + 0.05e0 AS stated, fip AS again FROM m WHERE subject_id % 5 = 0 UNION ALL SELECT subject_id, 'era', era + 0.05e0, era FROM m WHERE subject_id % 7 = 0"""


def pitcher_stated(t):
    p = pitching(t)
    s = attach_row(p, league_constant(p).select("constant")).where("outs >= 90")
    ip, u = c("outs") / 3.0, c("subject_id")
    return s.select("subject_id", spoil(X.rnd(c("er") * 9.0 / ip, 2), u % 7 == 0, 0.05).alias("era"), spoil(X.rnd(X.fip(c("hr"), c("bb"), c("hbp"), c("k"), ip, c("constant")), 2), u % 5 == 0, 0.05).alias("fip"))


def pitcher_again(t):
    """From single events: a weight table in place of the formula, innings as written text, and the
    league's constant from its own totals."""
    z, d = c("zone"), c("description")
    kinds = F.array_compact(F.array(F.when(z == 5, "hr"), F.when(z == 11, "bb"), F.when(z == 14, "hbp"), F.when(d == "swinging_strike", "k")))
    weights = t.spark.sql("SELECT * FROM VALUES ('hr', 13), ('bb', 3), ('hbp', 3), ('k', -2) AS w(kind, weight)")
    events = t.pitches.select("subject_id", F.explode(kinds).alias("kind"))
    own = RC.weighted_events(events, ["subject_id"], weights, "kind")
    written = t.pitches.groupBy("subject_id").agg(F.expr("concat(count(1) div 3, '.', count(1) % 3) AS innings"), F.sum(z.between(4, 6).cast("int")).alias("er"))
    league = attach_row(t.pitches.agg(F.count("*").alias("all_outs"), F.sum(z.between(4, 6).cast("int")).alias("all_er")), RC.weighted_events(events, [], weights, "kind"))
    league = league.select(((27 * c("all_er") - 3 * c("weighted")) / c("all_outs")).alias("above"))
    got = attach_row(written.join(own, "subject_id", "left").withColumn("outs", X.innings_to_outs(c("innings"))), league)
    return got.select("subject_id", X.rnd(27 * c("er") / c("outs"), 2).alias("era"), X.rnd(3 * F.coalesce("weighted", F.lit(0)) / c("outs") + c("above"), 2).alias("fip"))


@query("C8c_reconcile_pitcher", PITCHER_SQL)
def c8c(t):
    return A.reconcile(pitcher_stated(t), pitcher_again(t), ["subject_id"], {"era": TOLERANCE["runs"], "fip": TOLERANCE["runs"]})


# ---- values at stated ranks ---------------------------------------------------------
LEADER_SQL = "(SELECT year, subject_id, unnest([{'stat': 'hr', 'class': 'count', 'v': hr / 1e0}, {'stat': 'n', 'class': 'count', 'v': n / 1e0}, {'stat': 'war', 'class': 'war', 'v': war}, {'stat': 'average', 'class': 'rate', 'v': hr / n}], recursive := true) FROM @seasons)"
RANKED_SQL = f"(SELECT *, row_number() OVER (PARTITION BY year, stat ORDER BY v DESC, subject_id) AS place FROM {LEADER_SQL})"
STATED_SQL = f"""(SELECT year, stat, class, place + CASE (place + year) % 9 WHEN 1 THEN 37 WHEN 2 THEN 10000000 ELSE 0 END AS rank, v + CASE WHEN (place + year) % 9 > 0 THEN 0e0 WHEN class = 'count' THEN 1e0 WHEN class = 'rate' THEN 0.01e0 ELSE 0.05e0 END AS value FROM {RANKED_SQL} WHERE place <= 30)"""


def leaders(t):
    cell = lambda stat, kind, v: F.struct(F.lit(stat).alias("stat"), F.lit(kind).alias("class"), v.cast("double").alias("v"))
    return t.seasons.select("year", "subject_id", F.inline(F.array(
        cell("hr", "count", c("hr")), cell("n", "count", c("n")), cell("war", "war", c("war")), cell("average", "rate", c("hr") / c("n")))))


@query("C6b_cross_check_ranks", f"""SELECT s.year, s.stat, rank, round(value, 6) AS value, round(r.v, 6) AS at_rank, CASE WHEN r.v IS NULL THEN 'missing' WHEN abs(value - r.v) > CASE s.class WHEN 'count' THEN 0e0 WHEN 'rate' THEN 0.001e0 ELSE 0.1e0 END + 1e-9 THEN 'mismatch' ELSE 'ok' END AS verdict
 FROM {STATED_SQL} s LEFT JOIN {RANKED_SQL} r ON r.year = s.year AND r.stat = s.stat AND r.place = s.rank""")
def c6b(t):
    """Stated leaders, some with a wrong value, a wrong rank or a rank that is not there."""
    rows = leaders(t)
    spot = (c("place") + c("year")) % 9
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("year", "stat").orderBy(F.desc("v"), "subject_id"))).where("place <= 30")
    stated = top.select(
        "year", "stat", "class", (c("place").cast("bigint") + F.when(spot == 1, 37).when(spot == 2, 10_000_000).otherwise(0)).alias("rank"),
        spoil(c("v"), spot == 0, F.when(c("class") == "count", 1.0).when(c("class") == "rate", 0.01).otherwise(0.05)).alias("value"))
    found = SEL.values_at_ranks(rows, ["year", "stat"], "v", stated.select("year", "stat", "rank").distinct(), descending=True)
    got = RC.at_stated_rank(stated, found, ["year", "stat"], "rank", "value", RANK_TOLERANCE, "class")
    return got.select("year", "stat", "rank", X.r6("value").alias("value"), X.r6("at_rank").alias("at_rank"), "verdict")
