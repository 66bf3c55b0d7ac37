"""Registered queries: filters (F), joins (J), set operations (U), readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import joins as J
from ..operators import ordering as O
from ..operators import rates as R
from ..session import shared_dir
from ..sources import tables as S
from ..sources.contracts import CONTRACTS
from .q_rates import METRIC_SQL, rate_sql
from .registry import query
from .roles import FOCAL_TEAMS
from .specs import discover_metrics, load_registry, metric_rows

c = F.col


# ---- readers --------------------------------------------------------------
@query("S1_schema_contract", "SELECT subject_id, year, name, CAST(team AS INTEGER) AS team, n, hr, price_c, war, CAST(NULL AS VARCHAR) AS note FROM @seasons")
def s1(t):
    from pyspark.sql import types as T
    wider = T.StructType([*S.CONTRACT["season_totals"].fields, T.StructField("note", T.StringType())])
    return S.conform(S.conform(t.seasons, S.CONTRACT["season_totals"]), wider)


BROKEN = (("seasons", 1, "note", "added", False), ("seasons", 1, "war", "narrowed", True), ("games", 1, "bb", "missing", True), ("games", 1, "hits", "widened", False),
          ("games", 2, "ab", "narrowed", True), ("games", 2, "bb", "missing", True), ("live", 1, "ts", "narrowed", True), ("live", 2, "ts", "narrowed", True), ("live", 2, "props", "missing", True))


@query("S1b_contract_versions", f"SELECT v.role, version, path, kind, breaking, n FROM (VALUES {', '.join(map(str, BROKEN))}) v(role, version, path, kind, breaking) JOIN (SELECT 'seasons' AS role, count(*) AS n FROM @seasons UNION ALL SELECT 'games', count(*) FROM @games UNION ALL SELECT 'live', count(*) FROM @live) k ON k.role = v.role")
def s1b(t):
    """Written tables against all versions of their contracts: an added, a narrowed, a widened and a missing column."""
    at = f"{shared_dir(t.spark)}/contracts-{uuid.uuid4().hex[:10]}"
    sent = {
        "seasons": t.seasons.withColumn("note", F.lit("n")).withColumn("war", c("war").cast("float")), "games": t.games.drop("bb").withColumn("ab", c("ab").cast("int")),
        "live": t.live.drop("props").withColumn("ts", c("ts").cast("date"))}
    for role, df in sent.items():
        df.write.parquet(f"{at}/{role}")
    back = {role: t.spark.read.parquet(f"{at}/{role}") for role in sent}
    counts = None
    for role, df in back.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(role).alias("role"), "n")
        counts = n if counts is None else counts.unionAll(n)
    return CONTRACTS.violations(t.spark, back).join(F.broadcast(counts), "role")  # one row for each role


@query("S2_resolve_source", "SELECT year, count(*) AS n FROM @seasons GROUP BY 1")
def s2(t):
    fresh = t.seasons.where("year > 2900")
    return S.resolve_source(fresh, t.seasons).groupBy("year").agg(F.count("*").alias("n"))


@query("S3_max_period", "SELECT max(year) AS max_period FROM @stats")
def s3(t):
    return S.max_period(t.stats)


@query("S4_second_namespace", "SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def s4(t):
    hist = S.Namespace(t.spark, t.sf_dir)
    return hist.table("nation").join(hist.table("region"), c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("S10_event_normalise", """SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, event_type, CASE WHEN value > 300 THEN NULL ELSE value END AS value FROM @live WHERE event_type <> 'view'""")
def s10(t):
    spoiled = t.live.withColumn("value", F.when(c("value") > 300, F.lit(float("nan"))).otherwise(c("value")))
    return S.normalise_events(spoiled, c("event_type") != "view", ["value"], {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"})


@query("S13_backfill_plan", """SELECT q.subject_id, newest FROM (SELECT c_custkey AS subject_id FROM customer WHERE c_acctbal > 0) q LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS newest FROM orders GROUP BY 1) ON o_custkey = subject_id
 WHERE newest IS NULL OR newest < DATE '2001-01-01'""")
def s13(t):
    who = t.customer.where("c_acctbal > 0").select(c("c_custkey").alias("subject_id"))
    ev = t.orders.select(c("o_custkey").alias("subject_id"), c("o_orderdate").cast("date").alias("day"))
    return S.backfill_plan(who, ev, "subject_id", "day", F.lit("2001-01-01").cast("date"))


@query("S14_prior_recent_windows", """SELECT CASE WHEN age < 25 THEN 'recent' ELSE 'prior' END AS win, subject_id, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(hits) AS BIGINT) AS hits
 FROM (SELECT *, date_diff('day', game_date, DATE '2001-08-01') AS age FROM @games) WHERE age BETWEEN 0 AND 49 GROUP BY 1, 2""")
def s14(t):
    return S.window_totals(t.games, "subject_id", "game_date", F.lit("2001-08-01").cast("date"), 25, ["ab", "hits"])


@query("S16_roster_by_role", """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'pitcher' ELSE 'batter' END AS work_list, c_custkey AS subject_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0""")
def s16(t):
    roster = t.customer.select(
        c("c_custkey").alias("subject_id"), F.when(c("c_mktsegment") == "BUILDING", "P").otherwise("OF").alias("pos"),
        F.when(c("c_acctbal") < 0, "Injured").when(c("c_mktsegment") == "BUILDING", "Active").when(c("c_mktsegment") == "MACHINERY", None).otherwise("Minors").alias("status"))
    return S.roster_lists(roster, "status", "pos").select("work_list", "subject_id")


# ---- filters and projections ---------------------------------------------
DISC = ("swings", "woba", "est_woba", "ba", "est_ba", "sprint_speed", "exit_velocity", "brl_percent", "hard_hit_percent", "k_percent", "whiff_percent", "chase_percent")


@query("F1_discover_metrics", f"""SELECT 'pctl_' || metric AS metric_id, count(*) AS n, round(max(v), 6) AS top FROM (UNPIVOT (SELECT {', '.join(f'CAST({d} AS DOUBLE) AS {d}' for d in DISC)} FROM @stats) ON * INTO NAME metric VALUE v) GROUP BY 1
 UNION ALL SELECT 'gap_woba', count(*), round(max(est_woba - woba), 6) FROM @stats WHERE pa >= 50""")
def f1(t):
    specs = discover_metrics(t.stats, skip=("subject_id", "team", "year", "pa"))
    return metric_rows(t.stats, specs, ["subject_id", "year"]).groupBy("metric_id").agg(F.count("*").alias("n"), X.r6(F.max("value")).alias("top"))


REGISTRY_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric_id, subject_id, year, CAST({e} AS DOUBLE) AS value, pa AS n, {str(h).lower()} AS higher FROM @stats WHERE pa >= 40"
    for m, e, h in (("exit_velocity", "exit_velocity", True), ("sprint_speed", "sprint_speed", True), ("brl_percent", "brl_percent", True), ("k_percent", "k_percent", False), ("gap_woba", "est_woba - woba", True))) + ")"


def registry_rows(t, year: int | None = None):
    reg = load_registry()
    return metric_rows(t.stats if year is None else t.stats_in(year), reg.metrics, ["subject_id", "year"], populations=reg.populations)


@query("F2_load_registry", f"SELECT metric_id, higher, count(*) AS n FROM {REGISTRY_SQL} GROUP BY 1, 2")
def f2(t):
    return registry_rows(t).groupBy("metric_id", "higher").agg(F.count("*").alias("n"))


@query("F3_fetch_metric_rows", f"SELECT metric_id, subject_id, year, round(value, 6) AS value, n FROM {REGISTRY_SQL}")
def f3(t):
    return registry_rows(t).select("metric_id", "subject_id", "year", X.r6("value").alias("value"), "n")


@query("F4_derived_expr", "SELECT subject_id, year, round(est_woba - woba, 6) AS gap FROM @stats WHERE pa >= 50")
def f4(t):
    return t.stats.where("pa >= 50").select("subject_id", "year", X.r6(F.expr("est_woba - woba")).alias("gap"))


@query("F5_split_predicate", "SELECT 'pitch_class' AS col, CASE WHEN pitch_type = 'FF' THEN 'fastball' WHEN pitch_type = 'SL' THEN 'breaking' ELSE 'offspeed' END AS val, count(*) AS n FROM @pitches WHERE pitch_type <> 'KN' GROUP BY 1, 2 UNION ALL SELECT 'p_throws', CASE hand WHEN 'F' THEN 'L' ELSE 'R' END, count(*) FROM @pitches GROUP BY 1, 2")
def f5(t):
    specs = [R.SplitSpec("pitch_class", v) for v in ("fastball", "breaking", "offspeed")] + [R.SplitSpec("p_throws", v) for v in "LR"]
    one = t.pitches.agg(*[F.expr(f"count_if({s.predicate()}) AS n{i}") for i, s in enumerate(specs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s.column).alias("col"), F.lit(s.value).alias("val"), c(f"n{i}").alias("n")) for i, s in enumerate(specs)])))


@query("F6_split_coherence", " UNION ALL ".join(
    f"SELECT '{m}' AS metric_id, '{s}' AS side, CAST(count(*) FILTER (({d[1]}) AND {w}) AS BIGINT) AS n FROM @pitches"
    for m, d in METRIC_SQL.items() for s, w in (("p_throws", "hand = 'F'"), ("pitch_class", "pitch_type = 'SL'"), ("zone_bucket", "zone BETWEEN 11 AND 14"))
    if not (s == "zone_bucket" and m in ("chase_rate", "zone_contact"))))
def f6(t):
    ok = [(m, a) for m in R.AGG_METRICS for _n, a, _b in R.CONTRAST_PAIRS if m.accepts(a)]
    one = t.pitches.agg(*[F.expr(f"count_if(({m.denominator}) AND ({a.predicate()})) AS n{i}") for i, (m, a) in enumerate(ok)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m.id).alias("metric_id"), F.lit(a.column).alias("side"), c(f"n{i}").alias("n")) for i, (m, a) in enumerate(ok)])))


FOCAL_SQL = "SELECT s_suppkey AS subject_id FROM supplier WHERE s_nationkey < 5"


def focal(t):
    return t.supplier.where(c("s_nationkey") < FOCAL_TEAMS).select(c("s_suppkey").alias("subject_id"))


@query("F7_focal_ids", FOCAL_SQL)
def f7(t):
    roster = t.supplier.where(c("s_nationkey") > 900).select(c("s_suppkey").alias("subject_id"))
    return S.resolve_source(roster, focal(t))


@query("F8_availability_filter", "SELECT subject_id, count(*) AS n FROM @pitches WHERE subject_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 5) GROUP BY 1")
def f8(t):
    free = t.supplier.where(f"s_acctbal > 0 AND s_nationkey < {FOCAL_TEAMS}").select(c("s_suppkey").alias("subject_id"))
    return t.pitches.join(free, "subject_id", "left_semi").groupBy("subject_id").agg(F.count("*").alias("n"))


@query("F9_franchise_members", "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_nationkey = 0")
def f9(t):
    return t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_custkey").alias("subject_id")).union(
        t.customer.where("c_nationkey = 0").select("c_custkey")).distinct()


@query("F10_membership_check", "SELECT DISTINCT subject_id FROM @pitches WHERE price_c > 9000000 AND subject_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def f10(t):
    return t.pitches.where("price_c > 9000000").select("subject_id").distinct().join(focal(t), "subject_id", "left_anti")


@query("F11_calendar_filter", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE month(o_orderdate) = 6 AND day(o_orderdate) = 9")
def f11(t):
    d = c("o_orderdate")
    return t.orders.where((F.month(d) == 6) & (F.day(d) == 9)).select("o_orderkey", d.cast("date").alias("day"))


@query("F12_text_search", "SELECT doc_id, round(n_chars * (1 - least(doc_id % 60 * 0.02e0, 0.8e0)), 6) AS score FROM documents WHERE contains(lower(text), 'license')")
def f12(t):
    d = t.documents.where(F.lower("text").contains("license"))
    return d.select("doc_id", X.r6(c("n_chars") * X.linear_decay(c("doc_id") % 60)).alias("score"))


@query("F13_game_type_filter", "SELECT subject_id, season, count(*) AS n FROM @pitches WHERE hand = 'F' GROUP BY 1, 2")
def f13(t):
    return t.pitches.where("hand = 'F'").groupBy("subject_id", "season").agg(F.count("*").alias("n"))


@query("F14_qualification_floor", "SELECT subject_id, year, pa FROM @stats WHERE pa >= 80")
def f14(t):
    return t.stats.where("pa >= 80").select("subject_id", "year", "pa")


# ---- joins ---------------------------------------------------------------
@query("J1_inner_equi", "SELECT subject_id, year, team, round(exit_velocity, 6) AS v FROM @stats WHERE team < 5")
def j1(t):
    per = t.pitches.groupBy("subject_id", c("season").alias("year")).agg((F.sum("price_c") / F.count("*") / 100000.0).alias("v"))
    member = t.supplier.where(c("s_nationkey") < FOCAL_TEAMS).select(c("s_suppkey").alias("subject_id"), c("s_nationkey").alias("team"))
    return per.join(member, "subject_id").select("subject_id", "year", "team", X.r6("v").alias("v"))


PCT_SQL = """(SELECT metric_id, subject_id, year, value, n, (rank() OVER (PARTITION BY metric_id, year ORDER BY CASE WHEN higher THEN value ELSE -value END) - 1) / count(*) OVER (PARTITION BY metric_id, year) AS pct, count(*) OVER (PARTITION BY metric_id, year) AS pop_n, higher FROM """ + REGISTRY_SQL + ")"


def percentiles(t):
    """Registry metrics per season with the share of the season's population beaten."""
    return O.ecdf(registry_rows(t), ["metric_id", "year"], "value", better="higher")


@query("J2_percentile_x_sample", f"SELECT p.metric_id, p.subject_id, p.year, round(100 * pct, 6) AS percentile, pa, swings FROM {PCT_SQL} p JOIN @stats s USING (subject_id, year)")
def j2(t):
    return percentiles(t).select("metric_id", "subject_id", "year", "pct").join(t.stats.select("subject_id", "year", "pa", "swings"), ["subject_id", "year"]).select(
        "metric_id", "subject_id", "year", X.r6(100 * c("pct")).alias("percentile"), "pa", "swings")


@query("J3_next_period_self_join", "SELECT a.subject_id, a.year, round(b.woba - a.woba, 6) AS move FROM @stats a JOIN @stats b ON b.subject_id = a.subject_id AND b.year = a.year + 1 WHERE a.est_woba - a.woba >= 0.005e0")
def j3(t):
    got = J.next_period(t.stats.select("subject_id", "year", "woba", "est_woba"), "subject_id", "year", {"woba": "next_woba"})
    return got.where("est_woba - woba >= 0.005D").select("subject_id", "year", X.r6(c("next_woba") - c("woba")).alias("move"))


LEGS_SQL = """SELECT DISTINCT o_custkey AS subject_id, CAST(year(o_orderdate) AS INTEGER) AS trade_yr, CASE WHEN o_orderstatus = 'F' THEN 'acquired' ELSE 'surrendered' END AS direction FROM orders WHERE o_orderpriority = '1-URGENT' AND month(o_orderdate) IN (7, 12)"""
WAR_SQL = f"""SELECT subject_id, trade_yr, direction, CAST(coalesce(sum(CASE WHEN direction = 'acquired' AND hr > 0 OR direction = 'surrendered' AND hr = 0 THEN price_c ELSE 0 END), 0) AS BIGINT) AS war_c
 FROM ({LEGS_SQL}) l LEFT JOIN (SELECT subject_id AS sid, year, hr, price_c FROM @seasons) s ON sid = subject_id AND year BETWEEN trade_yr AND trade_yr + 4 GROUP BY 1, 2, 3"""


def trade_output(t):
    legs = t.orders.where((c("o_orderpriority") == "1-URGENT") & F.month("o_orderdate").isin(7, 12)).select(
        c("o_custkey").alias("subject_id"), F.year("o_orderdate").alias("trade_yr"),
        F.when(c("o_orderstatus") == "F", "acquired").otherwise("surrendered").alias("direction")).distinct()
    laid = J.window_sum_by_direction(legs, t.seasons.select("subject_id", "year", "price_c", "hr"), ["subject_id", "trade_yr", "direction"], "subject_id", "trade_yr", "year", "price_c", 5)
    counts = ((c("direction") == "acquired") & (c("hr") > 0)) | ((c("direction") == "surrendered") & (c("hr") == 0))
    return laid.groupBy("subject_id", "trade_yr", "direction").agg(F.coalesce(F.sum(F.when(counts, c("price_c")).otherwise(0)), F.lit(0)).alias("war_c"))


@query("J4_range_join_window", WAR_SQL)
def j4(t):
    return trade_output(t)


PAY_SQL = """SELECT team, year AS season, CAST(sum(bal_c) AS BIGINT) AS payroll_c, CAST(sum(price_c) AS BIGINT) AS output_c FROM @seasons JOIN (SELECT c_custkey, CAST(floor(c_acctbal * 100 + 0.5e0) AS BIGINT) AS bal_c FROM customer) ON c_custkey = subject_id GROUP BY 1, 2"""


def payroll(t):
    pay = t.customer.select(c("c_custkey").alias("subject_id"), F.floor(c("c_acctbal") * 100 + 0.5).alias("bal_c"))
    return t.seasons.join(pay, "subject_id").groupBy("team", c("year").alias("season")).agg(F.sum("bal_c").alias("payroll_c"), F.sum("price_c").alias("output_c"))


@query("J5_left_join_ratio", f"""SELECT n_name, season, payroll_c, round(payroll_c / nullif(output_c, 0), 6) AS per_output FROM nation LEFT JOIN ({PAY_SQL}) ON team = n_nationkey""")
def j5(t):
    return t.nation.join(payroll(t), c("n_nationkey") == c("team"), "left").select(
        "n_name", "season", "payroll_c", X.r6(X.ratio(c("payroll_c"), c("output_c"))).alias("per_output"))


def sides_sql(metric: str, a: str, b: str, floor: int, by: str = "subject_id") -> str:
    return (f"SELECT {by}, x.value AS a_value, y.value AS b_value, x.n AS a_n, y.n AS b_n FROM ({rate_sql(metric, a, floor, by)}) x JOIN ({rate_sql(metric, b, floor, by)}) y USING ({by})")


@query("J6_two_sided_split_join", f"SELECT subject_id, round(a_value, 6) AS a_value, round(b_value, 6) AS b_value, a_n, b_n FROM ({sides_sql('whiff_rate', chr(39).join(['hand = ', 'F', '']), chr(39).join(['hand = ', 'O', '']), 30)})")
def j6(t):
    from ..operators.contrast import two_sides
    _n, a, b = R.CONTRAST_PAIRS[0]
    return two_sides(t.pitches, R.WHIFF_RATE, a, b, ["subject_id"], 30).select(
        "subject_id", X.r6("a_value").alias("a_value"), X.r6("b_value").alias("b_value"), "a_n", "b_n")


COHORT_SQL = """SELECT p.subject_id, r.hits / nullif(r.ab, 0) - p.hits / nullif(p.ab, 0) AS move, p.ab AS prior_ab, r.ab AS recent_ab FROM
 (SELECT subject_id, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(hits) AS BIGINT) AS hits FROM @games WHERE date_diff('day', game_date, DATE '2001-08-01') BETWEEN 800 AND 1599 GROUP BY 1) p
 JOIN (SELECT subject_id, CAST(sum(ab) AS BIGINT) AS ab, CAST(sum(hits) AS BIGINT) AS hits FROM @games WHERE date_diff('day', game_date, DATE '2001-08-01') BETWEEN 0 AND 799 GROUP BY 1) r USING (subject_id)"""


def cohort_moves(t):
    """Prior and recent windows side by side from one conditional aggregate (no self-join)."""
    age = F.datediff(F.lit("2001-08-01").cast("date"), c("game_date"))
    recent, prior = age.between(0, 799), age.between(800, 1599)
    s = lambda k, w: F.sum(F.when(w, c(k)))
    per = t.games.where(age.between(0, 1599)).groupBy("subject_id").agg(
        s("ab", prior).alias("prior_ab"), s("hits", prior).alias("ph"), s("ab", recent).alias("recent_ab"), s("hits", recent).alias("rh"))
    return per.where("prior_ab IS NOT NULL AND recent_ab IS NOT NULL").withColumn(
        "move", X.ratio(c("rh"), c("recent_ab")) - X.ratio(c("ph"), c("prior_ab"))).select("subject_id", "move", "prior_ab", "recent_ab")


@query("J7_prior_recent_join", f"SELECT subject_id, round(move, 6) AS move, prior_ab, recent_ab FROM ({COHORT_SQL})")
def j7(t):
    return cohort_moves(t).withColumn("move", X.r6("move"))


@query("J8_semi_join", "SELECT subject_id, count(*) AS n FROM @pitches WHERE subject_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY 1")
def j8(t):
    return t.pitches.groupBy("subject_id").agg(F.count("*").alias("n")).join(focal(t), "subject_id", "left_semi")


@query("J9_anti_join", "SELECT subject_id, count(*) AS n FROM @pitches WHERE subject_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY 1")
def j9(t):
    return t.pitches.groupBy("subject_id").agg(F.count("*").alias("n")).join(focal(t), "subject_id", "left_anti")


@query("J10_exists_flag", "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has_label FROM documents d")
def j10(t):
    seen = t.labels.select("doc_id").distinct().withColumn("_s", F.lit(1))
    return t.documents.select("doc_id").join(seen, "doc_id", "left").select("doc_id", c("_s").isNotNull().alias("has_label"))


@query("J11_left_join_latest", """SELECT c_custkey AS subject_id, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def j11(t):
    last = J.latest_per_key(t.orders.select(c("o_custkey").alias("subject_id"), "o_orderkey", "o_orderstatus", "o_orderdate"), ["subject_id"], ["o_orderdate", "o_orderkey"])
    return t.customer.select(c("c_custkey").alias("subject_id")).join(last, "subject_id", "left").select("subject_id", "o_orderkey", "o_orderstatus")


ANCHOR_SQL = """SELECT subject_id, year, team, war, (SELECT max(b.war) FROM H b WHERE b.team = a.team AND b.subject_id <> a.subject_id AND b.year < a.year) AS prior_best,
 (SELECT max(b.year) FROM H b WHERE b.team = a.team AND b.subject_id <> a.subject_id AND b.year < a.year AND b.war >= a.war) AS anchor_period FROM H a WHERE year >= 2000"""


@query("J12_asof_anchor", "WITH H AS (SELECT * FROM @seasons) SELECT subject_id, year, team, round(prior_best, 6) AS prior_best, anchor_period, (SELECT min(h.subject_id) FROM H h WHERE h.team = x.team AND h.year = x.anchor_period AND h.subject_id <> x.subject_id AND h.war = (SELECT max(g.war) FROM H g WHERE g.team = x.team AND g.year = x.anchor_period AND g.subject_id <> x.subject_id)) AS anchor_id FROM (" + ANCHOR_SQL + ") x")
def j12(t):
    hist = t.seasons.select("subject_id", "year", "team", "war")
    return J.asof_anchor(hist.where("year >= 2000"), hist, "team", "year", "subject_id", "war").select(
        "subject_id", "year", "team", X.r6("prior_best").alias("prior_best"), "anchor_period", "anchor_id")


REGIME_SQL = "(SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS season, 'gm' || CAST(floor(year(o_orderdate) / 3) AS INTEGER) AS gm FROM orders)"


def regimes(t):
    y = F.year("o_orderdate")
    return t.orders.select(y.alias("season"), F.concat(F.lit("gm"), F.floor(y / 3).cast("string")).alias("gm")).distinct()


@query("J13_regime_join", f"SELECT gm, min(season) AS era_start, max(season) AS era_end, count(*) AS n FROM @seasons JOIN {REGIME_SQL} ON season = year GROUP BY 1")
def j13(t):
    return t.seasons.join(regimes(t), c("season") == c("year")).groupBy("gm").agg(F.min("season").alias("era_start"), F.max("season").alias("era_end"), F.count("*").alias("n"))


@query("J14_name_key_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier#', 'x')) = lower(replace(c_name, 'Customer#', 'X'))")
def j14(t):
    key = lambda col, cut: F.lower(X.display_name(F.regexp_replace(col, cut, "X")))
    a = t.supplier.select("s_suppkey", key("s_name", "Supplier#").alias("k"))
    return a.join(t.customer.select("c_custkey", key("c_name", "Customer#").alias("k")), "k").select("s_suppkey", "c_custkey")


@query("J15_reference_cohort_join", """WITH w AS (SELECT c_nationkey AS team, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) FILTER (o_orderstatus = 'F') / count(*) AS pct FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
 SELECT a.team, a.year, CAST(round_even((a.pct - b.pct) * 1000, 0) AS INTEGER) AS delta, row_number() OVER (ORDER BY round_even((a.pct - b.pct) * 1000, 0), a.team, a.year) AS drop_rank FROM w a JOIN w b ON b.team = a.team AND b.year = a.year - 1""")
def j15(t):
    w = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).groupBy(c("c_nationkey").alias("team"), F.year("o_orderdate").alias("year")).agg(
        (F.count_if(c("o_orderstatus") == "F") / F.count("*")).alias("pct"))
    got = J.next_period(w, "team", "year", {"pct": "now"}).select("team", (c("year") + 1).alias("year"), F.bround((c("now") - c("pct")) * 1000, 0).cast("int").alias("delta"))
    return O.ordinal(got, [], ["delta", "team", "year"], out="drop_rank").drop("pop_n")


@query("J16_batch_latest_subselect", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)")
def j16(t):
    run = t.conversations.agg(F.max("conv_id").alias("conv_id"))
    return t.conversations.select("conv_id", "turn", "role").join(F.broadcast(run), "conv_id", "left_semi")  # one row


# ---- set operations --------------------------------------------------------
CUTS_SQL = f"(SELECT metric_id AS m, year AS y, quantile_cont(CASE WHEN higher THEN value ELSE -value END, 0.6) AS cut FROM {REGISTRY_SQL} WHERE metric_id IN ('exit_velocity', 'sprint_speed') GROUP BY 1, 2)"


@query("U1_intersect_all_cuts", f"""SELECT subject_id, year FROM (SELECT subject_id, year, count(*) FILTER ((CASE WHEN higher THEN value ELSE -value END) >= cut) AS k FROM {REGISTRY_SQL} JOIN {CUTS_SQL} ON m = metric_id AND y = year GROUP BY 1, 2) WHERE k = 2""")
def u1(t):
    from ..operators.scope import passing_counts
    two = registry_rows(t).where(c("metric_id").isin("exit_velocity", "sprint_speed"))
    return passing_counts(two, ["year"], ["subject_id"], 0.6).where("passed = 2").select("subject_id", "year")


@query("U2_union_sources", """SELECT source, positive, count(*) AS n FROM (SELECT 'labels' AS source, quality = 1 AS positive FROM labels UNION ALL SELECT 'toxic', toxic = 0 FROM labels UNION ALL SELECT 'events', event_type = 'purchase' FROM @live
 UNION ALL SELECT 'orders', o_orderstatus = 'F' FROM orders UNION ALL SELECT 'turns', role = 'user' FROM conversations) GROUP BY 1, 2""")
def u2(t):
    def part(name, df, positive):
        return df.select(F.lit(name).alias("source"), positive.alias("positive"))
    parts = (part("labels", t.labels, c("quality") == 1), part("toxic", t.labels, c("toxic") == 0), part("events", t.live, c("event_type") == "purchase"),
             part("orders", t.orders, c("o_orderstatus") == "F"), part("turns", t.conversations, c("role") == "user"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", "positive").agg(F.count("*").alias("n"))


@query("U3_union_members", "SELECT c_nationkey AS team, c_name AS name FROM customer UNION SELECT s_nationkey, s_name FROM supplier")
def u3(t):
    return t.customer.select(c("c_nationkey").alias("team"), c("c_name").alias("name")).union(t.supplier.select("s_nationkey", "s_name")).distinct()


@query("U4_except", "SELECT c_custkey AS subject_id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u4(t):
    done = t.orders.where("o_orderstatus = 'F'").select(c("o_custkey").alias("subject_id"))
    return t.customer.select(c("c_custkey").alias("subject_id")).distinct().join(done, "subject_id", "left_anti")
