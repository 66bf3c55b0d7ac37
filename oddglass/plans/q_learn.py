"""Registered queries: learning (E), predictions (Q), board (B), hypotheses (H)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import board as B
from ..operators import hypothesis as H
from ..operators import learn as E
from ..operators import predict as Q
from ..operators.joins import attach_row
from ..session import shared_dir
from ..sources import writes as S
from .q_scan import SCORE_SQL, scored
from .registry import query

c = F.col
BAND_SQL = "CASE WHEN s >= 0.7e0 THEN 'strong' WHEN s >= 0.5e0 THEN 'ok' WHEN s >= 0.35e0 THEN 'thin' ELSE 'boring' END"


def featured(t):
    s = scored(t).withColumn("s", X.r6("score"))
    keys = E.feature_keys(c("detector"), c("s"), F.lit("exit_velocity"), F.lit("rank"), c("subject_id") % 10 == 0, c("members"))
    return s.withColumn("features", keys)


@query("E1_feature_keys", f"""SELECT feature, count(*) AS n FROM (SELECT unnest(list_filter([ 'detector:' || detector, 'lens:rank', 'metric_family:contact_quality', 'interest_band:' || {BAND_SQL}, CASE WHEN subject_id % 10 = 0 THEN 'star_tier:star' ELSE 'star_tier:regular' END, CASE WHEN members > 1 THEN 'shape:conjunction' END], lambda x: x IS NOT NULL)) AS feature FROM (SELECT *, round(score, 6) AS s FROM {SCORE_SQL})) GROUP BY 1""")
def e1(t):
    return featured(t).select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


OBS_SQL = "(SELECT event_id, event_type, user_id, value > 50 AS positive, pow(0.5e0, greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-03-01'), 0) / 90e0) AS w FROM @live)"
STATS_SQL = f"""(SELECT feature, n_pos, n_total, CASE WHEN n_total < 5 THEN 1e0 ELSE least(1.25e0, greatest(0.8e0, (n_pos + 2) / (n_total + 4) / g)) END AS multiplier FROM (SELECT feature, sum(CASE WHEN positive THEN w ELSE 0 END) AS n_pos, sum(w) AS n_total FROM (SELECT 'detector:' || event_type AS feature, positive, w FROM {OBS_SQL} UNION ALL SELECT 'user:' || user_id, positive, w FROM {OBS_SQL}) GROUP BY 1),
 (SELECT (sum(CASE WHEN positive THEN w ELSE 0 END) + 2) / (sum(w) + 4) AS g FROM {OBS_SQL}))"""
AS_OF = "2024-03-01"


def observations(t):
    return t.live.select(
        "event_id", F.array(F.concat(F.lit("detector:"), "event_type"), F.concat(F.lit("user:"), c("user_id").cast("string"))).alias("features"),
        (c("value") > 50).alias("positive"), c("ts").cast("date").alias("observed_at"))


def stats(t):
    return E.feature_stats(observations(t), F.lit(AS_OF).cast("date"))


@query("E2_editorial_prior", f"SELECT feature, round(n_pos, 4) AS n_pos, round(n_total, 4) AS n_total, round(multiplier, 6) AS multiplier FROM {STATS_SQL}")
def e2(t):
    return stats(t).select("feature", X.rnd("n_pos", 4).alias("n_pos"), X.rnd("n_total", 4).alias("n_total"), X.r6("multiplier").alias("multiplier"))


@query("E2b_combined_prior", f"""WITH s AS MATERIALIZED (SELECT * FROM {STATS_SQL}) SELECT event_id, round(CASE WHEN m IS NULL THEN 1e0 ELSE least(1.4e0, greatest(0.7e0, exp(m))) END, 6) AS prior FROM (SELECT event_id, avg(ln(multiplier)) FILTER (multiplier <> 1) AS m FROM (SELECT event_id, 'detector:' || event_type AS feature FROM @live UNION ALL SELECT event_id, 'user:' || user_id FROM @live) LEFT JOIN s USING (feature) GROUP BY 1)""")
def e2b(t):
    return E.combined_prior(observations(t), "event_id", stats(t)).withColumn("prior", X.r6("prior"))


@query("E3_engagement_prior", """WITH p AS (SELECT event_type AS angle, value * pow(0.5e0, date_diff('day', CAST(ts AS DATE), DATE '2024-03-01') / 45e0) AS s FROM @live QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
 SELECT angle, posts, round(CASE WHEN posts < 3 THEN 1e0 ELSE least(1.4e0, greatest(0.7e0, m / (SELECT avg(s) FROM p))) END, 6) AS prior FROM (SELECT angle, count(*) AS posts, avg(s) AS m FROM p GROUP BY 1)""")
def e3(t):
    m = t.live.select("user_id", c("event_type").alias("angle"), "ts", "event_id", "value")
    return E.engagement_prior(m, ["user_id", "angle"], ["ts", "event_id"], "angle", "value", F.lit(AS_OF).cast("date")).withColumn("prior", X.r6("prior"))


@query("E4_detector_reliability", "SELECT o_orderpriority AS detector, round(least(1.15e0, greatest(0.85e0, 1 + ((ok + 3) / (g + 6) - 0.5e0) * 0.3e0)), 6) AS reliability FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'P') AS g FROM orders GROUP BY 1)")
def e4(t):
    s = t.orders.groupBy(c("o_orderpriority").alias("detector")).agg(F.count_if(c("o_orderstatus") == "F").alias("ok"), F.count_if(c("o_orderstatus") != "P").alias("g"))
    return s.select("detector", X.r6(E.detector_reliability(c("ok"), c("g"))).alias("reliability"))


@query("E5_learn_snapshot", f"SELECT feature, 'run-2' AS run_id, round(multiplier, 6) AS multiplier FROM {STATS_SQL}")
def e5(t):
    """Two snapshots written, the newest read back."""
    ts = lambda s: F.lit(s).cast("timestamp")
    at = f"{shared_dir(t.spark)}/learned-{uuid.uuid4().hex[:10]}"
    S.append_run(E.snapshot(E.feature_stats(observations(t), F.lit("2024-02-01").cast("date")), "run-1", ts("2024-02-01")), at, "1")
    S.append_run(E.snapshot(stats(t), "run-2", ts("2024-03-01")), at, "2")
    return E.newest_run(S.read_ledger(t.spark, at)).select("feature", "run_id", X.r6("multiplier").alias("multiplier"))


# ---- predictions -----------------------------------------------------------
PRED_SQL = "(SELECT subject_id, team, woba AS baseline, est_woba AS target FROM @stats WHERE year = 2000)"


def findings(t):
    return t.stats_in(2000).select("subject_id", "team", c("woba").alias("baseline"), c("est_woba").alias("target"))


@query("Q1_log_predictions", f"SELECT subject_id, team, round(baseline, 6) AS baseline, round(target, 6) AS target, DATE '2001-01-31' AS resolves_by, 'open' AS outcome FROM {PRED_SQL} WHERE subject_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def q1(t):
    have = t.supplier.where("s_acctbal < 0").select(c("s_suppkey").alias("subject_id"))
    rows = findings(t).withColumns({"baseline": X.r6("baseline"), "target": X.r6("target")})
    return Q.log_predictions(have, rows, F.lit("2001-01-01").cast("date"), ["subject_id"])


GRADED_SQL = f"""(SELECT p.subject_id, p.team, CASE WHEN p.subject_id % 7 = 0 THEN 'open' WHEN now IS NULL THEN 'ungradeable' WHEN abs(round_even((now - baseline) * 1000000, 0)) < 5000 THEN 'push' WHEN (target < baseline AND now < baseline) OR (target > baseline AND now > baseline) THEN 'correct' ELSE 'incorrect' END AS outcome, CASE WHEN p.subject_id % 7 > 0 THEN now END AS resolved_value
 FROM {PRED_SQL} p LEFT JOIN (SELECT subject_id, woba AS now FROM @stats WHERE year = 2001) n ON n.subject_id = p.subject_id)"""


def graded(t):
    # Due dates differ: every seventh prediction is not due yet.
    due = F.when(c("subject_id") % 7 == 0, "2002-06-01").otherwise("2001-01-31").cast("date")
    rows = findings(t).withColumn("resolves_by", due).withColumn("outcome", F.lit("open"))
    micro = lambda k: F.bround(c(k) * 1000000, 0)
    rows = rows.withColumns({"baseline": micro("baseline"), "target": micro("target")})
    now = t.stats_in(2001).select("subject_id", micro("woba").alias("value"))
    return Q.grade(rows, now, ["subject_id"], F.lit("2001-12-31").cast("date"), Q.EPSILON["woba"] * 1000000)


@query("Q2_grade_predictions", f"SELECT subject_id, outcome, round_even(resolved_value * 1000000, 0) AS resolved_u FROM {GRADED_SQL}")
def q2(t):
    return graded(t).select("subject_id", "outcome", c("resolved_value").alias("resolved_u"))


@query("Q3_scorecard", f"SELECT team, correct, incorrect, push, round(correct / nullif(correct + incorrect, 0), 6) AS accuracy FROM (SELECT team, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'incorrect') AS incorrect, count(*) FILTER (outcome = 'push') AS push FROM {GRADED_SQL} GROUP BY 1)")
def q3(t):
    return Q.scorecard(graded(t), ["team"]).withColumn("accuracy", X.r6("accuracy"))


# ---- board -------------------------------------------------------------------
@query("B1_board_cards_leads", """SELECT user_id, event_id, 'dismissed' AS state FROM (SELECT user_id, min(event_id) AS event_id FROM @live WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) WHERE user_id IN (SELECT user_id FROM @live WHERE event_type = 'error' AND value > 200)
 UNION ALL SELECT user_id, event_id, 'open' FROM (SELECT user_id, max(event_id) AS event_id FROM @live GROUP BY 1) WHERE user_id NOT IN (SELECT user_id FROM @live WHERE event_type = 'error' AND value > 200)""")
def b1(t):
    old = t.live.where(c("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    new = t.live.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    gone = t.live.where("event_type = 'error' AND value > 200").select("user_id")
    return B.refresh_leads(old, gone, new, "user_id")


@query("B1b_board_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM @live GROUP BY 1")
def b1b(t):
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    rows = t.live.select("user_id", "ts", "event_id")
    old = rows.where(c("ts") < half).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    return S.upsert_latest(old, rows.where(c("ts") >= half).select("user_id", "event_id", "ts"), ["user_id"], "ts")


@query("B2_candidate_leads", "SELECT user_id, event_id, value FROM @live WHERE CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) - 2 FROM @live) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def b2(t):
    rows = t.live.select("user_id", "event_id", "value", c("ts").cast("date").alias("day"))
    rows = attach_row(rows, t.live.agg(F.max("ts").cast("date").alias("as_of")))
    return B.candidate_leads(rows, "user_id", "day", "value", "event_id", c("as_of")).select("user_id", "event_id", "value")


@query("B3_readable_subject", """SELECT key, coalesce(s_name, c_name, p_name, key) AS readable FROM (SELECT 'player:' || o_orderkey || ':luck' AS key, o_orderkey AS id FROM orders) LEFT JOIN (SELECT s_suppkey, s_name FROM supplier) ON s_suppkey = id LEFT JOIN (SELECT c_custkey, c_name FROM customer) ON c_custkey = id LEFT JOIN (SELECT p_partkey, p_name FROM part) ON p_partkey = id""")
def b3(t):
    keys = t.orders.select(F.concat(F.lit("player:"), c("o_orderkey").cast("string"), F.lit(":luck")).alias("key"))
    return B.readable_subject(keys, "key", [(t.supplier, "s_suppkey", "s_name"), (t.customer, "c_custkey", "c_name"), (t.part, "p_partkey", "p_name")])


@query("B5_state_transitions", """SELECT src, dst, (src, dst) IN (('pending', 'verified'), ('verified', 'approved'), ('approved', 'posted'), ('pending', 'rejected'), ('verified', 'rejected'), ('approved', 'rejected')) AS legal, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'verified' ELSE 'approved' END AS src, CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'approved' WHEN '3-MEDIUM' THEN 'posted' ELSE 'rejected' END AS dst FROM orders) GROUP BY 1, 2, 3""")
def b5(t):
    s, p = c("o_orderstatus"), c("o_orderpriority")
    moves = t.orders.select(
        F.when(s == "O", "pending").when(s == "P", "verified").otherwise("approved").alias("src"),
        F.when(p == "1-URGENT", "verified").when(p == "2-HIGH", "approved").when(p == "3-MEDIUM", "posted").otherwise("rejected").alias("dst"))
    return B.apply_transitions(moves, "src", "dst").groupBy("src", "dst", "legal").agg(F.count("*").alias("n"))


# ---- hypotheses ----------------------------------------------------------------
PROPOSED = [
    H.Hypothesis("value", window_days=14, rationale="spending lately"),
    H.Hypothesis("value", window_days=14, rationale="the same spec, said otherwise"),
    H.Hypothesis("value", how="sum", window_days=None),
    H.Hypothesis("value", higher_is_better=False, window_days=7, stabilization_n=15),
    H.Hypothesis("nothing", window_days=7),
    H.Hypothesis("value", window_days=400),
    H.Hypothesis("event_type"),
    H.Hypothesis("value", window_days=21, lens="rank"),
]


def event_rows(t):
    return t.live.select("user_id", "value", "event_type", c("ts").cast("date").alias("day"))


@query("H1_enqueue_dedup", """SELECT event_type, count(*) AS queued FROM (SELECT DISTINCT event_type, user_id FROM @live) n ANTI JOIN (SELECT DISTINCT event_type, user_id FROM @live WHERE ts < TIMESTAMP '2024-01-10') p USING (event_type, user_id) GROUP BY 1""")
def h1(t):
    """Proposals (one per event) reduced to structures not pending; the pending ones are read from the written queue."""
    specs = t.live.select(X.stable_id([c("event_type"), c("user_id")], 12).alias("spec_id"), "event_type", "event_id", "ts")
    at = f"{shared_dir(t.spark)}/queue-{uuid.uuid4().hex[:10]}"
    specs.where("ts < TIMESTAMP '2024-01-10'").select("spec_id").distinct().write.parquet(at)
    queued = S.insert_if_absent(t.spark.read.parquet(at), specs.select("spec_id", "event_type", "event_id"), ["spec_id"])
    return queued.groupBy("event_type").agg(F.count("*").alias("queued"))


def as_of(t):
    return F.lit("2024-01-30").cast("date")


def spec_sql(h: H.Hypothesis) -> str:
    """Ledger row of one runnable spec, as SQL."""
    use = "true" if h.window_days is None else f"d >= DATE '2024-01-30' - {h.window_days} AND d <= DATE '2024-01-30'"
    agg = "avg" if h.how == "avg" else "sum"
    sign = "" if h.higher_is_better else "-"
    ranked = f"""SELECT subject_id, n, 0.5e0 + ((rank() OVER (ORDER BY {sign}value) - 1) / count(*) OVER () - 0.5e0) * least(1, n / {h.stabilization_n}) AS rarity, count(*) OVER () AS pop FROM (SELECT user_id AS subject_id, {agg}(value) AS value, count(*) AS n FROM (SELECT user_id, value, CAST(ts AS DATE) AS d FROM @live) WHERE {use} GROUP BY 1 HAVING count(*) >= 8)"""
    if h.lens == "rank":
        ranked = f"SELECT subject_id, n, 1 - (k - 1) / least(15, greatest(1, floor(pop / 4))) AS rarity, pop FROM (SELECT *, row_number() OVER (ORDER BY {sign or '-'}value, subject_id) AS k, count(*) OVER () AS pop FROM (SELECT user_id AS subject_id, {agg}(value) AS value, count(*) AS n FROM (SELECT user_id, value, CAST(ts AS DATE) AS d FROM @live) WHERE {use} GROUP BY 1 HAVING count(*) >= 8))"
    best = f"SELECT subject_id, round(rarity, 6) AS rarity FROM ({ranked}) ORDER BY rarity DESC, subject_id LIMIT 1" if h.lens == "rank" else f"SELECT subject_id, round(rarity, 6) AS rarity FROM ({ranked}) WHERE pop >= 10 AND n >= greatest(10, {h.stabilization_n // 5}) AND rarity >= 0.8e0 ORDER BY rarity DESC, subject_id LIMIT 1"
    return f"SELECT '{h.spec_id}' AS metric_id, CASE WHEN (SELECT count(*) FROM ({ranked})) < 30 THEN 'no_data' WHEN coalesce(rarity, 0) < 0.85e0 THEN 'below_gate' ELSE 'emitted' END AS outcome, subject_id, rarity FROM (SELECT 1 AS one) LEFT JOIN ({best}) ON true"


RUNNABLE = [PROPOSED[0], PROPOSED[2], PROPOSED[3], PROPOSED[7]]
REFUSED = [PROPOSED[4], PROPOSED[5], PROPOSED[6]]


def ledger_sql() -> str:
    return " UNION ALL ".join([spec_sql(h) for h in RUNNABLE] + [f"SELECT '{h.spec_id}', 'invalid', NULL, NULL" for h in REFUSED])


def emitted_sql() -> str:
    return f"SELECT metric_id, subject_id, rarity FROM ({ledger_sql()}) WHERE outcome = 'emitted'"


@query("H2_run_specs", ledger_sql())
def h2(t):
    return H.run_specs(event_rows(t), H.enqueue([], PROPOSED), "user_id", "day", as_of(t)).withColumn("rarity", X.r6("rarity"))


WIN_SQL = "SELECT user_id AS subject_id, sum(c) / count(*) / 100 AS value, count(*) AS n FROM (SELECT user_id, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS c, CAST(ts AS DATE) AS d FROM @live) WHERE d BETWEEN DATE '2024-01-30' - W AND DATE '2024-01-30' GROUP BY 1 HAVING count(*) >= 8"


@query("H3_windowed_seasonal", "SELECT 'window14' AS spec, subject_id, round(value, 4) AS value, n FROM (" + WIN_SQL.replace("W AND", "14 AND") + ") UNION ALL SELECT 'season', subject_id, round(value, 4), n FROM (" + WIN_SQL.replace("W AND", "3650 AND") + ")")
def h3(t):
    a, b = H.Hypothesis("v", window_days=14), H.Hypothesis("v")
    ev = event_rows(t).withColumn("v", F.floor(c("value") * 100 + 0.5))
    name = F.create_map(F.lit(a.spec_id), F.lit("window14"), F.lit(b.spec_id), F.lit("season"))
    return H.population_rows(ev, [a, b], "user_id", "day", as_of(t), 8).select(
        name[c("metric_id")].alias("spec"), "subject_id", X.rnd(c("value") / 100, 4).alias("value"), "n")


@query("H4_stale_vs_empty", f"SELECT 'fresh' AS day, outcome, count(*) AS n FROM ({ledger_sql()}) GROUP BY 1, 2 UNION ALL SELECT 'late', outcome, count(*) FROM (SELECT CASE WHEN metric_id IN ('{RUNNABLE[0].spec_id}', '{RUNNABLE[2].spec_id}', '{RUNNABLE[3].spec_id}') THEN 'coverage_blocked' ELSE outcome END AS outcome FROM ({ledger_sql()})) GROUP BY 1, 2")
def h4(t):
    """The same specs on a day long after the newest row: stale, not merely quiet."""
    fresh = H.run_specs(event_rows(t), H.enqueue([], PROPOSED), "user_id", "day", as_of(t)).withColumn("day", F.lit("fresh"))
    late = H.run_specs(event_rows(t), H.enqueue([], PROPOSED), "user_id", "day", F.lit("2024-03-30").cast("date")).withColumn("day", F.lit("late"))
    return fresh.unionByName(late).groupBy("day", "outcome").agg(F.count("*").alias("n"))


LATE_SQL = f"SELECT metric_id, CASE WHEN metric_id IN ('{RUNNABLE[0].spec_id}', '{RUNNABLE[2].spec_id}', '{RUNNABLE[3].spec_id}') THEN 'coverage_blocked' ELSE outcome END AS outcome FROM ({ledger_sql()})"


@query("H5_outcome_ledger", f"SELECT metric_id, count(*) AS runs, count(*) FILTER (outcome = 'emitted') AS emitted, arg_max(outcome, run) AS last_outcome FROM (SELECT metric_id, outcome, 1 AS run FROM ({ledger_sql()}) UNION ALL SELECT metric_id, outcome, 2 FROM ({LATE_SQL})) GROUP BY 1")
def h5(t):
    """Two runs appended to the written ledger (one of them twice), then read back."""
    at = f"{shared_dir(t.spark)}/outcomes-{uuid.uuid4().hex[:10]}"
    run = lambda day: H.run_specs(event_rows(t), H.enqueue([], PROPOSED), "user_id", "day", day)
    late = F.lit("2024-03-30").cast("date")
    for name, day in (("1", as_of(t)), ("2", late), ("2", late)):
        H.record_outcomes(run(day), at, name)
    return H.outcome_summary(t.spark.read.parquet(at))


CAT = {"orders": (("o_orderkey", "o_custkey", "o_totalprice"), "o_orderdate"), "lineitem": (("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "l_shipdate"), "part": (("p_partkey", "p_size", "p_retailprice"), None)}


@query("H6_metric_catalog", " UNION ALL ".join(f"SELECT '{n}' AS tab, {str(d is not None).lower()} AS windowed, {f'(SELECT CAST(max({d}) AS DATE) FROM {n})' if d else 'CAST(NULL AS DATE)'} AS newest, col AS column FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in cols)}) v(col)" for n, (cols, d) in CAT.items()))
def h6(t):
    return H.catalog({"orders": t.orders, "lineitem": t.lineitem, "part": t.part}, {"orders": "o_orderdate", "lineitem": "l_shipdate"})


PROPOSAL_SQL = """(SELECT CASE user_id % 7 WHEN 0 THEN 'value' WHEN 1 THEN 'user_id' WHEN 2 THEN 'event_type' WHEN 3 THEN 'nothing' WHEN 4 THEN 'value; DROP' WHEN 5 THEN 'day' ELSE 'value' END AS col,
 CASE event_type WHEN 'click' THEN 'sum' WHEN 'error' THEN 'median' ELSE 'avg' END AS how, CASE WHEN event_type = 'view' THEN 'rank' ELSE 'extremeness' END AS lens, CASE WHEN event_id % 3 > 0 THEN event_id % 150 END AS w FROM @live)"""


@query("H7_column_allowlist", f"SELECT col AS column, outcome, count(*) AS specs FROM (SELECT *, CASE WHEN col IN ('value', 'user_id') AND how IN ('avg', 'sum') AND (w IS NULL OR w BETWEEN 1 AND 120) THEN 'runnable' ELSE 'invalid' END AS outcome FROM {PROPOSAL_SQL}) GROUP BY 1, 2")
def h7(t):
    """One proposal for each event, checked in bulk against the event table's own schema."""
    k = c("user_id") % 7
    column = F.when(k == 0, "value").when(k == 1, "user_id").when(k == 2, "event_type").when(k == 3, "nothing").when(k == 4, "value; DROP").when(k == 5, "day").otherwise("value")
    how = F.when(c("event_type") == "click", "sum").when(c("event_type") == "error", "median").otherwise("avg")
    asked = t.live.select(column.alias("column"), how.alias("how"), F.when(c("event_type") == "view", "rank").otherwise("extremeness").alias("lens"), F.when(c("event_id") % 3 > 0, c("event_id") % 150).alias("window_days"))
    said = H.check_proposals(asked, H.schema_of(event_rows(t)))
    return said.groupBy("column", "outcome").agg(F.count("*").alias("specs"))


# ---- the daily run -------------------------------------------------------------
FLAGGED_SQL = "(SELECT DISTINCT subject_id FROM @seasons WHERE subject_id % 100 = 0)"
BRIEF = {
    "grade": f"SELECT count(*) FROM {GRADED_SQL}", "learn": f"SELECT count(*) FROM {STATS_SQL}", "hypothesis": f"SELECT count(*) FROM ({ledger_sql()})",
    "discover": f"SELECT {sum(len(k) for k, _ in CAT.values())}", "leads": "SELECT count(DISTINCT user_id) FROM @live WHERE CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) - 2 FROM @live)",
    "verify": "SELECT count(*) FROM @seasons WHERE subject_id % 100 = 0", "log": f"SELECT count(*) FROM {PRED_SQL} WHERE subject_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND subject_id NOT IN {FLAGGED_SQL}",
}


@query("B6_daily_briefing", " UNION ALL ".join(f"SELECT '{k}' AS source, true AS complete, ({v}) AS rows" for k, v in BRIEF.items()))
def b6(t):
    """Grade, learn, test hypotheses, discover, find, verify against the source and log what verified; each
    step writes its table in the run's own folder, failures are recorded."""
    from .q_audit import c6
    base = f"{shared_dir(t.spark)}/briefing-{uuid.uuid4().hex[:10]}"

    def write(name, df):
        def act():
            df().write.mode("overwrite").parquet(f"{base}/{name}")
            return t.spark.read.parquet(f"{base}/{name}").count()
        return name, act

    def verified():
        flagged = t.spark.read.parquet(f"{base}/verify").select("subject_id").distinct()
        return q1(t).join(flagged, "subject_id", "left_anti")

    steps = [write("grade", lambda: graded(t)), write("learn", lambda: stats(t)), write("hypothesis", lambda: h2(t)), write("discover", lambda: h6(t)), write("leads", lambda: b2(t)), write("verify", lambda: c6(t)), write("log", verified)]
    return S.run_steps(t.spark, steps, f"{base}/ledger").select("source", "complete", "rows")
