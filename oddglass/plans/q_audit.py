"""Registered queries: coverage and audits (C), table maintenance and feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import audit as A
from ..operators import coverage as CV
from ..operators import ordering as O
from ..operators.joins import dealt, latest_per_key
from ..session import shared_dir
from ..sources import feed, writes
from . import q_windows as QW
from .q_detectors import LUCK_SQL, team_luck, with_league
from .registry import query

c = F.col


# ---- coverage ----------------------------------------------------------------
def domains(t):
    return {
        "season_batting": t.seasons, "expected": t.stats, "game_batting": t.games.withColumn("season", F.year("game_date")),
        "batted_balls": t.pitches.where("description <> 'ball'"), "pitch_level": t.pitches,
    }


STATUS = "CASE WHEN n_rows = 0 THEN 'EMPTY' WHEN newest < 2001 THEN 'STALE' WHEN subjects > 0 AND subjects < least THEN 'PARTIAL' ELSE 'OK' END"
COVER_SQL = f"""(SELECT domain, n_rows, seasons, newest, latest, subjects, {STATUS} AS status FROM (
 SELECT 'season_batting' AS domain, count(*) AS n_rows, count(DISTINCT year) AS seasons, max(year) AS newest, CAST(NULL AS DATE) AS latest, count(DISTINCT subject_id) AS subjects, 20 AS least FROM @seasons
 UNION ALL SELECT 'expected', count(*), count(DISTINCT year), max(year), NULL, count(DISTINCT subject_id), 100 FROM @stats
 UNION ALL SELECT 'game_batting', count(*), count(DISTINCT year(game_date)), CAST(max(year(game_date)) AS INTEGER), max(game_date), count(DISTINCT subject_id), 10 FROM @games
 UNION ALL SELECT 'batted_balls', count(*), count(DISTINCT season), max(season), max(game_date), count(DISTINCT subject_id), 20 FROM @pitches WHERE description <> 'ball'
 UNION ALL SELECT 'pitch_level', count(*), count(DISTINCT season), max(season), max(game_date), count(DISTINCT subject_id), 20 FROM @pitches)
 UNION ALL SELECT 'percentile_ranks', NULL, NULL, NULL, NULL, NULL, 'MISSING')"""


@query("C1_coverage_audit", f"SELECT * FROM {COVER_SQL}")
def c1(t):
    return CV.audit(domains(t), 2001, t.spark).select("domain", "n_rows", "seasons", "newest", "latest", "subjects", "status")


@query("C2_can_support", f"SELECT domain, status, capability, status = 'OK' AND (capability IN ('season_luck', 'approach_state', 'swing_path_state') OR seasons >= 2) AS backed FROM {COVER_SQL} JOIN (VALUES ('season_batting', 'career_baseline'), ('expected', 'season_luck'), ('percentile_ranks', 'approach_state'), ('percentile_ranks', 'swing_path_state'), ('game_batting', 'game_trend'), ('batted_balls', 'contact_trend'), ('pitch_level', 'approach_trend')) v(d, capability) ON d = domain")
def c2(t):
    return CV.can_support(CV.audit(domains(t), 2001, t.spark))


# ---- texts ---------------------------------------------------------------------
@query("C3_digit_audit", r"""SELECT doc_id, token FROM (SELECT DISTINCT doc_id, facts, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b|\.\d+\b')) AS token FROM (SELECT doc_id, text, '{"n_chars": ' || n_chars || ', "doc": ' || doc_id || ', "k": 0.5}' AS facts FROM documents))
 WHERE NOT contains(facts, token) AND NOT contains(facts, CASE WHEN starts_with(token, '0.') THEN substr(token, 2) WHEN starts_with(token, '.') THEN '0' || token ELSE token END)""")
def c3(t):
    facts = F.concat(F.lit('{"n_chars": '), c("n_chars").cast("string"), F.lit(', "doc": '), c("doc_id").cast("string"), F.lit(', "k": 0.5}'))
    return A.digit_audit(t.documents.withColumn("facts", facts), "doc_id", "text", "facts")


FRAMING_SQL = "CASE doc_id % 3 WHEN 0 THEN 'best this season' WHEN 1 THEN 'best in the Statcast era' ELSE 'a franchise record' END"


def scope_sql() -> str:
    rows = ", ".join(f"({i}, '{m}', '{p}')" for i, (marks, phrases) in enumerate(A.SCOPE_RULES) for m in marks for p in phrases)
    return f"SELECT DISTINCT doc_id, rule, phrase FROM (SELECT doc_id, lower(text) AS t, lower({FRAMING_SQL}) AS f FROM documents) JOIN (VALUES {rows}) v(rule, mark, phrase) ON contains(f, mark) AND contains(t, phrase)"


@query("C4_scope_guard", scope_sql())
def c4(t):
    m = c("doc_id") % 3
    framing = F.when(m == 0, "best this season").when(m == 1, "best in the Statcast era").otherwise("a franchise record")
    return A.scope_upgrades(t.documents.withColumn("framing", framing), "doc_id", "framing", "text")


@query("C12_text_lint", "SELECT conv_id, turn, NOT contains(text, '?') AS no_question, regexp_matches(lower(text), 'https?://|www\\.') AS has_link, length(text) - length(replace(text, '#', '')) > 1 AS hashtags, "
       + " OR ".join(f"contains(lower(text), '{b}')" for b in A.BAIT) + " AS bait, " + " OR ".join("contains(lower(text), '" + b.replace("'", "''") + "')" for b in A.TELLS) + " AS tell, length(text) > 270 AS too_long FROM conversations")
def c12(t):
    return t.conversations.select("conv_id", "turn", *[v.alias(k) for k, v in A.text_lint(c("text")).items()])


# ---- structures and sources --------------------------------------------------
@query("C5_structural_checks", """SELECT subject_id, season, 'rate_range' AS "check" FROM (SELECT *, count(*) OVER () FROM (SELECT subject_id, season, count(*) AS n, count(*) FILTER (zone > 12) AS a, count(*) FILTER (description = 'ball') AS b, CAST(sum(price_c) AS BIGINT) AS s FROM @pitches GROUP BY 1, 2)) WHERE a / n > 0.3e0 UNION ALL
 SELECT subject_id, season, 'mean_domain' FROM (SELECT subject_id, season, count(*) AS n, CAST(sum(price_c) AS BIGINT) AS s FROM @pitches GROUP BY 1, 2) WHERE s / n > 5200000 UNION ALL
 SELECT subject_id, season, 'parts_within_whole' FROM (SELECT subject_id, season, count(*) AS n, count(*) FILTER (zone > 12) AS a, count(*) FILTER (description = 'ball') AS b FROM @pitches GROUP BY 1, 2) WHERE a + b > n * 0.8e0""")
def c5(t):
    per = t.pitches.groupBy("subject_id", "season").agg(
        F.count("*").alias("n"), F.count_if(c("zone") > 12).alias("a"), F.count_if(c("description") == "ball").alias("b"), F.sum("price_c").alias("s"))
    return A.violations(per, ["subject_id", "season"], {
        "rate_range": c("a") / c("n") <= 0.3, "mean_domain": c("s") / c("n") <= 5200000, "parts_within_whole": c("a") + c("b") <= c("n") * 0.8})


@query("C6_cross_check_source", """SELECT subject_id, year, 'value' AS number, v AS stated, r AS again FROM (SELECT subject_id, year, CASE WHEN subject_id % 100 = 0 THEN hr + 1 ELSE hr END / 1e0 AS v, hr / 1e0 AS r FROM @seasons) WHERE abs(v - r) > 0.001e0""")
def c6(t):
    stated = t.seasons.select("subject_id", "year", F.when(c("subject_id") % 100 == 0, c("hr") + 1).otherwise(c("hr")).cast("double").alias("value"))
    source = t.orders.groupBy(c("o_custkey").alias("subject_id"), F.year("o_orderdate").alias("year")).agg(F.count_if(c("o_orderstatus") == "F").cast("double").alias("value"))
    return A.reconcile(stated, source, ["subject_id", "year"], {"value": 0.001})


@query("C7_provenance_check", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'source_named' ELSE 'date_given' END AS \"check\" FROM documents WHERE source = 'src1' OR lang = 'es'")
def c7(t):
    # Provenance entries built per document; src1 leaves the source out, Spanish texts the date (src1 texts keep theirs).
    entry = F.array(F.struct(F.when(c("source") != "src1", c("source")).alias("src"), F.when((c("lang") != "es") | (c("source") == "src1"), "2024-01-01").alias("day")))
    rows = t.documents.select("doc_id", entry.alias("prov"))
    return A.violations(rows, ["doc_id"], {
        "source_named": F.forall("prov", lambda e: e.src.isNotNull()), "date_given": F.forall("prov", lambda e: e.day.isNotNull())})


@query("C8_reconcile_team_player_pitcher", f"SELECT team, 'talent' AS number, round(round(talent, 3) + CASE WHEN team % 5 = 0 THEN 0.004e0 ELSE 0 END, 3) AS stated, round(talent, 3) AS again FROM {LUCK_SQL} WHERE team % 5 = 0")
def c8(t):
    # Stated: the aggregate of team_luck (every fifth team spoiled); again: per-subject contributions summed in another order.
    stated = team_luck(t).select("team", X.rnd(X.rnd("talent", 3) + F.when(c("team") % 5 == 0, 0.004).otherwise(0.0), 3).alias("talent"), X.rnd("woba", 3).alias("woba"))
    s = with_league(t).where("pa >= 40").select("team", "pa", X.regress(c("est_woba"), c("pa"), c("league")).alias("x"), "woba")
    again = s.groupBy("team").agg(X.rnd(F.sum(c("x") * c("pa")) / F.sum("pa"), 3).alias("talent"), X.rnd(F.sum(c("woba") * c("pa")) / F.sum("pa"), 3).alias("woba"))
    return A.reconcile(stated, again, ["team"], {"talent": 0.002, "woba": 0.002})


@query("C9_reconcile_cross_rank", """SELECT subject_id, asserted, reranked FROM (SELECT subject_id, round(100 * (rank() OVER (ORDER BY hard_hit_percent) - 1) / count(*) OVER (), 0) AS asserted, round(100 * (rank() OVER (ORDER BY brl_percent) - 1) / count(*) OVER (), 0) AS reranked, count(*) OVER () AS n FROM @stats WHERE year = 2001 AND pa >= 50) WHERE n >= 20 AND abs(asserted - reranked) > 18""")
def c9(t):
    s = t.stats_in(2001).where("pa >= 50").select("subject_id", "hard_hit_percent", "brl_percent")
    both = O.ecdf(O.ecdf(s, [], "hard_hit_percent", out="a"), [], "brl_percent", out="b", size="n")
    return both.where("n >= 20").select("subject_id", X.rnd(c("a") * 100, 0).alias("asserted"), X.rnd(c("b") * 100, 0).alias("reranked")).where(F.abs(c("asserted") - c("reranked")) > 18)


@query("C10_reconcile_ledger_windows_cohort", "SELECT subject_id, day, ab, hits, side FROM (SELECT subject_id, day, ab, hits + CASE WHEN hits = 2 THEN 1 ELSE 0 END AS hits, 'stated_only' AS side FROM " + QW.LOG_SQL + " WHERE hits = 2 UNION ALL SELECT subject_id, day, ab, hits, 'recomputed_only' FROM " + QW.LOG_SQL + " WHERE hits = 2)")
def c10(t):
    # Nearly every order is a day of its own: both routes and their comparison run where the orders of a day are dealt to.
    orders = dealt(t.orders.select("o_custkey", c("o_orderdate").cast("date").alias("o_orderdate"), "o_orderstatus"), ["o_custkey", "o_orderdate"])
    stated = QW.log_of(orders).withColumn("hits", c("hits") + F.when(c("hits") == 2, 1).otherwise(0))
    again = orders.select(c("o_custkey").alias("subject_id"), c("o_orderdate").cast("date").alias("day"), (c("o_orderstatus") != "P").cast("bigint").alias("a"), (c("o_orderstatus") == "F").cast("bigint").alias("h")).groupBy("subject_id", "day").agg(F.sum("a").alias("ab"), F.sum("h").alias("hits"))
    return A.rows_differ(stated, again)


@query("C11_angle_audit", f"SELECT team, owed, CASE WHEN pa / (pa + 220) >= 0.7e0 THEN 'high' WHEN pa / (pa + 220) >= 0.45e0 THEN 'moderate' ELSE 'low' END AS tier, abs(owed) = pa AS backed FROM {LUCK_SQL}")
def c11(t):
    """Is the shown number one of the finding's numbers, as a whole token?"""
    shown = F.abs("owed").cast("bigint").cast("string")
    facts = F.concat(F.lit("["), c("pa").cast("string"), F.lit("]"))
    return team_luck(t).select("team", "owed", X.reliability_tier(X.reliability(c("pa"))).alias("tier"), F.array_contains(X.number_tokens(facts), shown).alias("backed"))


@query("C11b_angle_checks", f"""SELECT team, "check" FROM (SELECT team, unnest(CASE team % 7 WHEN 0 THEN ['headline'] WHEN 1 THEN ['tier'] WHEN 2 THEN ['caveat'] WHEN 3 THEN ['headline', 'corpus'] WHEN 5 THEN ['reliability'] ELSE [] END) AS "check" FROM {LUCK_SQL})""")
def c11b(t):
    """Findings with a spoiled headline, tier, reliability, corpus or caveat, by team; the others are sound."""
    luck = team_luck(t).withColumn("reliability", X.reliability(c("pa")))
    k = c("team") % 7
    stat = lambda v, unit: F.struct(v.cast("double").alias("value"), F.lit(unit).alias("unit"))
    stats = F.array(stat(F.abs("owed"), "points"), stat(c("pa"), "count"), stat(c("talent"), "rate"))
    # the spoiled number holds the right one: a comparison inside numbers would pass it
    head = F.format_string("owed %d points over %d chances, true rate %s", F.abs("owed").cast("bigint"), F.when(k == 0, c("pa") * 10 + 7).otherwise(c("pa")), F.regexp_replace(F.format_string("%.3f", X.rnd("talent", 3)), "^0", ""))
    reliability = F.when(k == 5, 1.5).otherwise(c("reliability"))
    tier = X.reliability_tier(F.when(k == 5, 1.5).otherwise(c("reliability")))
    angles = luck.select(
        "team", head.alias("headline"), F.when(k == 3, F.filter(stats, lambda x: F.lit(False))).otherwise(stats).alias("stats"), reliability.alias("reliability"),
        F.when(k == 1, "certain").otherwise(tier).alias("tier"), F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("one year"))).alias("caveats"))
    return A.angle_audit(angles, ["team"], "headline", "stats", "reliability", "tier", "caveats")


# ---- review ------------------------------------------------------------------
PANEL_SQL = """(SELECT user_id, CASE event_type WHEN 'click' THEN 'statistician' WHEN 'view' THEN 'causal' WHEN 'error' THEN 'coverage' WHEN 'purchase' THEN 'editor' ELSE 'voice' END AS lens, CASE WHEN value > 180 THEN 'BLOCK' WHEN value > 120 THEN 'REVISE' ELSE 'PASS' END AS verdict,
 CASE WHEN value > 120 THEN CASE event_type WHEN 'click' THEN 'sample_too_small' WHEN 'view' THEN 'causal_no_control' WHEN 'error' THEN 'trivial' WHEN 'purchase' THEN 'trivial' END END AS failure_mode, (value * 100 % 100) / 100e0 + 0.3e0 AS confidence, ts, event_id FROM @live)"""
NEWEST_SQL = f"(SELECT * FROM {PANEL_SQL} QUALIFY row_number() OVER (PARTITION BY user_id, lens ORDER BY ts DESC, event_id DESC) = 1)"
MODES_SQL = " OR ".join(f"lens = '{k}' AND failure_mode IN ({', '.join(chr(39) + m + chr(39) for m in v)})" for k, v in A.LENS_MODES.items())


def panel(t):
    e, v = c("event_type"), c("value")
    lens = F.when(e == "click", "statistician").when(e == "view", "causal").when(e == "error", "coverage").when(e == "purchase", "editor").otherwise("voice")
    mode = F.when(v > 120, F.when(e == "click", "sample_too_small").when(e == "view", "causal_no_control").when(e.isin("error", "purchase"), "trivial"))
    rows = t.live.select("user_id", lens.alias("lens"), F.when(v > 180, "BLOCK").when(v > 120, "REVISE").otherwise("PASS").alias("verdict"), mode.alias("failure_mode"),
                         (F.pmod(v * 100, F.lit(100)) / 100.0 + 0.3).alias("confidence"), "ts", "event_id")
    return latest_per_key(rows, ["user_id", "lens"], ["ts", "event_id"])


@query("C13_adjudicate", f"""SELECT user_id, blocks, revises, lenses, breaks AS contract_breaks, CASE WHEN blocks > 0 THEN 'blocked' WHEN revises > 0 THEN 'revise' ELSE 'cleared' END AS outcome FROM (SELECT user_id, count(*) FILTER (e = 'BLOCK') AS blocks, count(*) FILTER (e = 'REVISE') AS revises, count(*) AS lenses, count(*) FILTER ((verdict <> 'PASS' AND failure_mode IS NULL) OR (failure_mode IS NOT NULL AND NOT ({MODES_SQL}))) AS breaks
 FROM (SELECT *, CASE WHEN verdict = 'PASS' AND confidence < 0.6e0 AND lens IN ('causal', 'coverage') THEN 'BLOCK' ELSE verdict END AS e FROM {NEWEST_SQL}) GROUP BY 1)""")
def c13(t):
    return A.adjudicate(panel(t), "user_id")


@query("C14_stale_clearance", "SELECT doc_id, quality = 1 AND n_chars % 7 > 0 AS current FROM labels JOIN documents USING (doc_id)")
def c14(t):
    # A clearance counts only while the content hash it was given for is still the content's hash.
    now = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    cleared_for = t.documents.select("doc_id", F.sha2(F.when(c("n_chars") % 7 > 0, c("text")).otherwise(F.concat("text", F.lit(" (edited)"))), 256).alias("cleared_hash"))
    got = t.labels.join(now, "doc_id").join(cleared_for, "doc_id")
    return got.select("doc_id", ((c("quality") == 1) & (c("hash") == c("cleared_hash"))).alias("current"))


@query("C15_packet_gaps", "SELECT gap, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN quality IS NULL THEN 'population' END, CASE WHEN lang = 'es' THEN 'coverage' END, CASE WHEN n_chars % 5 = 0 THEN 'season' END, CASE WHEN n_chars % 3 = 0 AND toxic IS NULL THEN 'peers' END, 'park', 'defense'], lambda x: x IS NOT NULL)) AS gap FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def c15(t):
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    gaps = A.packet_gaps(c("quality"), c("lang") != "es", F.when(c("n_chars") % 5 != 0, c("n_chars")), F.when(c("n_chars") % 3 == 0, 2).otherwise(1), c("toxic"))
    return d.select(F.explode(gaps).alias("gap")).groupBy("gap").agg(F.count("*").alias("n"))


@query("C16_fact_mutation", "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0")
def c16(t):
    original = t.orders.select("o_orderkey", F.to_json(F.struct("o_totalprice", "o_orderstatus")).alias("facts"))
    submitted = t.orders.select("o_orderkey", F.to_json(F.struct(F.when(c("o_orderkey") % 97 == 0, c("o_totalprice") + 1).otherwise(c("o_totalprice")).alias("o_totalprice"), "o_orderstatus")).alias("sent"))
    return original.join(submitted, "o_orderkey").where(~c("facts").eqNullSafe(c("sent"))).select("o_orderkey")


# ---- maintenance -----------------------------------------------------------
def scratch(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("S5_replace_slice", "SELECT season, count(*) AS n, CAST(sum(price_c) AS BIGINT) + CASE WHEN season = 2001 THEN count(*) ELSE 0 END AS total FROM @pitches GROUP BY 1")
def s5(t):
    path = scratch(t, "slices")
    per = t.pitches.groupBy("season", "subject_id").agg(F.count("*").alias("n"), F.sum("price_c").alias("total"))
    writes.replace_slice(per, path, ["season"])
    newer = per.where("season = 2001").withColumn("total", c("total") + c("n"))
    writes.replace_slice(newer, path, ["season"])
    writes.replace_slice(newer, path, ["season"])  # a second run changes nothing
    return t.spark.read.parquet(path).groupBy("season").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("S6_upsert_latest", "SELECT subject_id, year, n, CASE WHEN year = 2001 THEN hr + 1 ELSE hr END AS hr FROM @seasons")
def s6(t):
    base = t.seasons.select("subject_id", "year", "n", "hr").withColumn("ingested_at", F.lit(1))
    new = base.where("year = 2001").withColumn("hr", c("hr") + 1).withColumn("ingested_at", F.lit(2))
    return writes.upsert_latest(base, new, ["subject_id", "year"], "ingested_at").drop("ingested_at")


@query("S7_insert_if_absent", "SELECT subject_id, year FROM @seasons WHERE subject_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def s7(t):
    known = t.seasons.join(t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("subject_id")), "subject_id", "left_semi").select("subject_id", "year")
    twice = t.seasons.select("subject_id", "year").unionByName(t.seasons.select("subject_id", "year"))
    return writes.insert_if_absent(known, twice, ["subject_id", "year"])


@query("S8_run_ledger", "SELECT event_type AS source, max(ts) FILTER (value > 20) AS last_complete FROM @live GROUP BY 1")
def s8(t):
    """A run for each half of the events, one of them repeated, appended to the written ledger and read back."""
    at = f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex[:10]}"
    run = lambda half: t.live.where(half).select(c("event_type").alias("source"), (c("value") > 20).alias("complete"), c("ts").alias("finished_at"))
    for name, half in (("1", "event_id % 2 = 0"), ("2", "event_id % 2 = 1"), ("1", "event_id % 2 = 0")):
        writes.append_run(run(half), at, name)
    return writes.last_complete(writes.read_ledger(t.spark, at))


@query("S9_freshness_guard", "SELECT source, last_complete, coalesce(date_sub('hour', last_complete, TIMESTAMP '2024-01-31 12:00:00') > 48, true) AS stale FROM (SELECT 'u' || user_id AS source, max(ts) FILTER (event_type = 'purchase') AS last_complete FROM @live GROUP BY 1)")
def s9(t):
    led = t.live.select(F.concat(F.lit("u"), c("user_id").cast("string")).alias("source"), (c("event_type") == "purchase").alias("complete"), c("ts").alias("finished_at"))
    return writes.freshness_guard(led, led.select("source").distinct(), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))


@query("S15_step_chain", "SELECT 'seasons' AS source, true AS complete, count(*) AS rows FROM @seasons UNION ALL SELECT 'remote', false, 0 UNION ALL SELECT 'pitches', true, count(*) FROM @pitches")
def s15(t):
    """Three refresh steps; the middle one fails and the others still run."""
    def broken():
        raise ValueError("source not reachable")
    steps = [("seasons", lambda: t.seasons.count()), ("remote", broken), ("pitches", lambda: t.pitches.count())]
    return writes.run_steps(t.spark, steps, f"{shared_dir(t.spark)}/steps-{uuid.uuid4().hex[:10]}").select("source", "complete", "rows")


FEED_SQL = "(SELECT l_orderkey AS game_pk, l_suppkey AS pitcher_id, l_linenumber AS at_bat, CAST(l_quantity AS INTEGER) AS pitch_number, CASE l_returnflag WHEN 'R' THEN 'swinging_strike' WHEN 'A' THEN 'foul' ELSE 'ball' END AS description, l_linenumber % 5 > 0 AS is_pitch, l_extendedprice AS speed FROM lineitem)"


def feeds(t):
    """One nested JSON feed per game, derived from the lines (a few per order)."""
    r = c("l_returnflag")
    event = F.struct(
        (c("l_linenumber") % 5 > 0).alias("isPitch"), c("l_quantity").cast("int").alias("pitchNumber"),
        F.when(r == "R", "swinging_strike").when(r == "A", "foul").otherwise("ball").alias("description"), c("l_extendedprice").alias("startSpeed"))
    k, hit = c("l_linenumber"), (c("l_tax") > 0.06).cast("int")
    # the given tables have no score, inning or batter: lines stand for at-bats, nine to two innings, tax and discount for hits and runs
    play = F.struct(
        k.alias("atBatIndex"), c("l_suppkey").alias("pitcherId"), c("l_partkey").alias("batterId"), (F.floor((k - 1) / 4) + 1).cast("int").alias("inning"), (k % 2 == 1).alias("isTop"),
        F.struct(hit.alias("hits"), (c("l_discount") > 0.08).cast("int").alias("runs"), (c("l_tax") > 0.07).cast("int").alias("homeRuns")).alias("result"), F.array(event).alias("playEvents"))
    games = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(play).alias("allPlays"))
    return games.select(c("l_orderkey").alias("gamePk"), F.to_json(F.struct(c("l_orderkey").alias("gamePk"), F.lit("Live").alias("status"), F.struct("allPlays").alias("plays"))).alias("feed"))


@query("S11_feed_flatten", f"SELECT game_pk, pitcher_id, count(*) AS n, count(*) FILTER (description <> 'ball') AS swings, count(*) FILTER (description = 'swinging_strike') AS whiffs, round(max(speed), 2) AS top FROM {FEED_SQL} WHERE is_pitch GROUP BY 1, 2")
def s11(t):
    return feed.flatten(feeds(t), "feed").groupBy("game_pk", "pitcher_id").agg(
        F.count("*").alias("n"), F.count_if("is_swing").alias("swings"), F.count_if("is_whiff").alias("whiffs"), X.rnd(F.max("start_speed"), 2).alias("top"))


PLAY_SQL = "(SELECT l_orderkey AS game_pk, l_linenumber AS at_bat, l_suppkey AS pitcher_id, l_partkey AS batter_id, CAST(floor((l_linenumber - 1) / 4) AS INTEGER) + 1 AS inning, l_linenumber % 2 = 1 AS top, CAST(l_tax > 0.06 AS INTEGER) AS hits, CAST(l_discount > 0.08 AS INTEGER) AS runs FROM lineitem)"


@query("S12_feed_snapshot", f"""SELECT game_pk, pitches, last_at_bat, whiffs, inning, half, home, away, batter_id, batter_hits, batter_at_bats FROM (SELECT game_pk, count(*) FILTER (is_pitch) AS pitches, count(*) FILTER (is_pitch AND description = 'swinging_strike') AS whiffs FROM {FEED_SQL} GROUP BY 1)
 JOIN (SELECT game_pk, max(at_bat) AS last_at_bat, max(inning) AS inning, arg_max(CASE WHEN top THEN 'top' ELSE 'bottom' END, (at_bat, batter_id)) AS half, CAST(sum(runs) FILTER (NOT top) AS BIGINT) AS home, CAST(sum(runs) FILTER (top) AS BIGINT) AS away, arg_max(batter_id, (at_bat, batter_id)) AS batter_id FROM {PLAY_SQL} GROUP BY 1) USING (game_pk)
 JOIN (SELECT game_pk, batter_id, CAST(sum(hits) AS BIGINT) AS batter_hits, count(*) AS batter_at_bats FROM {PLAY_SQL} GROUP BY 1, 2) USING (game_pk, batter_id)""")
def s12(t):
    got = feed.snapshot(feeds(t), "feed")
    return got.select("game_pk", "pitches", "last_at_bat", "whiffs", "inning", "half", "home", "away", "batter_id", "batter_hits", "batter_at_bats")
