"""Registered queries: the scan pipeline (P) and interest scoring (I, T6)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import contrast as C
from ..operators import interest as I
from ..operators import lenses as L
from ..operators import rates as R
from ..operators import scan as S
from ..operators import scope as P
from ..operators.joins import best_per_key
from . import scan
from .q_joins import REGISTRY_SQL, focal, registry_rows
from .q_lenses import CONTRAST_LENS_SQL, FAMILY_OF, career_moves, contrasts
from .q_rates import METRIC_SQL, SIDE_SQL, rate_sql
from .q_scalars import confidence_sql
from .registry import query
from .specs import load_registry

c = F.col
NOW = 2001
FOCAL = "(SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)"
R_NOW = f"(SELECT * FROM {REGISTRY_SQL} WHERE year = {NOW})"
STAB = 60
LENS_SQL = f"""(SELECT metric_id, year, subject_id, lens, value, rarity, rank, pct, pop_n FROM (
 SELECT metric_id, year, subject_id, 'extremeness' AS lens, value, 0.5e0 + (pct - 0.5e0) * least(1, n / {STAB}) AS rarity, CAST(NULL AS BIGINT) AS rank, pct, pop_n FROM (SELECT *, (rank() OVER m - 1) / count(*) OVER (PARTITION BY metric_id) AS pct, count(*) OVER (PARTITION BY metric_id) AS pop_n FROM {R_NOW} WINDOW m AS (PARTITION BY metric_id ORDER BY CASE WHEN higher THEN value ELSE -value END)) WHERE n >= 12
 UNION ALL SELECT metric_id, year, subject_id, 'rank', value, 1 - (rank - 1) / least(15, greatest(1, floor(pop_n / 4))), rank, NULL, pop_n FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY CASE WHEN higher THEN -value ELSE value END, subject_id) AS rank, count(*) OVER (PARTITION BY metric_id) AS pop_n FROM {R_NOW}) WHERE rank <= least(15, greatest(1, floor(pop_n / 4)))
 UNION ALL SELECT metric_id, year, subject_id, 'milestone_proximity', value, 0.8e0 + 0.15e0 * (1 - (ms - value) / ms / 0.1e0), NULL, NULL, pop_n FROM (SELECT *, count(*) OVER () AS pop_n FROM {R_NOW} WHERE metric_id = 'brl_percent'), (VALUES (5e0), (10e0)) v(ms) WHERE (ms - value) / ms > 0 AND (ms - value) / ms <= 0.1e0)
 WHERE (lens <> 'extremeness' OR rarity >= 0.8e0) AND pop_n >= 30 AND subject_id IN {FOCAL})"""
FLOORED = f"(SELECT * FROM {LENS_SQL} WHERE rarity >= 0.85e0)"
BEST_SQL = f"(SELECT * FROM {FLOORED} QUALIFY row_number() OVER (PARTITION BY subject_id, metric_id ORDER BY rarity DESC, lens) = 1)"


def now_rows(t):
    return registry_rows(t, NOW)


def hits(t):
    return scan.apply_lenses(now_rows(t), load_registry().metrics, focal(t))


@query("P2_apply_lenses", f"SELECT metric_id, subject_id, lens, round(rarity, 6) AS rarity, rank, pop_n FROM {LENS_SQL}")
def p2(t):
    return hits(t).select("metric_id", "subject_id", "lens", X.r6("rarity").alias("rarity"), "rank", "pop_n")


SPLITS_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric_id, '{s}' AS side, subject_id, value, n, {d[3]} AS stab, {str(d[4]).lower()} AS higher FROM ({rate_sql(m, w)})"
    for m, d in METRIC_SQL.items() for s, w in SIDE_SQL.items() if not (s.startswith("zone_bucket") and m in ("chase_rate", "zone_contact"))) + ")"


P3_SQL = f"""SELECT metric_id, side, subject_id, round(rarity, 6) AS rarity FROM (SELECT *, 0.5e0 + (pct - 0.5e0) * least(1, n / stab) AS rarity FROM (SELECT *, (rank() OVER (PARTITION BY metric_id, side ORDER BY CASE WHEN higher THEN value ELSE -value END) - 1) / count(*) OVER (PARTITION BY metric_id, side) AS pct, count(*) OVER (PARTITION BY metric_id, side) AS pop_n FROM {SPLITS_SQL})
 WHERE pop_n >= 10 AND n >= greatest(10, floor(stab / 5))) WHERE rarity >= 0.8e0 AND subject_id IN {FOCAL}"""


@query("P3_scan_splits", P3_SQL)
def p3(t):
    tied = [m.id for m in R.AGG_METRICS if m.denominator_columns]
    rows = R.all_rates(t.pitches, sides=R.split_sides()).where(~(c("metric_id").isin(*tied) & c("side").startswith("zone_bucket")))
    return L.extremeness(rows, ["metric_id", "side"]).join(focal(t), "subject_id", "left_semi").select("metric_id", "side", "subject_id", X.r6("rarity").alias("rarity"))


P4_SQL = f"SELECT metric_id, pair, subject_id, round(rarity, 6) AS rarity FROM {CONTRAST_LENS_SQL} WHERE rarity >= 0.85e0 AND subject_id IN {FOCAL}"


@query("P4_scan_contrasts", P4_SQL)
def p4(t):
    return C.split_contrast_lens(contrasts(t), ["metric_id", "pair"]).join(focal(t), "subject_id", "left_semi").select("metric_id", "pair", "subject_id", X.r6("rarity").alias("rarity"))


P5_SQL = f"""SELECT subject_id, round(net, 6) AS net, round(z, 6) AS z, round(rarity, 6) AS rarity FROM (SELECT subject_id, net, net / sd AS z, n, least(0.95e0, (rank() OVER (ORDER BY round_even(abs(net), 9)) - 1) / count(*) OVER ()) AS rarity
 FROM (SELECT subject_id, move - avg(move) OVER () AS net, stddev_pop(move) OVER () AS sd, count(*) OVER () AS n FROM (SELECT subject_id, max(ba) FILTER (year = 2001) - avg(ba) FILTER (year < 2001) AS move FROM @stats GROUP BY 1 HAVING count(*) FILTER (year < 2001) >= 3 AND max(ba) FILTER (year = 2001) IS NOT NULL))) WHERE n >= 30 AND abs(z) >= 1.0e0 AND subject_id IN {FOCAL}"""


@query("P5_scan_career", P5_SQL)
def p5(t):
    moves = career_moves(t)
    shifts = L.career_shift(moves, gate=1.0)
    return shifts.join(L.shift_rarity(moves.select("subject_id", "move")).select("subject_id", "rarity"), "subject_id").join(focal(t), "subject_id", "left_semi").select(
        "subject_id", X.r6("net").alias("net"), X.r6("z").alias("z"), X.r6("rarity").alias("rarity"))


def inputs(t):
    team = t.supplier.select(c("s_suppkey").alias("subject_id"), c("s_nationkey").alias("team"))
    marquee = t.supplier.where("s_acctbal > 9000").select(c("s_suppkey").alias("subject_id"))
    return scan.ScanInputs(registry_rows(t), focal(t), marquee, team, NOW)


def best_hits(t):
    got = hits(t).where("rarity >= 0.85D")
    return best_per_key(got, ["subject_id", "metric_id", "year"], c("rarity"), [c("lens")]).select(*scan.HIT_COLUMNS)


TEAM_ROWS = f"(SELECT r.*, s_nationkey AS team, CASE WHEN higher THEN value ELSE -value END AS v FROM {REGISTRY_SQL} r JOIN supplier ON s_suppkey = subject_id)"
SCOPE_SQL = f"""(SELECT *, CASE WHEN prior_best IS NULL OR v > prior_best OR anchor_period IS NULL THEN 'franchise_record' ELSE 'first_since' END AS tier FROM (
 SELECT b.*, t.v, (SELECT max(h.v) FROM {TEAM_ROWS} h WHERE h.metric_id = b.metric_id AND h.team = t.team AND h.year < b.year AND h.subject_id <> b.subject_id) AS prior_best,
  (SELECT max(h.year) FROM {TEAM_ROWS} h WHERE h.metric_id = b.metric_id AND h.team = t.team AND h.year < b.year AND h.subject_id <> b.subject_id AND h.v >= t.v) AS anchor_period
 FROM {BEST_SQL} b JOIN {TEAM_ROWS} t ON t.metric_id = b.metric_id AND t.subject_id = b.subject_id AND t.year = b.year))"""
SCOPED = f"(SELECT * REPLACE (CASE WHEN tier = 'franchise_record' THEN least(rarity + 0.05e0, 1e0) ELSE rarity END AS rarity) FROM {SCOPE_SQL})"


@query("P6_franchise_scope", f"SELECT metric_id, subject_id, lens, round(rarity, 6) AS rarity, tier, anchor_period FROM {SCOPED}")
def p6(t):
    return scan.strengthen(best_hits(t), inputs(t)).select("metric_id", "subject_id", "lens", X.r6("rarity").alias("rarity"), "tier", "anchor_period")


def conj_sql(best: str) -> str:
    return f"""(SELECT year, subject_id, count(*) AS members, exp(avg(ln(rarity))) AS rarity, string_agg(metric_id, '+' ORDER BY metric_id) AS metrics FROM (SELECT *, row_number() OVER (PARTITION BY year, subject_id ORDER BY rarity DESC, metric_id) AS k FROM (
 SELECT *, {FAMILY_OF} AS family FROM {best} WHERE {FAMILY_OF} <> 'luck_residual' QUALIFY row_number() OVER (PARTITION BY year, subject_id, {FAMILY_OF} ORDER BY rarity DESC, metric_id) = 1)) WHERE k <= 3 GROUP BY 1, 2 HAVING count(*) >= 2)"""


WIDE_BEST = "(SELECT metric_id, year, subject_id, pct AS rarity FROM (SELECT *, (rank() OVER (PARTITION BY metric_id, year ORDER BY CASE WHEN higher THEN value ELSE -value END) - 1) / count(*) OVER (PARTITION BY metric_id, year) AS pct FROM " + REGISTRY_SQL + ") WHERE pct >= 0.8e0)"


def wide_hits(t):
    from .q_joins import percentiles
    return percentiles(t).where("pct >= 0.8D").select("metric_id", "year", "subject_id", c("pct").alias("rarity"))


@query("P7_conjunction_groups", f"SELECT year, subject_id, members, round(rarity, 6) AS rarity, metrics FROM {conj_sql(WIDE_BEST)}")
def p7(t):
    return P.conjunctions(wide_hits(t), ["year"], "subject_id").withColumn("rarity", X.r6("rarity"))


PEERS_SQL = f"""SELECT year, metrics, count(*) FILTER (passed = k) AS qualifying, count(*) FILTER (present = k) AS population FROM (
 SELECT g.year, g.metrics, k, r.subject_id, count(*) AS present, count(*) FILTER ((CASE WHEN higher THEN value ELSE -value END) >= cut) AS passed
 FROM (SELECT DISTINCT year, metrics, len(string_split(metrics, '+')) AS k FROM {{groups}}) g JOIN {REGISTRY_SQL} r ON r.year = g.year AND list_contains(string_split(g.metrics, '+'), r.metric_id)
 JOIN (SELECT metric_id AS m, year AS y, quantile_cont(CASE WHEN higher THEN value ELSE -value END, 0.9) AS cut FROM {REGISTRY_SQL} GROUP BY 1, 2) ON m = r.metric_id AND y = r.year GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""


@query("P8_conjunction_peers", PEERS_SQL.replace("{groups}", conj_sql(WIDE_BEST)))
def p8(t):
    groups = P.conjunctions(wide_hits(t), ["year"], "subject_id")
    return P.conjunction_peers(groups, registry_rows(t), ["year"], "subject_id")


HERO = "(lens = 'extremeness' AND rarity >= 0.95e0 OR subject_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000))"


@query("P9_hero_gate", f"SELECT metric_id, subject_id, lens, round(rarity, 6) AS rarity FROM {BEST_SQL} WHERE {HERO}")
def p9(t):
    return S.hero_gate(best_hits(t), inputs(t).marquee, "subject_id").select("metric_id", "subject_id", "lens", X.r6("rarity").alias("rarity"))


@query("P10_evidence", f"SELECT metric_id, subject_id, lens, CASE lens WHEN 'rank' THEN 'rank' ELSE 'tail' END AS kind, CASE lens WHEN 'rank' THEN rank END AS qualifying, pop_n AS population, round(CASE lens WHEN 'rank' THEN rank / pop_n ELSE greatest(1 - pct, 1 / pop_n) END, 6) AS tail_p FROM {LENS_SQL} WHERE lens <> 'milestone_proximity'")
def p10(t):
    h = hits(t).where("lens <> 'milestone_proximity'")
    ev = F.when(c("lens") == "rank", S.rank_evidence(c("rank"), c("pop_n"))).otherwise(S.tail_evidence(c("pct"), c("pop_n")))
    return h.withColumn("e", ev).select("metric_id", "subject_id", "lens", "e.kind", "e.qualifying", "e.population", X.r6("e.tail_p").alias("tail_p"))


LEG1 = "1e0"
SURPRISE_SQL = "least(1e0, greatest(0e0, greatest(0e0, -log2(greatest(tail_p, 1e-9)) - log2(greatest(search_space, 1e0))) / 6e0))"
TESTED_SQL = f"""(SELECT *, p <= bh_rank / bh_m * 0.05e0 OR NOT (1 / pop <= 0.05e0 / bh_m) AS survives FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, metric_id, subject_id, year, lens) AS bh_rank, count(*) OVER (PARTITION BY family) AS bh_m, max(pop_n) OVER (PARTITION BY family) AS pop
 FROM (SELECT *, {FAMILY_OF} AS family, round_even(1 - rarity, 9) AS p FROM {FLOORED})))"""


def p1_sql(keep: str, more: str = "", limit: str = "ORDER BY score DESC, kind, what, who LIMIT 40") -> str:
    tail = "CASE WHEN lens = 'rank' AND rank IS NOT NULL THEN rank / pop_n ELSE greatest(1 - pct, 1 / pop_n) END"
    return f"""WITH best AS MATERIALIZED (SELECT * FROM {TESTED_SQL} WHERE {keep} QUALIFY row_number() OVER (PARTITION BY subject_id, metric_id ORDER BY rarity DESC, lens) = 1),
scoped AS MATERIALIZED (SELECT *, {tail} AS tail_p FROM {SCOPED.replace(BEST_SQL, 'best')}),
grp AS MATERIALIZED (SELECT * FROM {conj_sql('scoped')} WHERE rarity >= 0.85e0),
rest AS MATERIALIZED (SELECT * FROM scoped ANTI JOIN (SELECT subject_id, unnest(string_split(metrics, '+')) AS metric_id FROM grp) USING (subject_id, metric_id)),
boards AS MATERIALIZED (SELECT * FROM rest QUALIFY count(*) OVER (PARTITION BY metric_id) >= 3 AND row_number() OVER (PARTITION BY metric_id ORDER BY rarity DESC, subject_id) = 1),
found AS (SELECT 'scan' AS kind, metric_id AS what, subject_id::VARCHAR AS who, rarity, tier, anchor_period, tail_p, 9e0 AS search_space, 1 AS members, survives FROM rest WHERE {HERO} AND metric_id NOT IN (SELECT metric_id FROM boards)
 UNION ALL SELECT 'board', metric_id, subject_id::VARCHAR, rarity, tier, anchor_period, tail_p, 9e0, 1, survives FROM boards
 UNION ALL SELECT 'conjunction', g.metrics, subject_id::VARCHAR, rarity, NULL, NULL, qualifying / population, pow(2e0, log2(factorial(9) / (factorial(CAST(members AS INTEGER)) * factorial(CAST(9 - members AS INTEGER))))), members, NULL FROM grp g JOIN ({PEERS_SQL.replace('{groups}', 'grp')}) p ON p.metrics = g.metrics AND p.year = g.year
 UNION ALL SELECT 'contrast', metric_id || '|' || pair, subject_id::VARCHAR, rarity, NULL, NULL, 1 - rarity, 9e0, 1, NULL FROM ({P4_SQL})
 UNION ALL SELECT 'shift', 'ba', subject_id::VARCHAR, rarity, NULL, NULL, 1 - rarity, 9e0, 1, NULL FROM ({P5_SQL}){more}),
s AS (SELECT *, CASE WHEN tail_p IS NULL THEN 0e0 ELSE {SURPRISE_SQL} END AS sp, CASE WHEN tier = 'franchise_record' THEN 0.95e0 ELSE 0e0 END AS st, CASE WHEN anchor_period IS NULL OR {NOW} - anchor_period >= 5 THEN 1e0 ELSE least(1e0, greatest(0.15e0, ({NOW} - anchor_period) / 5e0)) END AS since FROM found),
top AS (SELECT kind, what, who, round(rarity, 6) AS rarity, tier, anchor_period, tail_p, members, survives, round((greatest(sp, st) + (1 - greatest(sp, st)) * 0.35e0 * least(sp, st)) * (0.55e0 + 0.45e0 * (1 - 0.22e0 * (members - 1))) * since, 6) AS score FROM s {limit})
SELECT kind, what, who, rarity, tier, anchor_period, round(tail_p, 6) AS tail_p, CAST(members AS INTEGER) AS members, survives, score FROM top"""


P1_CLEAN = p1_sql("true")
P1_LONG = replace(load_registry().scan, top_k=40)  # long enough for findings of every shape


def other_shapes(t):
    contrast = p4(t).select(F.lit("contrast").alias("kind"), F.concat_ws("|", "metric_id", "pair").alias("what"), c("subject_id").cast("string").alias("who"), "rarity")
    shift = p5(t).select(F.lit("shift").alias("kind"), F.lit("ba").alias("what"), c("subject_id").cast("string").alias("who"), "rarity")
    return contrast.unionAll(shift)


def scan_findings(t, cfg):
    got = scan.run_scan(replace(inputs(t), others=other_shapes(t)), load_registry().metrics, cfg)
    return got.select("kind", "what", "who", "rarity", "tier", "anchor_period", X.r6("tail_p").alias("tail_p"), "members", "survives", "score")


@query("P1_scan", P1_CLEAN)
def p1(t):
    return scan_findings(t, P1_LONG)


@query("P1b_scan_strict", p1_sql("survives"))
def p1b(t):
    """Hits that fail the false-discovery control are gone."""
    return scan_findings(t, replace(P1_LONG, fdr_mode="strict"))


P11_TAIL = "CASE WHEN lens = 'rank' THEN rank / pop_n ELSE greatest(1 - coalesce(pct, 0.9e0), 1 / pop_n) END"


@query("P11_emit", f"""SELECT metric_id, subject_id, lens, round(interest, 6) AS interest FROM (SELECT *, {SURPRISE_SQL} AS interest FROM (SELECT *, {P11_TAIL} AS tail_p, 9e0 AS search_space FROM {BEST_SQL})) WHERE interest >= 0.25e0 AND NOT (lens = 'rank' AND subject_id % 2 = 0)""")
def p11(t):
    """Best hits scored by their surprise; those of even subjects found by rank were written earlier."""
    ids = X.finding_id({"detector": F.lit("scan"), "metric": c("metric_id"), "subject": c("subject_id"), "year": c("year"), "as_of": F.current_date().cast("string")})
    tail = F.when(c("lens") == "rank", c("rank") / c("pop_n")).otherwise(F.greatest(1.0 - F.coalesce("pct", F.lit(0.9)), 1.0 / c("pop_n")))
    raw, search = I.evidence_bits(tail, F.lit(9.0))
    found = best_hits(t).withColumn("interest", I.surprise(raw, search)).withColumn("finding_id", ids)
    earlier = found.where("lens = 'rank' AND subject_id % 2 = 0").select("finding_id")
    return S.emit(found, earlier, focal(t), "subject_id", I.EMIT_THRESHOLD).select("metric_id", "subject_id", "lens", X.r6("interest").alias("interest"))


# ---- interest ------------------------------------------------------------------
# Findings derived from every customer season; each column stands for one fact.
CAND_SQL = """(SELECT subject_id, year, CASE subject_id % 6 WHEN 0 THEN 'scan' WHEN 1 THEN 'milestone_watch' WHEN 2 THEN 'on_this_day' WHEN 3 THEN 'hit_streak' WHEN 4 THEN 'deadline_history' ELSE 'nl_west_race' END AS detector, n, hr, price_c, team,
 (price_c % 500 + 1) / 500e0 AS tail_p, 1e0 + price_c % 9 AS search_space, n % 12 + 1 AS franchise_rank, price_c % 40 / 1e0 AS gap, CASE WHEN subject_id % 6 = 3 THEN hr + 4 END AS streak, CASE WHEN subject_id % 6 = 5 THEN price_c % 20 / 1e0 END AS games_back,
 CASE WHEN subject_id % 3 = 0 THEN year - CAST(price_c % 8 AS INTEGER) END AS anchor, n % 3 + 1 AS members, name || ' leads and ' || n || ' and ' || hr || repeat(' more', CAST(price_c % 25 AS INTEGER)) AS headline FROM @seasons)"""


def cands(t):
    s, p = c("subject_id"), c("price_c")
    det = F.when(s % 6 == 0, "scan").when(s % 6 == 1, "milestone_watch").when(s % 6 == 2, "on_this_day").when(s % 6 == 3, "hit_streak").when(s % 6 == 4, "deadline_history").otherwise("nl_west_race")
    return t.seasons.select(
        "subject_id", "year", det.alias("detector"), "n", "hr", "price_c", "team", ((p % 500 + 1) / 500.0).alias("tail_p"), (1.0 + p % 9).alias("search_space"), (c("n") % 12 + 1).alias("franchise_rank"),
        (p % 40 / 1.0).alias("gap"), F.when(s % 6 == 3, c("hr") + 4).alias("streak"), F.when(s % 6 == 5, p % 20 / 1.0).alias("games_back"),
        F.when(s % 3 == 0, c("year") - (p % 8).cast("int")).alias("anchor"), (c("n") % 3 + 1).alias("members"),
        F.concat("name", F.lit(" leads and "), c("n").cast("string"), F.lit(" and "), c("hr").cast("string"), F.repeat(F.lit(" more"), (p % 25).cast("int"))).alias("headline"))


STAKES_SQL = "greatest(CASE WHEN franchise_rank = 1 THEN 0.95e0 WHEN franchise_rank <= 10 THEN least(0.95e0, greatest(0.3e0, 0.95e0 - 0.08e0 * (franchise_rank - 1))) ELSE 0e0 END, CASE WHEN detector = 'milestone_watch' AND greatest(0e0, 1 - gap / 25e0) > 0.5e0 THEN 0.55e0 + 0.4e0 * greatest(0e0, 1 - gap / 25e0) ELSE 0e0 END, CASE WHEN hr <= 3 AND detector = 'scan' THEN 0.75e0 ELSE 0e0 END, coalesce(least(1e0, greatest(0e0, 1 - games_back / 15e0)), 0e0))"
OCC_SQL = "CASE WHEN streak IS NOT NULL THEN least(0.9e0, greatest(0e0, 0.35e0 + streak / 40e0)) WHEN detector = 'on_this_day' THEN 0.45e0 WHEN detector = 'deadline_history' THEN 0.55e0 ELSE 0e0 END"
TEN_SQL = "CASE WHEN n % 5 = 0 THEN 0.85e0 WHEN n % 5 = 1 THEN 0.8e0 WHEN n % 5 = 2 THEN 0.75e0 ELSE 0e0 END"
LEG_SQL = "least(1e0, greatest(0.1e0, 1 - 0.22e0 * greatest(members - 1, 0) - 0.08e0 * greatest((length(headline) - length(replace(lower(headline), ' and ', ''))) / 5 - 1, 0) - CASE WHEN length(headline) > 120 THEN 0.15e0 ELSE 0e0 END))"
SINCE_SQL = "CASE WHEN anchor IS NULL OR year - anchor >= 5 THEN 1e0 ELSE least(1e0, greatest(0.15e0, (year - anchor) / 5e0)) END"


def parts(t):
    none = F.lit(None).cast("double")
    raw, search = I.evidence_bits(c("tail_p"), c("search_space"))
    club = F.when(c("detector") == "scan", c("hr"))
    return cands(t).withColumns({
        "surprise": I.surprise(raw, search),
        "stakes": I.stakes(F.lit(""), c("franchise_rank"), none, c("gap"), c("detector") == "milestone_watch", club, c("games_back")),
        "tension": I.tension(c("n") % 5 == 0, c("n") % 5 == 1, c("n") % 5 == 2),
        "occasion": I.occasion(c("detector"), c("streak")), "legibility": I.legibility(c("headline"), c("members")), "since": I.since_factor(c("year"), c("anchor"))})


PARTS_SQL = f"(SELECT *, {SURPRISE_SQL} AS surprise, {STAKES_SQL} AS stakes, {TEN_SQL} AS tension, {OCC_SQL} AS occasion, {LEG_SQL} AS legibility, {SINCE_SQL} AS since FROM {CAND_SQL})"
SCORE_SQL = f"""(SELECT *, least(1e0, greatest(0e0, (r[1] + (1 - r[1]) * 0.35e0 * r[2]) * (0.55e0 + 0.45e0 * legibility) * since * CASE WHEN unchanged THEN 0.25e0 ELSE 1e0 END)) AS score FROM (SELECT *, list_reverse_sort([surprise, stakes, tension, occasion]) AS r, row_number() OVER (PARTITION BY subject_id, n ORDER BY year) > 1 AS unchanged FROM {PARTS_SQL}))"""


def scored(t):
    p = parts(t).withColumn("claim", F.concat_ws("|", c("subject_id").cast("string"), c("n").cast("string")))
    p = I.unchanged_repeat(p, "claim", ["year"])
    return p.withColumn("score", I.interest(c("surprise"), c("stakes"), c("tension"), c("occasion"), c("legibility"), c("since"), c("unchanged")))


@query("I1_interest_score", f"SELECT subject_id, year, round(score, 6) AS score FROM {SCORE_SQL}")
def i1(t):
    return scored(t).select("subject_id", "year", X.r6("score").alias("score"))


@query("I2_shape_scores", f"""SELECT subject_id, year, round(CASE n % 4 WHEN 0 THEN -log2(greatest(franchise_rank / 500e0, 1e-9)) WHEN 1 THEN -log2(greatest(tail_p, 1 / 200e0)) WHEN 2 THEN -log2(greatest((1 - {confidence_sql('(gap / 10)')}) / 2, 1e-9)) ELSE log2(greatest(26, 2)) END, 4) AS raw_bits,
 round(CASE n % 4 WHEN 0 THEN log2(factorial(9) / (factorial(CAST(members AS INTEGER)) * factorial(CAST(9 - members AS INTEGER)))) ELSE log2(9e0) END, 6) AS search_bits FROM {CAND_SQL}""")
def i2(t):
    n = c("n") % 4
    conj, ext = I.conjunction_bits(c("franchise_rank"), F.lit(500.0), c("members")), I.percentile_bits((1 - c("tail_p")) * 100, F.lit(200.0))
    con, mx = I.contrast_bits(c("gap") / 10, F.lit(None).cast("double"), F.lit(150.0)), I.roster_max_bits(F.lit(26))
    pick = lambda i: F.when(n == 0, conj[i]).when(n == 1, ext[i]).when(n == 2, con[i]).otherwise(mx[i])
    return cands(t).select("subject_id", "year", X.rnd(pick(0), 4).alias("raw_bits"), X.r6(pick(1)).alias("search_bits"))


@query("I3_stakes_occasion_tension_legibility", f"SELECT subject_id, year, round(stakes, 6) AS stakes, round(occasion, 6) AS occasion, round(tension, 6) AS tension, round(legibility, 6) AS legibility FROM {PARTS_SQL}")
def i3(t):
    return parts(t).select("subject_id", "year", *[X.r6(k).alias(k) for k in ("stakes", "occasion", "tension", "legibility")])


@query("I4_verdict_band", f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN s >= 0.7e0 THEN 'strong' WHEN s >= 0.5e0 THEN 'ok' WHEN s >= 0.35e0 THEN 'thin' ELSE 'boring' END AS band FROM (SELECT round(score, 6) AS s FROM {SCORE_SQL})) GROUP BY 1")
def i4(t):
    return scored(t).groupBy(I.verdict_band(X.r6("score")).alias("band")).agg(F.count("*").alias("n"))


@query("I5_first_since_penalty", f"SELECT subject_id, year, round({SINCE_SQL}, 6) AS factor FROM {CAND_SQL} WHERE anchor IS NOT NULL")
def i5(t):
    return cands(t).where("anchor IS NOT NULL").select("subject_id", "year", X.r6(I.since_factor(c("year"), c("anchor"))).alias("factor"))


@query("I6_unchanged_repeat", "SELECT subject_id, year, row_number() OVER (PARTITION BY subject_id, n ORDER BY year) > 1 AS unchanged FROM @seasons")
def i6(t):
    s = t.seasons.withColumn("claim", F.concat_ws("|", c("subject_id").cast("string"), c("n").cast("string")))
    return I.unchanged_repeat(s, "claim", ["year"]).select("subject_id", "year", "unchanged")


@query("I7_weighted_novelty", f"SELECT subject_id, year, round(least(1e0, greatest(0e0, 0.3e0 * (1 - tail_p) + 0.2e0 * stakes + 0.2e0 * occasion + 0.2e0 * tension + 0.1e0 * legibility + CASE WHEN detector = 'on_this_day' THEN 0.05e0 ELSE 0e0 END)), 6) AS novelty FROM {PARTS_SQL}")
def i7(t):
    comp = {"rarity": 1 - c("tail_p"), "magnitude": c("stakes"), "timeliness": c("occasion"), "rootability": c("tension"), "legibility": c("legibility")}
    return parts(t).select("subject_id", "year", X.r6(I.weighted_novelty(comp, c("detector"))).alias("novelty"))


def board_rows(t):
    s = scored(t)
    ident = F.concat_ws("-", c("detector"), c("subject_id").cast("string"), c("year").cast("string"))
    who = F.when(c("subject_id") % 11 == 0, "").otherwise(c("team").cast("string"))
    prior = 1.0 + (c("n") % 3) * 0.05
    return s.select(ident.alias("id"), "detector", who.alias("subject"), X.r6("score").alias("score"), X.r6(c("score") * prior).alias("rank_value"))


def board_sql(explore: int) -> str:
    """The plain greedy walk, row by row, over all eligible findings."""
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT detector || '-' || subject_id || '-' || year AS id, detector, CASE WHEN subject_id % 11 = 0 THEN '' ELSE team::VARCHAR END AS subject, round(score, 6) AS score, round(score * (1 + (n % 3) * 0.05e0), 6) AS rank_value FROM {SCORE_SQL}),
 e AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) <= {explore} AS INTEGER) AS explored FROM b WHERE score >= 0.35e0),
 o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY explored DESC, rank_value DESC, id) AS i FROM e),
 w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS slot, CAST([] AS VARCHAR[]) AS ds, CAST([] AS VARCHAR[]) AS ss, false AS took
  UNION ALL SELECT i, slot + CAST(ok AS BIGINT), CASE WHEN ok THEN list_append(ds, detector) ELSE ds END, CASE WHEN ok THEN list_append(ss, subject) ELSE ss END, ok
  FROM (SELECT o.i, w.slot, w.ds, w.ss, o.detector, o.subject, len(list_filter(w.ds, lambda x: x = o.detector)) < 3 AND (o.subject = '' OR len(list_filter(w.ss, lambda x: x = o.subject)) < 2) AS ok FROM w JOIN o ON o.i = w.i + 1 WHERE w.slot < 12))
 SELECT slot, id, detector, subject, score, rank_value, explored FROM w JOIN o USING (i) WHERE took"""


@query("T6_diversity_capped_topk", board_sql(0))
def t6(t):
    return I.diversity_board(board_rows(t))


@query("B4_diversity_board", board_sql(2))
def b4(t):
    return I.diversity_board(board_rows(t), exploration=2)
