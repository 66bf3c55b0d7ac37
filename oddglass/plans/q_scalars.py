"""Registered queries: scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators.joins import attach_row
from .registry import query

ERF_SQL = (
    "(1 - (((((1.061405429e0 * T + -1.453152027e0) * T + 1.421413741e0) * T + -0.284496736e0) * T + 0.254829592e0) * T)"
    " * exp(-(ABS_X) * (ABS_X)))"
)


def erf_sql(x: str) -> str:
    """The same error-function polynomial as SQL text, for ``x >= 0``."""
    t = f"(1 / (1 + 0.3275911e0 * ({x})))"
    return ERF_SQL.replace("ABS_X", x).replace("T", t)


def confidence_sql(z: str) -> str:
    return erf_sql(f"(abs({z}) / 1.4142135623730951e0)")


@query("X1_fmt_name", """
SELECT c_custkey AS subject_id, CASE WHEN contains(raw, ',') THEN trim(substr(raw, instr(raw, ',') + 1)) || ' ' || trim(substr(raw, 1, instr(raw, ',') - 1)) ELSE trim(raw) END AS name
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || ', ' || c_name END AS raw FROM customer)""")
def x1(t):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat_ws(", ", "c_mktsegment", "c_name"))
    return t.customer.select(F.col("c_custkey").alias("subject_id"), X.display_name(raw).alias("name"))


@query("X2_ordinal", """
SELECT n, n::VARCHAR || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS label, count(*) AS rows
FROM (SELECT o_custkey AS n FROM orders) GROUP BY 1""")
def x2(t):
    n = F.col("o_custkey").alias("n")
    return t.orders.groupBy(n).agg(F.count(F.lit(1)).alias("rows")).select("n", X.ordinal_label(F.col("n")).alias("label"), "rows")


@query("X3_innings_to_outs", """
SELECT subject_id, CAST(sum(CAST(split_part(ip, '.', 1) AS BIGINT) * 3 + CAST(split_part(ip, '.', 2) AS BIGINT)) AS BIGINT) AS outs
FROM (SELECT l_suppkey AS subject_id, CAST(l_quantity AS INTEGER)::VARCHAR || '.' || (l_linenumber % 3)::VARCHAR AS ip FROM lineitem) GROUP BY 1""")
def x3(t):
    ip = F.concat_ws(".", F.col("l_quantity").cast("int").cast("string"), (F.col("l_linenumber") % 3).cast("string"))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("subject_id")).agg(F.sum(X.innings_to_outs(ip)).alias("outs"))


@query("X4_text_rate_cast", """
SELECT user_id, count(*) AS n, count(rate) AS readable, round(CAST(sum(rate) AS DOUBLE), 2) AS total
FROM (SELECT user_id, try_cast(CASE WHEN event_type = 'error' THEN '-.--' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS rate FROM @live) GROUP BY 1""")
def x4(t):
    text = F.when(F.col("event_type") == "error", "-.--").otherwise(F.get_json_object("props", "$.k"))
    return (
        t.live.select("user_id", X.text_rate(text).alias("rate")).groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("rate").alias("readable"), X.rnd(F.sum("rate"), 2).alias("total"))
    )


@query("X5_regress_reliability_tier", """
SELECT subject_id, year, round((pa * woba + 220 * m) / (pa + 220), 6) AS regressed, round(pa / (pa + 220), 6) AS reliability,
  CASE WHEN pa / (pa + 220) >= 0.7e0 THEN 'high' WHEN pa / (pa + 220) >= 0.45e0 THEN 'moderate' ELSE 'low' END AS tier
FROM @stats s JOIN (SELECT season AS y, CAST(sum(disc_c) AS BIGINT) * 0.064e0 / count(*) AS m FROM @pitches GROUP BY 1) ON y = year""")
def x5(t):
    means = t.pitches.groupBy(F.col("season").alias("year")).agg((F.sum("disc_c") * 0.064 / F.count(F.lit(1))).alias("m"))
    rel = X.reliability(F.col("pa"))
    return t.stats.join(means, "year").select(
        "subject_id", "year", X.r6(X.regress(F.col("woba"), F.col("pa"), F.col("m"))).alias("regressed"),
        X.r6(rel).alias("reliability"), X.reliability_tier(rel).alias("tier"),
    )


LEDGER_SQL = """
SELECT c_nationkey AS team, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN c ELSE 0 END) AS BIGINT) AS runs_for, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN c ELSE 0 END) AS BIGINT) AS runs_against
FROM (SELECT o_custkey, o_orderstatus, CAST(floor(o_totalprice * 100 + 0.5e0) AS BIGINT) AS c FROM orders) JOIN customer ON c_custkey = o_custkey GROUP BY 1"""


@query("X6_pythagorean", f"""
SELECT team, runs_for, runs_against, round(pow(runs_for, 1.83e0) / (pow(runs_for, 1.83e0) + pow(runs_against, 1.83e0)), 6) AS expected_pct FROM ({LEDGER_SQL})""")
def x6(t):
    c = F.floor(F.col("o_totalprice") * 100 + 0.5)
    led = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("team")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", c).otherwise(0)).alias("runs_for"),
        F.sum(F.when(F.col("o_orderstatus") == "O", c).otherwise(0)).alias("runs_against"),
    )
    return led.withColumn("expected_pct", X.r6(X.pythagorean(F.col("runs_for").cast("double"), F.col("runs_against").cast("double"))))


@query("X7_normal_cdf", f"""
SELECT subject_id, year, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN 0.5e0 + {confidence_sql('z')} / 2 ELSE 0.5e0 - {confidence_sql('z')} / 2 END, 6) AS phi
FROM (SELECT subject_id, year, (est_woba - woba) * 40 AS z FROM @stats)""")
def x7(t):
    return t.stats.select("subject_id", "year", ((F.col("est_woba") - F.col("woba")) * 40).alias("_z")).select(
        "subject_id", "year", X.r6(F.col("_z")).alias("z"), X.r6(X.normal_cdf(F.col("_z"))).alias("phi"))


PITCHING_SQL = """
SELECT subject_id, count(*) FILTER (zone = 5) AS hr, count(*) FILTER (zone = 11) AS bb, count(*) FILTER (zone = 14) AS hbp,
  count(*) FILTER (description = 'swinging_strike') AS k, count(*) AS outs, count(*) FILTER (zone IN (4, 5, 6)) AS er FROM @pitches GROUP BY 1"""


def pitching(t):
    n = lambda c: F.count_if(c)
    z = F.col("zone")
    return t.pitches.groupBy("subject_id").agg(
        n(z == 5).alias("hr"), n(z == 11).alias("bb"), n(z == 14).alias("hbp"),
        n(F.col("description") == "swinging_strike").alias("k"), F.count(F.lit(1)).alias("outs"), n(z.isin(4, 5, 6)).alias("er"),
    )


@query("X8_fip", f"""
SELECT subject_id, round((13 * hr + 3 * (bb + hbp) - 2 * k) / (outs / 3e0) + 3.1e0, 6) AS fip FROM ({PITCHING_SQL})""")
def x8(t):
    c = F.col
    return pitching(t).select("subject_id", X.r6(X.fip(c("hr"), c("bb"), c("hbp"), c("k"), c("outs") / 3.0, F.lit(3.1))).alias("fip"))


@query("X9_field_xy_inches", """
SELECT vec_id, round((hx - 125.42e0) * 2.5e0, 6) AS x, round((198.27e0 - hy) * 2.5e0, 6) AS y, round(z * 12, 6) AS brk
FROM (SELECT vec_id, 125 + x * 250 AS hx, 150 + y * 100 AS hy, z FROM @points)""")
def x9(t):
    return t.points.select(
        "vec_id", X.r6(X.field_x(125 + F.col("x") * 250)).alias("x"), X.r6(X.field_y(150 + F.col("y") * 100)).alias("y"),
        X.r6(X.inches(F.col("z"))).alias("brk"))


@query("X10_pitch_family_hit_kind", """
SELECT CASE WHEN pitch_type IN ('FF','FA','FT','SI','FC') THEN 'fastball' WHEN pitch_type IN ('SL','ST','SV','CU','KC','CS','SC','Sla','KN') THEN 'breaking' WHEN pitch_type IN ('CH','FS','FO','EP') THEN 'offspeed' ELSE 'other' END AS family,
  CASE seq WHEN 1 THEN 'single' WHEN 2 THEN 'double' WHEN 3 THEN 'triple' WHEN 4 THEN 'hr' ELSE 'out' END AS kind, count(*) AS n FROM @pitches GROUP BY 1, 2""")
def x10(t):
    s = F.col("seq")
    event = F.when(s == 1, "single").when(s == 2, "double").when(s == 3, "triple").when(s == 4, "home_run").otherwise("field_out")
    return t.pitches.groupBy(X.pitch_family(F.col("pitch_type")).alias("family"), X.hit_kind(event).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


REGION_SQL = "CASE WHEN r <= 0.67e0 THEN 'heart' WHEN r <= 1.33e0 THEN 'shadow' WHEN r <= 2 THEN 'chase' ELSE 'waste' END"


@query("X11_attack_region_zone_cell", f"""
SELECT region, col, row, count(*) AS n FROM (
  SELECT {REGION_SQL} AS region,
    CASE WHEN inz THEN CAST(least(floor((0.83e0 - plate_x) / (1.66e0 / 3)), 2) AS INTEGER) END AS col, CASE WHEN inz THEN CAST(least(floor((3.5e0 - plate_z) / (2e0 / 3)), 2) AS INTEGER) END AS row
  FROM (SELECT plate_x, plate_z, greatest(abs(plate_x) / 0.83e0, abs(plate_z - 2.5e0)) AS r, plate_x BETWEEN -0.83e0 AND 0.83e0 AND plate_z BETWEEN 1.5e0 AND 3.5e0 AS inz FROM @pitches)) GROUP BY 1, 2, 3""")
def x11(t):
    x, z = F.col("plate_x"), F.col("plate_z")
    inside = X.in_zone(x, z)
    return t.pitches.groupBy(
        X.attack_region(x, z).alias("region"), F.when(inside, X.zone_column(x)).alias("col"), F.when(inside, X.zone_row(z)).alias("row")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("X12_surprisal_bits", """
SELECT event_type, n, round(-log2(greatest(n / tot, 1e-9)), 6) AS bits, round(log2(factorial(9) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(9 - k AS INTEGER)))), 6) AS search_bits
FROM (SELECT event_type, count(*) AS n, count(*) % 8 + 1 AS k, (SELECT count(*) FROM @live) AS tot FROM @live GROUP BY 1)""")
def x12(t):
    per = t.live.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("tot"))
    return attach_row(per, tot).select(
        "event_type", "n", X.r6(X.surprisal_bits(F.col("n") / F.col("tot"))).alias("bits"),
        X.r6(X.choose_bits(9, F.col("n") % 8 + 1)).alias("search_bits"))


@query("X13_decay", """
SELECT event_id, age, round(pow(0.5e0, age / 45e0), 6) AS half_life, round(1 - least(age * 0.02e0, 0.8e0), 6) AS linear
FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-03-01') AS age FROM @live)""")
def x13(t):
    age = X.days_between(F.lit("2024-03-01").cast("date"), F.col("ts").cast("date"))
    return t.live.select("event_id", age.alias("age")).select(
        "event_id", "age", X.r6(X.half_life_weight(F.col("age"), 45.0)).alias("half_life"), X.r6(X.linear_decay(F.col("age"))).alias("linear"))


@query("X14_stable_id", """
SELECT substr(sha256('{"detector":"season","subject":' || subject_id || ',"year":' || year || '}'), 1, 16) AS id, subject_id, year FROM @seasons""")
def x14(t):
    return t.seasons.select(
        X.finding_id({"year": F.col("year"), "subtitle": F.col("name"), "subject": F.col("subject_id"), "detector": F.lit("season"), "as_of": F.col("n")}).alias("id"), "subject_id", "year")


@query("X15_claim_key", """
SELECT sha256('[{"key":"n","value":"' || n || '"},{"key":"subject","value":"' || subject_id || '"}]') AS claim, count(*) AS repeats FROM @seasons GROUP BY 1""")
def x15(t):
    facts = F.create_map(
        F.lit("subject"), F.col("subject_id").cast("string"), F.lit("n"), F.col("n").cast("string"), F.lit("as_of"), F.col("year").cast("string"))
    return t.seasons.groupBy(X.claim_key(facts, ("as_of",)).alias("claim")).agg(F.count(F.lit(1)).alias("repeats"))


STAT_COLUMNS = ("woba", "est_woba", "sprint_speed", "exit_velocity", "brl_percent", "hard_hit_percent", "k_percent", "whiff_percent", "chase_percent")
FAMILY_SQL = """CASE WHEN regexp_matches(M, 'gap_woba|gap_|_gap|era_fip|woba_minus') THEN 'luck_residual' WHEN regexp_matches(M, 'xba|xslg|xwoba|est_woba|xiso|xera') THEN 'expected_outcome'
 WHEN regexp_matches(M, 'exit_velocity|max_ev|hard_hit|barrel|brl|sweet_spot') THEN 'contact_quality' WHEN regexp_matches(M, 'bat_speed|swing_length|squared_up|blast') THEN 'swing'
 WHEN regexp_matches(M, 'chase|whiff|k_percent|bb_percent|zone_contact|swing_rate') THEN 'discipline' WHEN regexp_matches(M, 'sprint_speed|baserunning|steal') THEN 'speed' ELSE metric END"""


def family_sql(m: str) -> str:
    return FAMILY_SQL.replace("M,", f"lower(split_part({m}, '__', 1)),").replace("ELSE metric", f"ELSE {m}")


@query("X16_metric_family", f"""
SELECT metric, {family_sql('metric')} AS family, {family_sql('metric')} <> 'luck_residual' AS skill, count(*) AS n
FROM (UNPIVOT (SELECT woba AS woba_minus, {', '.join(STAT_COLUMNS)} FROM @stats) ON * INTO NAME metric VALUE v) GROUP BY 1""")
def x16(t):
    wide = t.stats.select(F.col("woba").alias("woba_minus"), *STAT_COLUMNS)
    long = wide.unpivot([], ["woba_minus", *STAT_COLUMNS], "metric", "v").where("v IS NOT NULL")
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).select(
        "metric", X.metric_family(F.col("metric")).alias("family"), X.is_skill(F.col("metric")).alias("skill"), "n")


@query("X17_coverage_phrase", """
SELECT tag, CASE WHEN tag = 'since_2015' THEN 'in the Statcast era (since 2015)' WHEN starts_with(tag, 'since_') THEN 'since ' || substr(tag, 7) ELSE replace(tag, '_', ' ') END AS phrase,
  count(*) AS n, ltrim(printf('%.3f', round(sum(hr) / sum(n0), 3)), '0') AS shown
FROM (SELECT CASE WHEN subject_id % 2 = 0 THEN 'since_' || year ELSE 'season_' || year END AS tag, hr, n AS n0 FROM @seasons) GROUP BY 1""")
def x17(t):
    tag = F.concat(F.when(F.col("subject_id") % 2 == 0, "since_").otherwise("season_"), F.col("year").cast("string"))
    got = t.seasons.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"), X.rnd(F.sum("hr") / F.sum("n"), 3).alias("v"))
    return got.select("tag", X.coverage_phrase(F.col("tag")).alias("phrase"), "n", X.format_number(F.col("v").cast("string"), "avg").alias("shown"))


# Scale anchors (metric, average, elite, higher is better).
SCALE_ANCHORS = (("hard_hit_percent", 40.0, 50.0, True), ("chase_percent", 28.0, 22.0, False), ("k_percent", 22.0, 16.0, False))


@query("X18_glossary_tier", """
SELECT metric, subject_id, year, CASE WHEN v * s >= e * s THEN 'elite' WHEN v * s >= (a * s + e * s) / 2 THEN 'above average' WHEN v * s >= a * s THEN 'roughly average' ELSE 'below average' END AS tier
FROM (UNPIVOT (SELECT subject_id, year, hard_hit_percent, chase_percent, k_percent FROM @stats) ON hard_hit_percent, chase_percent, k_percent INTO NAME metric VALUE v)
JOIN (VALUES ('hard_hit_percent', 40e0, 50e0, 1e0), ('chase_percent', 28e0, 22e0, -1e0), ('k_percent', 22e0, 16e0, -1e0)) k(m, a, e, s) ON m = metric""")
def x18(t):
    anchors = t.spark.createDataFrame(SCALE_ANCHORS, "metric string, average double, elite double, higher boolean")
    cols = [a[0] for a in SCALE_ANCHORS]
    long = t.stats.unpivot(["subject_id", "year"], cols, "metric", "v").where("v IS NOT NULL")
    c = F.col
    return long.join(F.broadcast(anchors), "metric").select(  # three anchor rows
        "metric", "subject_id", "year", X.scale_tier(c("v"), c("average"), c("elite"), c("higher")).alias("tier"))


@query("X19_date_parts", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, count(*) AS n,
  CAST(max(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')) AS INTEGER) AS age FROM orders GROUP BY 1, 2, 3""")
def x19(t):
    d = F.col("o_orderdate")
    return t.orders.groupBy(F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(X.days_between(F.lit("2002-01-01").cast("date"), d.cast("date"))).alias("age"))


@query("X20_json_access", """
SELECT event_id, CAST(coalesce(json_extract_string(props, '$.player_id'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM @live""")
def x20(t):
    return t.live.select("event_id", X.first_json_value(F.col("props"), ["$.player_id", "$.k"]).cast("bigint").alias("k"))


@query("X21_numeric_tokens", r"""
SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d+(?:\.\d+)?\b|\.\d+\b')) AS token FROM documents) GROUP BY 1, 2""")
def x21(t):
    return t.documents.select("doc_id", F.explode(X.number_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query("X22_posting_score", """
SELECT user_id, likes * 1e0 + coalesce(reposts, 0) * 2e0 + bookmarks * 1.5e0 + follows * 6e0 AS score
FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS likes, nullif(count(*) FILTER (event_type = 'click'), 0) AS reposts, count(*) FILTER (event_type = 'purchase') AS bookmarks, count(*) FILTER (event_type = 'signup') AS follows FROM @live GROUP BY 1)""")
def x22(t):
    n = lambda e: F.count_if(F.col("event_type") == e)
    per = t.live.groupBy("user_id").agg(
        n("view").alias("likes"), F.nullif(n("click"), F.lit(0)).alias("reposts"), n("purchase").alias("bookmarks"), n("signup").alias("follows"))
    return per.select("user_id", X.posting_score({k: F.col(k) for k in X.POST_WEIGHTS}).alias("score"))
