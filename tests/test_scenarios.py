"""Small scenarios with hand-computed results."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oddglass.functions import scalars as X
from oddglass.operators import audit as A
from oddglass.operators import contrast as C
from oddglass.operators import detectors as D
from oddglass.operators import interest as I
from oddglass.operators import joins as J
from oddglass.operators import learn as E
from oddglass.operators import lenses as L
from oddglass.operators import predict as Q
from oddglass.operators import rates as R
from oddglass.operators import scope as P
from oddglass.operators import spatial as V
from oddglass.operators import windows as W
from oddglass.plans.specs import discover_metrics, load_registry, metric_rows

c = F.col


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_chase_rate_and_empty_split(spark):
    rows = [(1, 12, "foul", "R", "FF")] * 120 + [(2, 12, "ball", "R", "FF")] * 120
    df = spark.createDataFrame(rows, "subject_id int, zone int, description string, hand string, pitch_type string").withColumn("hand", F.lit("O"))
    got = {r.subject_id: (r.value, r.n) for r in R.ratio_rate(df, R.CHASE_RATE, ["subject_id"]).collect()}
    assert got == {1: (100.0, 120), 2: (0.0, 120)}
    left = R.ratio_rate(df, R.CHASE_RATE, ["subject_id"], when=R.SplitSpec("p_throws", "L").predicate())
    assert left.count() == 0


def test_split_allow_list_and_coherence(spark):
    with pytest.raises(ValueError):
        R.SplitSpec("hand", "x' OR 1=1").predicate()
    assert not R.CHASE_RATE.accepts(R.SplitSpec("zone_bucket", "heart"))
    assert R.WHIFF_RATE.accepts(R.SplitSpec("zone_bucket", "heart"))


def test_one_sided_subjects_are_dropped(spark):
    rows = [(1, "F", "foul")] * 70 + [(1, "O", "foul")] * 70 + [(2, "F", "foul")] * 70
    df = spark.createDataFrame(rows, "subject_id int, hand string, description string")
    _n, a, b = R.CONTRAST_PAIRS[0]
    assert [r.subject_id for r in C.two_sides(df, R.SWING_RATE, a, b, ["subject_id"]).collect()] == [1]


def log(spark, rows):
    return spark.createDataFrame([(i, dt.date(2024, 5, d), ab, h) for i, d, ab, h in rows], "subject_id int, day date, ab int, hits int")


def test_hit_streak_ignores_games_without_at_bats(spark):
    nine = [(1, d, 4, 1) for d in range(1, 10)]
    assert W.active_run(log(spark, nine), "subject_id", "day", "ab", "hits").first().games == 9
    neutral = nine[:8] + [(1, 9, 0, 0)]
    assert W.active_run(log(spark, neutral), "subject_id", "day", "ab", "hits").first().games == 8
    broken = nine + [(1, 10, 4, 0)]
    assert W.active_run(log(spark, broken), "subject_id", "day", "ab", "hits").count() == 0


def test_skid_is_broken_by_a_recent_hit(spark):
    skid = [(1, 1, 4, 2)] + [(1, d, 3, 0) for d in range(2, 7)]
    got = W.active_run(log(spark, skid), "subject_id", "day", "ab", "hits", hitless=True).first()
    assert (got.games, got.ab) == (5, 15)
    assert W.active_run(log(spark, skid + [(1, 8, 4, 1)]), "subject_id", "day", "ab", "hits", hitless=True).count() == 0


def test_career_tiers(spark):
    df = spark.createDataFrame([("t", 1, 200, 2000), ("t", 2, 195, 2024), ("t", 3, 150, 2024), ("u", 4, 10, 2024)], "team string, subject_id int, hr int, last_year int")
    board = D.ladder(df, ["team"], "hr", "subject_id", 15)
    got = {r.subject_id: r.tier for r in D.career_chase(board, c("last_year") == 2024, F.lit(6)).collect()}
    assert got == {2: "chase", 3: "rank", 4: "record"}


def test_discovery_skips_meta_columns(spark):
    df = spark.createDataFrame([(1, "a", 2024, 88.0, 12.0, 100)], "player_id int, player_name string, year int, xwoba double, brl_percent double, pa int")
    assert [m.id for m in discover_metrics(df)] == ["pctl_xwoba", "pctl_brl_percent"]


def test_registry_lists_directions_and_rejects_unknown_lenses(tmp_path):
    reg = load_registry()
    assert {m.id: m.higher_is_better for m in reg.metrics}["k_percent"] is False
    bad = tmp_path / "m.toml"
    bad.write_text('[[metric]]\nid = "x"\nvalue = "x"\nlenses = ["crystal_ball"]\n')
    with pytest.raises(ValueError):
        load_registry(bad)


def scope(spark, history, higher=True):
    df = spark.createDataFrame(history, "team string, year int, subject_id int, v double")
    got = P.franchise_scope(df.where("year = 2024 and subject_id = 1"), df, "team", "year", "subject_id", "v", higher).first()
    return got.tier, got.anchor_period, got.anchor_id


def test_franchise_scope(spark):
    me = ("sd", 2024, 1, 22.5)
    assert scope(spark, [me]) == ("franchise_record", None, None)
    assert scope(spark, [me, ("sd", 2019, 2, 14.0)])[0] == "franchise_record"
    assert scope(spark, [me, ("sd", 2010, 2, 24.0), ("sd", 2019, 3, 14.0)]) == ("first_since", 2010, 2)
    # own earlier seasons and later seasons of others do not count
    assert scope(spark, [me, ("sd", 2020, 1, 30.0), ("sd", 2025, 3, 30.0)])[0] == "franchise_record"
    # lower is better: the anchor is compared by direction
    assert scope(spark, [("sd", 2024, 1, 2.0), ("sd", 2015, 2, 1.5), ("sd", 2020, 3, 3.0)], higher=False) == ("first_since", 2015, 2)


def test_matched_control_needs_a_control_to_fire(spark):
    def study(treated_up, control_up, with_control=True):
        pairs = [(100 + i, 40000, 300000, treated_up) for i in range(40)]
        if with_control:
            pairs += [(200 + i, 0, 300000, control_up) for i in range(40)]
        df = spark.createDataFrame(pairs, "subject_id int, gap_u long, level_u long, move double")
        probe = spark.createDataFrame([(1, 40000, 300000)], "subject_id int, gap_u long, level_u long")
        return L.matched_control(df, probe, "subject_id", gap_within=12000, level_within=20000, control_gap=5000).first()
    quiet = study(0.030, 0.029)
    assert (quiet.treated_n, quiet.control_n) == (40, 40) and quiet.net == pytest.approx(0.001)
    assert study(0.060, 0.010).net == pytest.approx(0.050)
    assert study(0.060, 0.010, with_control=False).control_n == 0


def test_own_seasons_are_left_out_of_the_cohort(spark):
    pairs = spark.createDataFrame([(1, 100, 100, 0.5), (2, 100, 100, 0.1)], "subject_id int, gap_u long, level_u long, move double")
    probe = spark.createDataFrame([(1, 100, 100)], "subject_id int, gap_u long, level_u long")
    got = L.matched_control(pairs, probe, "subject_id", gap_within=10, level_within=10, control_gap=200).first()
    assert got.treated_n == 1 and got.treated_mean == pytest.approx(0.1)


def test_games_back(spark):
    df = spark.createDataFrame([(1, "a", 50, 30), (1, "b", 47, 33), (1, "c", 40, 40)], "division int, team string, wins int, losses int")
    got = {r.team: (r.rank, r.games_back) for r in W.games_back(df, "division", "team", "wins", "losses").collect()}
    assert got == {"a": (1, 0.0), "b": (2, 3.0), "c": (3, 10.0)}


def test_text_scalars(spark):
    r = one(
        spark, a=X.display_name(F.lit("Tatis, Fernando")), b=X.ordinal_label(F.lit(111)), c=X.ordinal_label(F.lit(42)),
        d=X.innings_to_outs(F.lit("136.2")), e=X.innings_to_outs(F.lit("x")), f=X.text_rate(F.lit(".796")), g=X.text_rate(F.lit("-.--")),
        h=X.format_number(F.lit("0.394"), "avg"), i=X.coverage_phrase(F.lit("since_2015")), j=X.metric_family(F.lit("swing_rate__zone_bucket:heart")),
        k=X.field_x(F.lit(125.42)), l=X.field_y(F.lit(198.27)))
    assert tuple(r) == ("Fernando Tatis", "111th", "42nd", 410, 0, 0.796, None, ".394", "in the Statcast era (since 2015)", "discipline", 0.0, 0.0)


def test_normal_cdf(spark):
    import math
    df = spark.createDataFrame([(z / 4,) for z in range(-16, 17)], "z double").select("z", X.normal_cdf(c("z")).alias("p"))
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) < 2e-7 for r in df.collect())


@pytest.mark.parametrize("now,want", [(3.80, "correct"), (1.40, "incorrect"), (1.98, "push"), (None, "ungradeable")])
def test_prediction_outcomes(spark, now, want):
    assert one(spark, o=Q.outcome(F.lit(1.96), F.lit(4.49), F.lit(now).cast("double"), 0.10)).o == want


def test_undue_predictions_stay_open(spark):
    day = dt.date
    preds = spark.createDataFrame([(1, 1.96, 4.49, day(2024, 1, 1), "open"), (2, 1.96, 4.49, day(2025, 1, 1), "open")], "id int, baseline double, target double, resolves_by date, outcome string")
    now = spark.createDataFrame([(1, 3.8), (2, 3.8)], "id int, value double")
    got = {r.id: (r.outcome, r.resolved_value) for r in Q.grade(preds, now, ["id"], F.lit("2024-06-01").cast("date"), 0.10).collect()}
    assert got == {1: ("correct", 3.8), 2: ("open", None)}


def test_editorial_prior_floor_and_clamp(spark):
    day = dt.date(2024, 6, 1)
    obs = [(["loved"], True, day)] * 20 + [(["hated"], False, day)] * 20 + [(["rare"], True, day)] * 4
    df = spark.createDataFrame(obs, "features array<string>, positive boolean, observed_at date")
    got = {r.feature: r.multiplier for r in E.feature_stats(df, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {"loved": 1.25, "hated": 0.80, "rare": 1.0}
    old = E.feature_stats(df.limit(20), F.lit("2024-08-30").cast("date")).first()
    assert old.n_total == pytest.approx(10.0)  # one half-life


def panel(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], "target string, lens string, verdict string, failure_mode string, confidence double")


def test_referee_rules(spark):
    four = [(n, "PASS", None, 0.9) for n in ("causal", "coverage", "editor", "voice")]
    assert A.adjudicate(panel(spark, ("statistician", "BLOCK", "sample_too_small", 0.9), *four), "target").first().outcome == "blocked"
    unsure = A.adjudicate(panel(spark, ("causal", "PASS", None, 0.4), *four[1:]), "target").first()
    assert unsure.outcome == "blocked"
    assert A.adjudicate(panel(spark, ("editor", "PASS", None, 0.4)), "target").first().outcome == "cleared"
    assert A.adjudicate(panel(spark, ("editor", "REVISE", "sample_too_small", 0.9)), "target").first().contract_breaks == 1
    assert A.adjudicate(panel(spark, ("editor", "REVISE", "trivial", 0.9)), "target").first().outcome == "revise"


def test_crowded_conjunction_is_boring(spark):
    raw, search = I.conjunction_bits(F.lit(7), F.lit(182), F.lit(2))
    r = one(spark, crowded=I.crowded(F.lit(7), F.lit(182)), s=I.surprise(raw, search))
    assert r.crowded and r.s < 0.35


def test_interest_takes_the_best_route(spark):
    z = F.lit(0.0)
    r = one(spark, a=I.interest(z, F.lit(0.95), z, z, F.lit(1.0), F.lit(1.0), F.lit(False)), b=I.interest(F.lit(0.5), F.lit(0.95), z, z, F.lit(1.0), F.lit(1.0), F.lit(False)),
            r=I.interest(z, F.lit(0.95), z, z, F.lit(1.0), F.lit(1.0), F.lit(True)))
    assert r.a == pytest.approx(0.95) and r.b == pytest.approx(0.95 + 0.05 * 0.35 * 0.5) and r.r == pytest.approx(0.95 * 0.25)


def test_digit_audit_accepts_either_zero_form_and_catches_tampering(spark):
    df = spark.createDataFrame([(1, "hits .394 with 22 homers", '{"avg": 0.394, "hr": 22}'), (2, "hits 0.394 with 23 homers", '{"avg": ".394", "hr": 22}')], "id int, text string, facts string")
    assert [(r.id, r.token) for r in A.digit_audit(df, "id", "text", "facts").collect()] == [(2, "23")]


def test_scope_guard(spark):
    df = spark.createDataFrame([(1, "best this season", "best ever"), (2, "a franchise record", "best in franchise history")], "id int, framing string, caption string")
    assert [(r.id, r.phrase) for r in A.scope_upgrades(df, "id", "framing", "caption").collect()] == [(1, "ever")]


def test_reconcile_reports_only_what_is_beyond_tolerance(spark):
    a = spark.createDataFrame([(1, 0.300), (2, 0.310), (3, 0.320)], "id int, woba double")
    b = spark.createDataFrame([(1, 0.3005), (2, 0.315)], "id int, woba double")
    assert sorted(r.id for r in A.reconcile(a, b, ["id"], {"woba": 0.002}).collect()) == [2, 3]


def test_small_cells_are_null(spark):
    df = spark.createDataFrame([(0.0, 2.5, 1.0)] * 5 + [(-0.8, 3.4, 1.0)] * 4 + [(3.0, 2.5, 9.0)], "x double, z double, v double")
    got = {(r.col, r.row): (r.n, r.value) for r in V.grid_mean(df, [], c("x"), c("z"), c("v")).collect()}
    assert got == {(1, 1): (5, 1.0), (2, 0): (4, None)}


def test_bh_modes(spark):
    ps = [0.01, 0.039, 0.041, 0.045, 0.2]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "family string, id int, p double")
    keep = lambda mode: sorted(r.id for r in L.bh(df, ["family"], "p", ["id"], mode=mode).where("survives").collect())
    assert keep("per_rank") == [0]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.025, 0.026, 0.2])], "family string, id int, p double")
    assert keep("step_up") == [0, 1, 2]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.03, 0.031, 0.035, 0.2])], "family string, id int, p double")
    assert (keep("per_rank"), keep("step_up")) == ([2], [0, 1, 2])


def test_bh_feasibility(spark):
    r = one(spark, a=L.bh_feasible(F.lit(135), F.lit(46)), b=L.bh_feasible(F.lit(1000), F.lit(46)), e=L.expected_false(F.lit(46), 0.85))
    assert (r.a, r.b) == (False, True) and r.e == pytest.approx(6.9)


def test_pace_and_milestones(spark):
    df = spark.createDataFrame([(1, 20.0, 81), (2, 41.0, 150), (3, 5.0, 81), (4, 20.0, 9)], "id int, v double, g int")
    got = {r.id: r.rarity for r in L.pace(df, "v", "g", 162, 40.0).collect()}
    assert got == {1: 0.5, 2: 0.95}
    near = {r.id: r.rarity for r in L.milestone_proximity(df.where("id = 2"), "v", [41.0, 42.0, 50.0]).collect()}
    assert near[2] == pytest.approx(0.80 + 0.15 * (1 - (1 / 42) / 0.1))


def test_on_this_day_reads_leap_day_as_first_of_march(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2019, 3, 1),)], "d date")
    assert D.on_this_day(df, "d", 3, 1, 2023, leap_to_march=True).count() == 2
    assert D.on_this_day(df, "d", 3, 1, 2024, leap_to_march=True).count() == 1


def test_latest_and_best_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k int, at int, v string")
    assert {r.k: r.v for r in J.latest_per_key(df, ["k"], ["at"]).collect()} == {1: "b", 2: "c"}


def test_metric_rows_apply_filters_in_one_pass(spark):
    reg = load_registry()
    df = spark.createDataFrame([(1, 39, 50.0, 20.0, 5.0, 30.0, .3, .31), (2, 40, 51.0, 21.0, 6.0, 31.0, .3, .32)],
                               "subject_id int, pa int, exit_velocity double, sprint_speed double, brl_percent double, k_percent double, woba double, est_woba double")
    got = metric_rows(df, reg.metrics, ["subject_id"], populations=reg.populations).collect()
    assert {r.subject_id for r in got} == {2} and len(got) == 5
