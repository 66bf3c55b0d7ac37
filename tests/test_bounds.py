"""Hot keys, many metrics, long tokens: nothing is cut off and nothing meets in one task."""

from __future__ import annotations

import itertools
import os
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import oddglass
from oddglass.functions import scalars as X
from oddglass.operators import audit, hypothesis as H, lenses as L, ordering as O, scan, scope
from oddglass.operators.spatial import rolling_mean


def test_long_number_tokens_and_tags_are_compared_whole(spark):
    long = "0." + "7" * 1500
    df = spark.createDataFrame([(1, f"at {long}1", f"at {long}2"), (2, f"at {long}", f"at {long[1:]}")], "id int, text string, facts string")
    assert [r.id for r in audit.digit_audit(df, "id", "text", "facts").collect()] == [1]
    tag = "since_" + "x" * 1200
    assert spark.createDataFrame([(tag,)], "s string").select(X.coverage_phrase(F.col("s")).alias("p")).first().p == "since " + "x" * 1200


def test_a_subject_with_half_of_all_rows(spark):
    r = np.random.default_rng(4)
    n = 3000
    p = pd.DataFrame({"s": np.where(np.arange(n) % 2 == 0, 0, np.arange(n) % 30), "t": r.permutation(n), "v": r.integers(0, 100, n)})
    df = spark.createDataFrame(p)
    got = rolling_mean(df, "s", ["t"], "v", one_in=7, most=8).toPandas()
    for s, g in got.groupby("s"):
        v = p[p.s == s].sort_values("t").v.to_numpy()
        w = int(g.w.iloc[0])
        want = [v[i - w + 1:i + 1].mean() for i in range(w - 1, len(v))]
        assert np.allclose(g.sort_values("x").y, want)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_stand_on_an_exchange_by_key_and_bucket(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1000).selectExpr("id % 5 AS s", "id AS t", "id % 17 AS v")
        plan = plan_of(O.running_totals(df, ["s"], ["t"], {"x": "v"}))
        assert re.search(r"Exchange hashpartitioning\(s#\d+L, _b#\d+", plan)
        assert "BroadcastExchange" not in plan
        alone = plan_of(O.running_totals(df, [], ["t"], {"x": "v"}))
        assert not re.search(r"Window \[row_number", alone)  # picked rows are cut down by a bounded sort, not numbered in one task
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_peers_with_twelve_metrics(spark):
    r = random.Random(3)
    metrics = [f"m{k:02d}" for k in range(12)]
    value = {(m, s): r.random() for m in metrics for s in range(60) if r.random() < 0.9}
    rows = spark.createDataFrame([(m, 2000, s, v, True) for (m, s), v in value.items()], "metric_id string, year int, subject_id int, value double, higher boolean")
    combos = ["+".join(c) for c in itertools.combinations(metrics, 3)][::9]
    groups = spark.createDataFrame([(2000, c) for c in combos], "year int, metrics string")
    got = {x.metrics: (x.qualifying, x.population) for x in scope.conjunction_peers(groups, rows, ["year"], "subject_id", 0.6).collect()}
    cut = {m: np.quantile([v for (k, _), v in value.items() if k == m], 0.6) for m in metrics}
    for c in combos:
        own = c.split("+")
        have = [s for s in range(60) if all((m, s) in value for m in own)]
        assert got[c] == (sum(all(value[m, s] >= cut[m] for m in own) for s in have), len(have))


def test_boards_are_rows(spark):
    hits = spark.createDataFrame([("a", s, s / 10) for s in range(9)] + [("b", 1, 0.5)], "metric_id string, subject_id int, rarity double")
    rows = scan.collapse_boards(hits, ["metric_id"], "rarity", "subject_id", 3)
    assert [(r.place, r.subject_id, r.hits) for r in rows.orderBy("place").collect()] == [(k + 1, 8 - k, 9) for k in range(9)]
    top = scan.boards_of(rows, ["metric_id"], ["subject_id", "rarity"]).collect()
    assert [(r.metric_id, r.hits, r.subject_id) for r in top] == [("a", 9, 8)]


def test_specs_are_answered_by_their_lens(spark):
    df = spark.createDataFrame([(u, float(u), "2024-01-10") for u in range(40) for _ in range(12)], "user_id int, value double, day string").withColumn("day", F.col("day").cast("date"))
    specs = [H.Hypothesis("value", lens="rank", stabilization_n=12), H.Hypothesis("value", lens="extremeness", stabilization_n=12)]
    got = {r.metric_id: r.rarity for r in H.run_specs(df, specs, "user_id", "day", F.lit("2024-01-10").cast("date")).collect()}
    assert got[specs[0].spec_id] == 1.0 and got[specs[1].spec_id] < 1.0


def test_bulk_proposals_and_written_outcomes(spark, place):
    schema = spark.createDataFrame([("v", "double"), ("s", "string")], "column string, type string")
    asked = spark.createDataFrame([("v", "avg", "rank", 5), ("v", "avg", "rank", None), ("v", "avg", "rank", 500), ("s", "avg", "rank", 5), ("v", "median", "rank", 5), ("v;", "avg", "rank", 5), ("w", "avg", "rank", 5), (None, "avg", "rank", 5)], "column string, how string, lens string, window_days int")
    assert sorted(r.outcome for r in H.check_proposals(asked, schema).collect()) == ["invalid"] * 6 + ["runnable"] * 2
    assert H.check_proposals(asked, schema, windowed=False).where("outcome = 'unsupported_window'").count() == 1
    one = spark.createDataFrame([("a", "emitted"), ("b", "no_data")], "metric_id string, outcome string")
    for run in ("1", "2", "2"):
        H.record_outcomes(one if run == "1" else one.withColumn("outcome", F.lit("below_gate")), f"{place}/o", run)
    got = {r.metric_id: (r.runs, r.emitted, r.last_outcome) for r in H.outcome_summary(spark.read.parquet(f"{place}/o")).collect()}
    assert got == {"a": (2, 1, "below_gate"), "b": (2, 0, "below_gate")}


def test_means_of_moves_do_not_depend_on_order(spark):
    r = random.Random(1)
    moves = [r.uniform(-1, 1) for _ in range(2000)]
    found = {spark.createDataFrame([(m,) for m in r.sample(moves, len(moves))], "m double").repartition(k).agg(L.exact_mean(F.col("m")).alias("a")).first().a for k in (1, 3, 7)}
    assert len(found) == 1


def test_no_machine_local_scratch_folder():
    root = os.path.dirname(oddglass.__file__)
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "mkdtemp" not in f.read() and "localCheckpoint" not in name
