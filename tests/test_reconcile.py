"""Selection at ranks, row-set digests, sums between cited ends, dated cohorts: against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from oddglass.operators import audit as A
from oddglass.operators import cohort as CO
from oddglass.operators import joins as J
from oddglass.operators import reconcile as RC
from oddglass.operators import selection as SEL
from oddglass.plans import catalog

c = F.col


@pytest.mark.parametrize("one_in, most", [(1, 4), (2, 64), (4096, 256)])
@pytest.mark.parametrize("descending", [False, True])
def test_values_at_ranks(spark, one_in, most, descending):
    r = random.Random(one_in)
    rows = [(r.choice(["a", "b"]), r.choice([None, 1.0, 2.5, 2.5, 7.0, float(r.randrange(60))])) for _ in range(500)] + [("c", 3.0)]
    asked = [(k, n) for k in ("a", "b", "c", "none") for n in (1, 2, 17, 100, 150, 10**7, 0, -3, None)] + [("a", 17)]
    got = SEL.values_at_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", spark.createDataFrame(asked, "k string, rank bigint"), descending=descending, one_in=one_in, most=most).collect()
    whole = {k: sorted((v for q, v in rows if q == k and v is not None), reverse=descending) for k in ("a", "b", "c", "none")}
    want = sorted(((k, n, whole[k][n - 1] if n and 1 <= n <= len(whole[k]) else None, len(whole[k]) or None) for k, n in asked), key=str)
    assert sorted(((x.k, x["rank"], x.at_rank, x.pop_n) for x in got), key=str) == want


def test_quantile_table_without_a_key(spark):
    r = random.Random(1)
    values = [float(r.randrange(40)) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts = SEL.quantile_table(df, [], "v", one_in=2, most=16).first().cuts
    order = sorted(values)
    assert cuts == [order[math.ceil(q * 333 / 100) - 1] for q in range(1, 100)]
    got = df.crossJoin(spark.createDataFrame([(cuts,)], "cuts array<double>")).select("v", SEL.percentile_from("cuts", "v").alias("p")).distinct().collect()
    for x in got:
        assert x.p == min(99, 100 * sum(v < x.v for v in values) // 333)


def test_drift_is_found_row_by_row(spark):
    cited = [(2000, t, t * 3, None if t == 4 else "n") for t in range(8)] + [(2001, t, t, "n") for t in range(8)] + [(2002, 1, 1, "n")] * 3
    drawn = [x for x in cited if x[:2] != (2000, 2)] + [(2000, 5, 15, "n"), (2003, 9, 9, "n")]
    drawn = [(2000, 6, 99, "n") if x[:2] == (2000, 6) else x for x in drawn]
    drawn.remove((2002, 1, 1, "n"))
    make = lambda rows: spark.createDataFrame(rows, "year int, team int, delta int, note string")
    got = RC.drift_rows(make(cited), make(drawn), ["year"], ["team", "delta", "note"], ["team"]).collect()
    assert {(x.year, x.team): (x.kind, x.cited, x.drawn) for x in got} == {
        (2000, 2): ("dropped", 1, 0), (2000, 5): ("doubled", 1, 2), (2000, 6): ("changed", 1, 1), (2002, 1): ("dropped", 3, 2), (2003, 9): ("added", 0, 1)}
    cols = ["team", "delta", "note"]
    off = RC.drifted(RC.digest(make(cited), ["year"], cols), make(drawn), ["year"], cols).collect()
    assert {(x.year, x.rows_cited, x.rows_now) for x in off} == {(2000, 8, 8), (2002, 3, 2), (2003, 0, 1)}
    shuffled = make(random.Random(2).sample(cited, len(cited)))
    assert RC.drifted(RC.digest(make(cited), ["year"], cols), shuffled, ["year"], cols).count() == 0


def test_sums_between_cited_ends(spark):
    r = random.Random(4)
    rows = [(u, d, r.randrange(9)) for u in range(5) for d in r.sample(range(50), 20 + u)]
    cited = [(u, w, a, z) for u in range(5) for w, (a, z) in {"x": (0, 6), "y": (7, 19), "one": (3, 3)}.items()]
    days = {u: sorted(d for k, d, _ in rows if k == u) for u in range(5)}
    named = [(u, w, days[u][a], days[u][z]) for u, w, a, z in cited] + [(0, "gone", 1000, days[0][3])]
    got = RC.sums_between(spark.createDataFrame(rows, "u int, d int, v bigint"), ["u"], ["d"], {"s": "v", "n": "1L"}, spark.createDataFrame(named, "u int, window string, first_d int, last_d int")).collect()
    for x in got:
        span = [(k, d, v) for k, d, v in rows if k == x.u and any(k == u and w == x.window and a <= d <= z for u, w, a, z in named)]
        assert (x.s, x.n) == ((None, None) if x.window == "gone" else (sum(v for *_, v in span), len(span)))
    ends = RC.cited_ends(spark.createDataFrame([(1, "w", 5, 2), (1, "w", 5, 1), (1, "w", 3, 9)], "u int, window string, d int, i int"), ["u"], ["d", "i"]).first()
    assert (ends.first_d, ends.first_i, ends.last_d, ends.last_i) == (3, 9, 5, 2)


def test_cohort_is_fixed_before_the_judged_year(spark):
    rows = [("x", 2010, .60), ("x", 2011, .50), ("x", 2012, .55), ("y", 2010, .40), ("y", 2011, .58), ("y", 2012, .30), ("z", 2012, .9), ("y", 2013, .10), ("x", 2013, .2)]
    df = spark.createDataFrame(rows, "team string, year int, pct double").withColumn("day", F.make_date("year", F.lit(6), F.lit(1)))
    dim = CO.dated_levels(df, "team", "year", "pct")
    seen = {(x.team, x.valid_from, x.valid_to): x.inherited for x in dim.collect()}
    assert seen[("x", dt.date(2011, 1, 1), dt.date(2012, 1, 1))] == .60
    cohort = CO.moved(CO.reference_cohort(df, dim, "team", "day", c("year") >= 2013, c("inherited") >= .5, ["inherited"]), "pct", "inherited")
    assert {(x.team, x.year, x.delta) for x in cohort.collect()} == {("x", 2011, -100), ("x", 2012, 50), ("y", 2012, -280)}
    own = CO.moved(CO.as_of(df.where("year = 2013"), dim, "team", "day", ["inherited"]), "pct", "inherited")
    got = {x.team: (x.delta, x.fell_further, x.level_with, x.cohort_n) for x in CO.among(cohort, own, "delta").collect()}
    assert got == {"x": (-350, 0, 0, 3), "y": (-200, 1, 0, 3)}


def test_pull_as_rows_and_weights_as_a_table(spark):
    df = spark.createDataFrame([(1, .4, 80, .32), (2, .2, 400, .32)], "k int, x double, n bigint, league double")
    got = {r.k: r.pulled for r in RC.pulled_by_rows(df, ["k"], c("x"), c("n"), c("league"), 220).collect()}
    assert math.isclose(got[1], (80 * .4 + 220 * .32) / 300) and math.isclose(got[2], (400 * .2 + 220 * .32) / 620)
    ev = spark.createDataFrame([(1, "hr"), (1, "k"), (1, "k"), (2, "bb"), (2, "other")], "p int, kind string")
    w = spark.createDataFrame([("hr", 13), ("bb", 3), ("k", -2)], "kind string, weight int")
    assert {r.p: r.weighted for r in RC.weighted_events(ev, ["p"], w, "kind").collect()} == {1: 9, 2: 3}


@pytest.mark.parametrize("planted, flagged", [(0.0, False), (0.0019, False), (0.01, True)])
def test_only_faults_beyond_the_tolerance_are_flagged(spark, planted, flagged):
    a = spark.createDataFrame([(1, .300 + planted), (2, .250)], "k int, woba double")
    b = spark.createDataFrame([(1, .300), (2, .250)], "k int, woba double")
    assert [r.k for r in A.reconcile(a, b, ["k"], {"woba": 0.002}).collect()] == ([1] if flagged else [])


def test_stated_ranks(spark):
    src = spark.createDataFrame([("hr", float(v)) for v in (40, 38, 38, 30)] + [("avg", v) for v in (.330, .3295, .310)], "stat string, v double")
    stated = spark.createDataFrame([("hr", 1, 40.0), ("hr", 2, 38.0), ("hr", 3, 38.0), ("hr", 3, 37.0), ("hr", 9, 1.0), ("avg", 2, .330), ("avg", 3, .312)], "stat string, rank bigint, v double")
    found = SEL.values_at_ranks(src, ["stat"], "v", stated.select("stat", "rank").distinct(), descending=True)
    got = {(r.stat, r["rank"], r.v): r.verdict for r in RC.at_stated_rank(stated, found, ["stat"], "rank", "v", {"hr": 0.0, "avg": 0.001}, "stat").collect()}
    assert got == {("hr", 1, 40.0): "ok", ("hr", 2, 38.0): "ok", ("hr", 3, 38.0): "ok", ("hr", 3, 37.0): "mismatch", ("hr", 9, 1.0): "missing", ("avg", 2, .330): "ok", ("avg", 3, .312): "mismatch"}


def test_rows_of_a_day_differ_in_tasks_of_bounded_size(spark, place, monkeypatch):
    r = random.Random(6)
    day = lambda: r.choice([None, *[dt.datetime(2001, 1, 1, 7) + dt.timedelta(days=k) for k in range(40)]])
    rows = [(i, r.choice([None, *range(60)]), r.choice(["P", "F", "F", "O", None]), day()) for i in range(3000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{place}/orders.parquet")
    monkeypatch.setattr(J, "ROWS_TOGETHER", 100, raising=False)
    got = catalog.queries()["C10_reconcile_ledger_windows_cohort"](spark, place)
    want = {}
    for _, who, status, when in rows:
        ab, hits, known = want.get(key := (who, when and when.date()), (0, 0, False))
        want[key] = (ab + (status in ("F", "O")), hits + (status == "F"), known or status is not None)
    laid = [(*k, ab if side[0] == "s" or known else None, (hits + (hits == 2 and side[0] == "s")) if side[0] == "s" or known else None, side)
            for k, (ab, hits, known) in want.items() if hits == 2 or not known for side in ("stated_only", "recomputed_only")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(laid, key=str)
    assert got.rdd.getNumPartitions() >= 30
