"""Distributed order operators against brute force: ties, hot values, many buckets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from oddglass.operators import ordering as O
from oddglass.operators.spatial import rolling_mean

SMALL = {"one_in": 3, "most": 5}  # force several buckets on small data


def data(seed: int, n: int = 400) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    value = np.where(r.random(n) < 0.35, 7.0, r.integers(0, 60, n).astype(float))  # one value holds a third
    return pd.DataFrame({"m": r.choice(["a", "b"], n), "id": np.arange(n), "v": value, "w": r.integers(1, 9, n)})


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("kw", [{}, SMALL])
def test_ecdf_is_strictly_less_share(spark, seed, kw):
    p = data(seed)
    got = O.ecdf(spark.createDataFrame(p), ["m"], "v", **kw).toPandas()
    for m, g in got.groupby("m"):
        v = p[p.m == m].v.to_numpy()
        assert len(g) == len(v)
        assert np.allclose(g.pct, [(v < x).mean() for x in g.v])
        assert (g.pop_n == len(v)).all()


@pytest.mark.parametrize("kw", [{}, SMALL])
def test_ecdf_lower_is_better_and_no_part(spark, kw):
    p = data(3)
    got = O.ecdf(spark.createDataFrame(p), [], "v", better="false", **kw).toPandas()
    assert np.allclose(got.pct, [(p.v > x).mean() for x in got.v])


@pytest.mark.parametrize("kw", [{}, SMALL])
def test_ordinal_rank_and_neighbours(spark, kw):
    p = data(4)
    df = spark.createDataFrame(p)
    got = O.ordinal(df, ["m"], ["v", "id"], **kw).toPandas().sort_values(["m", "v", "id"])
    assert (got.groupby("m").cumcount() + 1 == got["rank"]).all()
    above = O.next_better(df, ["m"], ["v", "id"], {"id": "prev"}, **kw).toPandas().sort_values(["m", "v", "id"])
    want = above.groupby("m")["id"].shift(1)
    assert ((above.prev == want) | (above.prev.isna() & want.isna())).all()


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantile_matches_numpy(spark, q):
    p = data(5, 157)
    got = O.quantile_cut(spark.createDataFrame(p), ["m"], "v", q, **SMALL).toPandas().set_index("m").cut
    for m, g in p.groupby("m"):
        assert got[m] == pytest.approx(np.quantile(g.v, q))


def test_competition_rank(spark):
    p = data(6)
    got = O.competition_rank(spark.createDataFrame(p), ["m"], "v", **SMALL).toPandas()
    want = p.groupby("m").v.rank(method="min", ascending=False).astype(int)
    assert (got.set_index("id")["rank"].sort_index() == want.sort_index()).all()


def test_range_totals_match_brute_force(spark):
    p = data(7, 150)
    df = spark.createDataFrame(p)
    probes = df.selectExpr("m", "id", "v - 3 as lo", "v + 3 as hi")
    got = O.range_totals(df, probes, ["m"], "v", {"total": "w"}, "lo", "hi", ["id"], **SMALL).toPandas().set_index("id")
    for r in p.itertuples():
        near = p[(p.m == r.m) & (p.v >= r.v - 3) & (p.v <= r.v + 3)]
        assert got.loc[r.id, "n_in"] == len(near)
        assert got.loc[r.id, "total"] == near.w.sum()


@pytest.mark.parametrize("kw", [{}, {"one_in": 2, "most": 4}])
def test_rolling_mean_window_depends_on_subject(spark, kw):
    r = np.random.default_rng(8)
    rows = [(s, i, int(r.integers(0, 100))) for s, n in (("hot", 300), ("mid", 45), ("few", 19)) for i in range(n)]
    p = pd.DataFrame(rows, columns=["s", "i", "v"])
    got = rolling_mean(spark.createDataFrame(p), "s", ["i"], "v", **kw).toPandas()
    assert set(got.s) == {"hot", "mid"}  # under 20 rows: no line
    for s, g in p[p.s != "few"].groupby("s"):
        w = min(50, max(10, len(g) // 4))
        want = g.sort_values("i").v.rolling(w).mean().dropna().to_numpy()
        mine = got[got.s == s].sort_values("x")
        assert (mine.w == w).all() and np.allclose(mine.y, want)
