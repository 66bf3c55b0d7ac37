"""Whitening against numpy's covariance and exact fractions, odd rows, values far from zero."""

import math
from fractions import Fraction

import numpy as np
import pytest

from oddglass.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, packed string, n int, at int"


def table(spark, found, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, 1, "p", 2, 3) for i, v in found], schema).repartition(3)


def answer(spark, df):
    return whiten.whiten(df, whiten.fit(whiten.fit_list(df))).collect()


def numbers(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(spark, found, components=16):
    got = answer(spark, table(spark, found))
    kept = [(i, tuple(x)) for i, v in found if (x := numbers(v))]
    distinct = sorted({x for _, x in kept})
    n, d = len(distinct), len(distinct[0])
    k = min(d, components)
    assert len(got) == k * len(kept)
    sums = [sum(x[j] for x in distinct) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in distinct])
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    places = {x: c for x, c in zip(distinct, centred)}
    for i, x in kept:
        dev = sum((n * x[j] - sums[j]) ** 2 for j in range(d))
        mine = by_id[(i, dev)]
        assert sorted(mine) == list(range(1, k + 1)) and all(r.n == n for v in mine.values() for r in v)
    # Squared lengths do not depend on the signs; the fit list's covariance is the identity.
    one = {x: [by_id[(i, sum((n * x[j] - sums[j]) ** 2 for j in range(d)))][c][0].whitened for c in range(1, k + 1)] for i, x in kept}
    w = np.array([one[x] for x in distinct])
    live = values[:k] > max(values[0], 0) * 1e-10
    assert np.abs((w.T @ w / n - np.eye(k))[np.ix_(live, live)]).max(initial=0) < 1e-6
    assert all(v == 0 for v in w[:, ~live].ravel())
    for c in range(k):
        want = values[c] / values.sum() if live[c] else 0.0
        assert math.isclose(got[0].explained if k == 1 else [r for r in got if r.component == c + 1][0].explained, want, rel_tol=1e-6, abs_tol=1e-12)
    if live.all() and k == d:  # all components: lengths are Mahalanobis distances
        inv = np.linalg.inv(cov)
        for x, c in places.items():
            assert math.isclose(sum(v * v for v in one[x]), c @ inv @ c, rel_tol=1e-6)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-4


def gauss(n, d, seed=1, shift=0.0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.linspace(3, 0.2, d)
    return [(i, (r.normal(size=d) @ mix + shift).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, d, shift", [(200, 6, 0.0), (300, 20, 0.0), (150, 5, 4000.0)])
def test_against_numpy(spark, n, d, shift):
    check(spark, gauss(n, d, 1, shift))


def test_copies_count_once(spark):
    found = gauss(120, 5, 2)
    check(spark, found + [(1000 + i, found[0][1]) for i in range(300)] + [found[3], found[3]])


def test_odd_rows(spark):
    found = gauss(60, 4, 3)
    odd = [(None, found[0][1]), (900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 2.0, 3.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [])]
    check(spark, found + odd)
    assert answer(spark, table(spark, [])) == [] and answer(spark, table(spark, odd[1:])) == []


def test_dependent_dimensions_and_one_vector(spark):
    found = [(i, [float(i % 7), 2.0 * (i % 7), 5.0]) for i in range(50)]
    check(spark, found)
    got = answer(spark, table(spark, [(1, [1.5, 2.5]), (2, [1.5, 2.5])]))
    assert len(got) == 4 and all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 and r.n == 1 for r in got)


def test_lengths_are_populations(spark):
    a, b = gauss(40, 3, 4), [(500 + i, v) for i, v in gauss(50, 5, 5)]
    both = answer(spark, table(spark, a + b))
    alone = answer(spark, table(spark, a)) + answer(spark, table(spark, b))
    key = lambda r: (r.vec_id, r.component)
    assert [(key(r), r.n, r.deviation, round(abs(r.whitened), 8)) for r in sorted(both, key=key)] == [(key(r), r.n, r.deviation, round(abs(r.whitened), 8)) for r in sorted(alone, key=key)]


def test_huge_values_stay_exact(spark):
    found = [(i, [float(i) * 2.0**45, float(i % 3)]) for i in range(20)] + [(99, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v) for i, v in found], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in answer(spark, df)}
    x = {i: [max(min(math.floor(64 * c), 2**62), -2**62) + 1_000_000 for c in v] for i, v in found}
    sums = [sum(v[j] for v in x.values()) for j in (0, 1)]
    for i, v in x.items():
        want = sum((21 * v[j] - sums[j]) ** 2 for j in (0, 1))
        assert (got[(i, 1)].deviation is None and want >= 10**38) or int(got[(i, 1)].deviation) == want
