"""The trimmed walk equals the plain greedy walk."""

from __future__ import annotations

import random

import pytest

from oddglass.operators.interest import diversity_board


def plain(rows, limit, per_detector, per_subject):
    det, sub, out = {}, {}, []
    for i, d, s, score, rank in sorted((r for r in rows if r[3] >= 0.35), key=lambda r: (-r[4], r[0])):
        if det.get(d, 0) >= per_detector or (s and sub.get(s, 0) >= per_subject):
            continue
        det[d] = det.get(d, 0) + 1
        sub[s] = sub.get(s, 0) + 1
        out.append(i)
        if len(out) == limit:
            break
    return out


@pytest.mark.parametrize("seed", range(5))
def test_board_equals_plain_walk(spark, seed):
    r = random.Random(seed)
    detectors, subjects = r.randint(2, 9), r.randint(1, 8)
    rows = []
    for i in range(r.randint(30, 300)):
        score = round(r.random(), 3)
        rows.append((f"c{i:04d}", f"d{r.randrange(detectors)}", r.choice(["", *[f"s{k}" for k in range(subjects)]]), score, round(score * r.choice([0.9, 1.0, 1.2]), 4)))
    df = spark.createDataFrame(rows, "id string, detector string, subject string, score double, rank_value double")
    got = [x.id for x in diversity_board(df).orderBy("slot").collect()]
    assert got == plain(rows, 12, 3, 2)
