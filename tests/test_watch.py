"""Games that close at their final state, at the cap, or in silence: the same in any order of batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oddglass.streaming import live as R
from oddglass.streaming import watch as W

HOUR = 3600 * 1000
START = dt.datetime(2024, 1, 1)


def test_closing_rules():
    live = [(k * 1000, k, False) for k in range(10)]
    assert W.closing([*live[:2], (2000, 2, True)], 5, HOUR) == (2000, "final", 3)
    assert W.closing(live, 4, HOUR) == (3000, "polls", 4)
    assert W.closing([*live[:3], (3000, 3, True)], 4, HOUR) == (3000, "final", 4)
    assert W.closing([*live[:3], (2000 + HOUR + 1, 9, True)], 9, HOUR) == (2000 + HOUR, "silence", 3)
    assert W.closing([*live[:3], (2000 + HOUR, 9, True)], 9, HOUR) == (2000 + HOUR, "final", 4)
    assert W.closing([(0, 0, True), (5, 1, True)], 9, HOUR) == (0, "final", 1)


def polls():
    at = lambda m: START + dt.timedelta(minutes=m)
    return {
        1: [(1, at(0), 1, False), (1, at(5), 2, False), (2, at(0), 3, False), (4, at(1), 4, False), (4, at(1), 4, False)],
        2: [(1, at(10), 5, True), (2, at(1), 6, False), (2, at(2), 7, False), (3, at(9), 8, False)],
        3: [(1, at(15), 9, False), (2, at(3), 10, False), (2, at(4), 11, True), (4, at(130), 12, True), (5, at(50), 13, False)],
        9: [(99, at(600), 14, False), (1, at(601), 15, True)],
    }


@pytest.mark.parametrize("order", [(1, 2, 3), (3, 1, 2)])
def test_any_order_of_batches(spark, place, order):
    schema = "game bigint, ts timestamp, poll bigint, final boolean"
    for step in [*order, 9]:
        spark.createDataFrame(polls()[step], schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
        src = R.read_files(spark, f"{place}/in", spark.createDataFrame([], schema).schema)
        W.watch(src, f"{place}/out", f"{place}/ck", "game", "ts", "poll", F.col("final"), "3 hours", most=3, silence=HOUR).awaitTermination()
    ms = lambda m: int((START.replace(tzinfo=dt.timezone.utc).timestamp() + 60 * m) * 1000)
    got = {r.game: (r.opened, r.closed, r.reason, r.polls) for r in W.first_closings(spark, f"{place}/out").collect()}
    assert got == {
        1: (ms(0), ms(10), "final", 3), 2: (ms(0), ms(2), "polls", 3), 3: (ms(9), ms(69), "silence", 1), 4: (ms(1), ms(61), "silence", 1), 5: (ms(50), ms(110), "silence", 1)}


def test_buckets_of_games_are_rewritten_alone(spark, place):
    import os

    rows = [(g, n, 1, "d1") for g in range(20) for n in range(3)]
    df = R.bucketed(spark.createDataFrame(rows, "game int, n int, poll int, day string"), ["game"], 8)
    merge = R.merge_polls(f"{place}/t", ["game"], "poll", ["game", "n"], ["day", "bucket"])
    merge(df, 0)
    when = lambda: {d: max(os.path.getmtime(f"{place}/t/day=d1/{d}/{f}") for f in os.listdir(f"{place}/t/day=d1/{d}")) for d in os.listdir(f"{place}/t/day=d1")}
    before = when()
    newer = df.where("game = 7 AND n < 2").withColumn("poll", F.lit(2))
    merge(newer, 1)
    touched = newer.first().bucket
    assert [d for d, at in when().items() if at != before[d]] == [f"bucket={touched}"]
    assert spark.read.parquet(f"{place}/t").where("game = 7").count() == 2 and spark.read.parquet(f"{place}/t").count() == 59
