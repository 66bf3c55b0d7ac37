"""Landed JSON feeds: flattening, later copies win, a repeated run changes nothing."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from oddglass.sources import feed, writes
from oddglass.streaming import live as R

c = F.col


def event(n, what, pitch=True):
    return {"isPitch": pitch, "pitchNumber": n, "description": what, "startSpeed": 90.0 + n}


def game(events, poll):
    return {"feed": json.dumps({"gamePk": 7, "status": "Live", "plays": {"allPlays": [{"atBatIndex": 0, "pitcherId": 5, "playEvents": events}]}}), "poll": poll, "day": "2024-06-01"}


FIRST = [event(1, "swinging_strike"), event(2, "ball"), event(0, "mound visit", False), event(3, "swinging_strike"), event(4, "hit_into_play")]


def test_flatten_and_snapshot(spark):
    df = spark.createDataFrame([game(FIRST, 1)], "feed string, poll long, day string")
    rows = feed.flatten(df, "feed").collect()
    assert len(rows) == 4 and sum(r.is_whiff for r in rows) == 2 and sum(r.is_in_play for r in rows) == 1
    s = feed.snapshot(df, "feed").first()
    assert (s.pitches, s.whiffs, s.last_pitch) == (4, 2, "hit_into_play")


def test_second_poll_corrects_and_keeps_four(spark, place):
    os.makedirs(f"{place}/in")
    schema = spark.createDataFrame([], "feed string, poll long, day string").schema

    def poll(name, row):
        with open(f"{place}/in/{name}.json", "w") as f:
            f.write(json.dumps(row))
        raw = R.read_files(spark, f"{place}/in", schema, "json")
        pitches = raw.select("poll", "day", F.from_json("feed", feed.FEED_SCHEMA).alias("f")).select("poll", "day", F.col("f.gamePk").alias("game_pk"), F.explode("f.plays.allPlays").alias("p")).select(
            "poll", "day", "game_pk", F.col("p.atBatIndex").alias("at_bat"), F.explode("p.playEvents").alias("e")).where("e.isPitch").select(
            "poll", "day", "game_pk", "at_bat", F.col("e.pitchNumber").alias("n"), F.col("e.description").alias("what"))
        R.ingest(pitches, f"{place}/table", f"{place}/ck", ["game_pk"], "poll", ["game_pk", "at_bat", "n"], "day").awaitTermination()
        return {r.n: r.what for r in spark.read.parquet(f"{place}/table").collect()}

    assert len(poll("a", game(FIRST, 1))) == 4
    fixed = [event(1, "foul"), *FIRST[1:]]
    got = poll("b", game(fixed, 2))
    assert len(got) == 4 and got[1] == "foul"
    assert poll("c", game(FIRST[:1], 0))[1] == "foul"  # an older copy does not win
    assert sorted(poll("d", game(FIRST[1:4], 3))) == [2, 3]  # a withdrawn pitch goes


def test_a_failing_read_stops_the_batch(spark, place, monkeypatch):
    df = spark.createDataFrame([(1, 1, 1, "d1"), (1, 2, 1, "d1")], "game int, n int, poll int, day string")
    merge = R.merge_polls(f"{place}/t", ["game"], "poll", ["game", "n"], "day")
    merge(df, 0)

    def broken(*_):
        raise OSError("storage away")
    monkeypatch.setattr(R.folder, "names", broken)
    with pytest.raises(OSError):
        merge(df.where("n = 1").withColumn("poll", F.lit(2)), 1)
    assert spark.read.parquet(f"{place}/t").count() == 2


def test_batches_in_any_order_and_twice(spark, place):
    rows = [(1, 1, 1, "pitch", "d1"), (2, 1, 5, "pitch", "d2"), (3, 1, 2, "final", "d1"), (4, 2, 1, "pitch", "d1"), (5, 1, 4, "final", "d1")]
    df = spark.createDataFrame(rows, "id int, game int, at int, what string, day string")
    for name, order in (("a", [1, 2, 3, 4, 5]), ("b", [5, 3, 2, 4, 1]), ("c", [2, 2, 4, 3, 3, 1, 5])):
        step = R.until_final(f"{place}/{name}", f"{place}/{name}f", "game", "at", c("what") == "final", "day", ["id"])
        for k, i in enumerate(order):
            step(df.where(c("id") == i), k)
        assert sorted(r.id for r in R.finished(spark, f"{place}/{name}", f"{place}/{name}f", "game", "at").collect()) == [1, 3, 4]


def test_changes_are_compacted(spark, place):
    keep = R.keep_changes(f"{place}/t", ["k"], every=3)
    for b in [0, 1, 2, 2, 3, 4, 5, 6]:
        keep(spark.createDataFrame([(b % 2, b), (9, b)], "k int, v int"), b)
    left = sorted(n for n in os.listdir(f"{place}/t") if not n.startswith((".", "_")))
    assert left == ["base=5", "batch=6"]
    assert {r.k: r.v for r in R.newest_changes(spark, f"{place}/t", ["k"]).collect()} == {0: 6, 1: 5, 9: 6}


def test_update_stream_equals_batch(spark, place):
    rows = [(i, i % 3, "error" if i % 4 == 0 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, event_type string, value double")
    for k in range(3):
        df.where(c("event_id") % 3 == k).write.mode("append").parquet(f"{place}/in")
    src = R.read_files(spark, f"{place}/in", df.schema, per_trigger=1)
    line = lambda d: R.pitcher_line(d, ["user_id"], c("event_type") == "error", c("event_type") == "view", c("value") > 50, c("value"))
    R.run_updates(line(src), f"{place}/out", f"{place}/ck", ["user_id"]).awaitTermination()
    got = R.newest_changes(spark, f"{place}/out", ["user_id"])
    assert sorted(map(tuple, got.select(*line(df).columns).collect())) == sorted(map(tuple, line(df).collect()))


def test_rows_after_the_final_state_are_dropped(spark, place):
    def land(rows):
        spark.createDataFrame(rows, "id int, game int, at int, what string, day string").write.mode("append").parquet(f"{place}/in")
        step = R.until_final(f"{place}/t", f"{place}/f", "game", "at", c("what") == "final", "day", ["id"])
        schema = spark.read.parquet(f"{place}/in").schema
        R.read_files(spark, f"{place}/in", schema).writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in R.finished(spark, f"{place}/t", f"{place}/f", "game", "at").collect())
    assert land([(1, 1, 1, "pitch", "d1"), (2, 1, 2, "final", "d1"), (3, 2, 1, "pitch", "d1")]) == [1, 2, 3]
    assert land([(4, 1, 3, "pitch", "d1"), (5, 2, 2, "pitch", "d1")]) == [1, 2, 3, 5]


def test_slices_ledgers_and_merges(spark, place):
    df = spark.createDataFrame([(2023, 1, 5), (2024, 1, 6), (2024, 2, 7)], "season int, id int, v int")
    writes.replace_slice(df, f"{place}/s", ["season"])
    writes.replace_slice(df.where("season = 2024 AND id = 1").withColumn("v", F.lit(9)), f"{place}/s", ["season"])
    assert sorted((r.season, r.id, r.v) for r in spark.read.parquet(f"{place}/s").collect()) == [(2023, 1, 5), (2024, 1, 9)]
    merged = writes.upsert_latest(df.withColumn("t", F.lit(1)), df.where("id = 2").withColumn("v", F.lit(0)).withColumn("t", F.lit(2)), ["season", "id"], "t")
    assert {(r.season, r.id): r.v for r in merged.collect()} == {(2023, 1): 5, (2024, 1): 6, (2024, 2): 0}
    assert writes.insert_if_absent(df.where("season = 2023"), df, ["season", "id"]).count() == 2

    def fail():
        raise RuntimeError("down")
    done = {r.source: r.complete for r in writes.run_steps(spark, [("a", lambda: 1), ("b", fail), ("c", lambda: 2)]).collect()}
    assert done == {"a": True, "b": False, "c": True}
