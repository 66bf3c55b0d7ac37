"""Nested live feeds: one row per pitch, or one summary row per game."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SWINGS, WHIFFS

FEED_SCHEMA = """
gamePk BIGINT, status STRING,
plays STRUCT<allPlays: ARRAY<STRUCT<atBatIndex: INT, pitcherId: BIGINT, batterId: BIGINT, inning: INT, isTop: BOOLEAN,
  result: STRUCT<hits: INT, runs: INT, homeRuns: INT>,
  playEvents: ARRAY<STRUCT<isPitch: BOOLEAN, pitchNumber: INT, description: STRING, startSpeed: DOUBLE>>>>>
"""
# What the pitch rows need; the parser skips all else.
PITCH_SCHEMA = """
gamePk BIGINT, status STRING,
plays STRUCT<allPlays: ARRAY<STRUCT<atBatIndex: INT, pitcherId: BIGINT, playEvents: ARRAY<STRUCT<isPitch: BOOLEAN, pitchNumber: INT, description: STRING, startSpeed: DOUBLE>>>>>
"""


def flatten(feeds: DataFrame, column: str) -> DataFrame:
    """One row per pitch with its swing, whiff and in-play flags; other events are skipped."""
    play = feeds.select(F.from_json(column, PITCH_SCHEMA).alias("f")).select(
        F.col("f.gamePk").alias("game_pk"), F.col("f.status").alias("status"), F.explode("f.plays.allPlays").alias("p"))
    event = play.select("game_pk", "status", F.col("p.atBatIndex").alias("at_bat"), F.col("p.pitcherId").alias("pitcher_id"), F.explode("p.playEvents").alias("e"))
    d = F.col("e.description")
    return event.where("e.isPitch").select(
        "game_pk", "status", "at_bat", "pitcher_id", F.col("e.pitchNumber").alias("pitch_number"), d.alias("description"), F.col("e.startSpeed").alias("start_speed"),
        d.isin(*SWINGS).alias("is_swing"), d.isin(*WHIFFS).alias("is_whiff"), (d == "hit_into_play").alias("is_in_play"))


def plays(feeds: DataFrame, column: str) -> DataFrame:
    """One row per at-bat: inning, half, batter, pitcher and what came of it."""
    play = feeds.select(F.from_json(column, FEED_SCHEMA).alias("f")).select(F.col("f.gamePk").alias("game_pk"), F.explode("f.plays.allPlays").alias("p"))
    return play.select(
        "game_pk", F.col("p.atBatIndex").alias("at_bat"), F.col("p.batterId").alias("batter_id"), F.col("p.pitcherId").alias("pitcher_id"), F.col("p.inning").alias("inning"), F.col("p.isTop").alias("top"),
        *[F.coalesce(f"p.result.{n}", F.lit(0)).cast("bigint").alias(a) for n, a in (("hits", "hits"), ("runs", "runs"), ("homeRuns", "home_runs"))])


def snapshot(feeds: DataFrame, column: str) -> DataFrame:
    """One row per game: state, score, inning and half, the batter at the plate with their line, pitch and whiff counts, last pitch.

    A game without a pitch yet (a preview) has counts of 0 and no last pitch.
    """
    last = F.struct("at_bat", "pitch_number")
    games = feeds.select(F.from_json(column, FEED_SCHEMA).alias("f")).groupBy(F.col("f.gamePk").alias("game_pk")).agg(F.max("f.status").alias("status"))
    pitches = flatten(feeds, column).groupBy("game_pk").agg(
        F.count("*").alias("pitches"), F.count_if("is_whiff").alias("whiffs"), F.max_by("description", last).alias("last_pitch"), F.max_by("pitcher_id", last).alias("pitcher_id"))
    bats = plays(feeds, column)
    now = F.struct("at_bat", "batter_id")
    state = bats.groupBy("game_pk").agg(
        F.max("at_bat").alias("last_at_bat"), F.max("inning").alias("inning"), F.max_by(F.when(F.col("top"), "top").otherwise("bottom"), now).alias("half"),
        F.sum(F.when(~F.col("top"), F.col("runs"))).alias("home"), F.sum(F.when(F.col("top"), F.col("runs"))).alias("away"), F.max_by("batter_id", now).alias("batter_id"))
    line = bats.groupBy("game_pk", "batter_id").agg(F.sum("hits").alias("batter_hits"), F.sum("home_runs").alias("batter_home_runs"), F.count("*").alias("batter_at_bats"))
    return games.join(pitches, "game_pk", "left").join(state, "game_pk", "left").join(line, ["game_pk", "batter_id"], "left").fillna(0, ["pitches", "whiffs"])
