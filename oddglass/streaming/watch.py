"""Watching games until they close: at the final state, after so many polls, or when nothing comes.

Each game is keyed state with an event-time timer.  The state holds a game's earliest polls, as many
as the cap at most, so it is bounded however often a game is polled; from them alone follows when
the game closes and why.  The timer stands at that moment.  Once the watermark has passed it no
earlier poll can come, so the closing is written and the state removed.  Since everything is decided
by event time, batches may come in any order within the lateness that the watermark allows.

Polls after a game's end may open the key again once its state is gone; ``first_closings`` reads the
closing that was opened first, which is the game's own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.joins import latest_per_key

#: Polls of a game after which it is given up.
MOST_POLLS = 500
#: Milliseconds without a poll after which a game is given up.
SILENCE = 6 * 3600 * 1000
STATE = "at array<bigint>, poll array<bigint>, final array<boolean>"
OUT = "game bigint, opened bigint, closed bigint, reason string, polls bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closing(polls: list[tuple[int, int, bool]], most: int, silence: int) -> tuple[int, str, int]:
    """(moment, reason, polls counted) of the ordered polls (time, id, final) of one game.

    A final poll closes at its own time, the last allowed poll at its own, and a game that is not
    polled for ``silence`` at the end of that time.
    """
    for i, (at, _, final) in enumerate(polls):
        if final:
            return at, "final", i + 1
        if i + 1 == most:
            return at, "polls", most
        if i + 1 == len(polls) or polls[i + 1][0] - at > silence:
            return at + silence, "silence", i + 1
    raise ValueError("a game without polls")


class Watch(StatefulProcessor):
    """One game: its earliest polls, and a timer at the moment it closes as far as is known."""

    def __init__(self, most: int, silence: int):
        self.most, self.silence = most, silence

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("polls", STATE)

    def _polls(self) -> list[tuple[int, int, bool]]:
        return list(zip(*[list(x) for x in self.held.get()])) if self.held.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        found = set(self._polls())
        for frame in rows:
            found.update(zip(frame["at"].astype(int).tolist(), frame["poll"].astype(int).tolist(), frame["final"].astype(bool).tolist()))
        polls = sorted(found)[:self.most]
        if polls:
            self.held.update(tuple([list(x) for x in zip(*polls)]))
            moment = closing(polls, self.most, self.silence)[0]
            timers = list(self.handle.listTimers())
            for old in timers:
                if old != moment:
                    self.handle.deleteTimer(old)
            if moment not in timers:
                self.handle.registerTimer(moment)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        polls = self._polls()
        if polls:
            moment, reason, counted = closing(polls, self.most, self.silence)
            self.held.clear()
            yield pd.DataFrame({"game": [key[0]], "opened": [polls[0][0]], "closed": [moment], "reason": [reason], "polls": [counted]})

    def close(self) -> None:
        pass


def closings(stream: DataFrame, game: str, stamp: str, poll: str, final: Column, late: str, most: int = MOST_POLLS, silence: int = SILENCE) -> DataFrame:
    """game, opened, closed (milliseconds), reason, polls: a stream of the games that closed.

    Needs the RocksDB state store (``ROCKS``).  Rows later than ``late`` are dropped by the watermark.
    """
    polls = stream.withWatermark(stamp, late).select(
        F.col(game).cast("bigint").alias("game"), F.col(stamp), F.unix_millis(stamp).alias("at"), F.col(poll).cast("bigint").alias("poll"), F.coalesce(final, F.lit(False)).alias("final"))
    return polls.groupBy("game").transformWithStateInPandas(Watch(most, silence), OUT, "Append", "EventTime")


def watch(stream: DataFrame, table: str, checkpoint: str, game: str, stamp: str, poll: str, final: Column, late: str, most: int = MOST_POLLS, silence: int = SILENCE) -> StreamingQuery:
    """Start the watch over what is there, then stop; closings are appended to ``table``."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        made = closings(stream, game, stamp, poll, final, late, most, silence)
        return made.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def first_closings(spark: SparkSession, table: str) -> DataFrame:
    """One row per closed game: the closing that was opened first."""
    rows = spark.read.schema(OUT).parquet(table).withColumn("_first", -F.col("opened"))
    return latest_per_key(rows, ["game"], ["_first"]).drop("_first")
