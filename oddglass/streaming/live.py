"""The live path: files landing in a folder, kept newest-poll-wins, and the lines read off them.

A feed is sent whole at every poll, so a game's newest poll replaces all earlier rows of the game:
a pitch that a later feed corrects or withdraws is corrected or gone.  ``foreachBatch`` merges each
micro-batch into a table partitioned by day (or finer: any column a game does not change); only
the partitions a batch touches are read and written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import scalars as X
from ..operators.joins import latest_per_key
from ..session import settle
from ..sources.writes import folder, replace_slice

# Fixed values of the live rules.
PITCHER_PITCHES = 25
PITCHER_CSW = 30.0
PITCHER_KS = 7
HITTER_WEIGHTS = {"hr": 50.0, "hits": 12.0, "rbi": 8.0}

#: How late a row may be, by event time, before it is dropped; every windowed operator takes its own.
LATENESS = "2 days"
#: Buckets of games in a day of the live table: as many as make a bucket a file of good size.
BUCKETS = 64
#: Change folders between two compactions.
COMPACT_EVERY = 20


def read_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def written(spark: SparkSession, path: str) -> bool:
    """Has anything been written there?  An error of the storage is an error, not a "no"."""
    return any(not name.startswith(("_", ".")) for name in folder(spark, path).names())


def newest_poll(rows: DataFrame, game: list[str], poll: str, keys: list[str], tie: list[str] = ()) -> DataFrame:
    """The rows of each game's newest poll, one for each key."""
    newest = rows.groupBy(*game).agg(F.max(poll).alias("_newest"))
    kept = rows.join(newest, game).where(F.col(poll) == F.col("_newest")).drop("_newest")
    return latest_per_key(kept, keys, [poll, *tie]).select(*rows.columns)


def parts_of(partition: str | list[str]) -> list[str]:
    return [partition] if isinstance(partition, str) else list(partition)


def bucketed(rows: DataFrame, game: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows with ``bucket``, by their game: a partition finer than a day, so that a batch rewrites the
    buckets of the games it touches and not whole days."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*game), F.lit(buckets)).cast("int"))


def merge_polls(table: str, game: list[str], poll: str, keys: list[str], partition: str | list[str], tie: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """Batch function: each game as its newest poll has it, rewriting only the touched partitions.

    The same batch twice, or two batches in either order, give the same table.  A game stays in its
    partition.
    """
    parts = parts_of(partition)

    def merge(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        both = batch
        if written(spark, table):
            old = spark.read.parquet(table).join(batch.select(*parts).distinct(), parts, "left_semi")
            both = old.unionByName(batch.select(*old.columns))
        # Settled first: the partitions read are the ones written.
        replace_slice(settle(newest_poll(both, game, poll, keys, tie)), table, parts)

    return merge


def ingest(stream: DataFrame, table: str, checkpoint: str, game: list[str], poll: str, keys: list[str], partition: str | list[str], trigger: dict | None = None, tie: list[str] = ()) -> StreamingQuery:
    """Start the live ingest; ``trigger`` defaults to everything available, then stop."""
    return (
        stream.writeStream.foreachBatch(merge_polls(table, game, poll, keys, partition, tie))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def ends_of(spark: SparkSession, finals: str, game: str) -> DataFrame:
    """The first final moment of each finished game."""
    return spark.read.parquet(finals).groupBy(game).agg(F.min("_end").alias("_end"))


def up_to_end(rows: DataFrame, ended: DataFrame, game: str, stamp: str) -> DataFrame:
    """Rows not later than their game's end; games without an end whole."""
    return rows.join(ended, game, "left").where(F.col("_end").isNull() | (F.col(stamp) <= F.col("_end"))).select(*rows.columns)


def until_final(table: str, finals: str, game: str, stamp: str, final: Column, partition: str | list[str], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch function: keep what a game sent up to its final state, drop later rows.

    The ends a batch brings are written to a folder of that batch, beside the main table, so a
    repeated batch replaces itself and no earlier end is ever overwritten.  Rows that came before
    the end was known leave the partitions that are written again; ``finished`` leaves them out
    wherever they lie, so the result does not depend on the order of the batches.
    """
    parts = parts_of(partition)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.where(final).groupBy(game).agg(F.min(stamp).alias("_end")).write.mode("overwrite").parquet(f"{finals}/batch={batch_id}")
        ended = ends_of(spark, finals, game)
        both = batch
        if written(spark, table):
            old = spark.read.parquet(table).join(batch.select(*parts).distinct(), parts, "left_semi")
            both = old.unionByName(batch.select(*old.columns))
        kept = up_to_end(latest_per_key(both, keys, [stamp]).select(*both.columns), ended, game, stamp)
        replace_slice(settle(kept), table, parts)

    return step


def finished(spark: SparkSession, table: str, finals: str, game: str, stamp: str) -> DataFrame:
    """The table ``until_final`` keeps, without rows after their game's end."""
    return up_to_end(spark.read.parquet(table), ends_of(spark, finals, game), game, stamp)


def keep_changes(table: str, keys: list[str], every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """Batch function for update mode: changed rows, tagged with their batch.

    A batch writes its own folder, so a repeated batch replaces itself.  After every so many batches
    the newest row of each key is written as a new base and the folders it replaces are removed.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch_no", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if batch_id % every == every - 1:
            old = _parts(spark, table, batch_id)
            latest_per_key(spark.read.parquet(*old), keys, ["batch_no"]).write.mode("overwrite").parquet(f"{table}/base={batch_id}")
            for path in old:
                if not path.endswith(f"/base={batch_id}"):
                    folder(spark, path).remove()

    return append


def _parts(spark: SparkSession, table: str, upto: int | None = None) -> list[str]:
    """The newest complete base and the changes after it."""
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for name in folder(spark, table).names():
        kind, _, number = name.partition("=")
        if kind in found and (upto is None or int(number) <= upto) and (kind == "batch" or "_SUCCESS" in folder(spark, f"{table}/{name}").names()):
            found[kind].append(int(number))
    base = max((b for b in found["base"] if upto is None or b < upto), default=-1)
    return [f"{table}/base={base}"] * (base >= 0) + [f"{table}/batch={b}" for b in sorted(found["batch"]) if b > base]


def newest_changes(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The state the changed rows add up to."""
    return latest_per_key(spark.read.parquet(*_parts(spark, table)), keys, ["batch_no"]).drop("batch_no")


def run_updates(aggregated: DataFrame, table: str, checkpoint: str, keys: list[str], every: int = COMPACT_EVERY) -> StreamingQuery:
    return (
        aggregated.writeStream.outputMode("update").foreachBatch(keep_changes(table, keys, every))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed(stream: DataFrame, stamp: str, late: str = LATENESS, width: str = "1 day") -> DataFrame:
    """The stream with ``start``, its event-time window, under a watermark: groups by ``start`` leave the state
    once the watermark has passed them."""
    return stream.withWatermark(stamp, late).withColumn("start", F.window(stamp, width))


def deduplicated(stream: DataFrame, keys: list[str], stamp: str, late: str = LATENESS) -> DataFrame:
    """Each key once within the lateness the watermark allows; state stays bounded."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def pitcher_line(rows: DataFrame, keys: list[str], whiff: Column, called: Column, strikeout: Column, speed: Column) -> DataFrame:
    """Pitches, whiffs, called strikes and CSW; the same text for a stream and a table."""
    n = F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("pitches"), F.count_if(whiff).alias("whiffs"), F.count_if(called).alias("called"), F.count_if(strikeout).alias("ks"),
        X.rnd((F.count_if(whiff) + F.count_if(called)) * 100.0 / n, 4).alias("csw"), F.max(speed).alias("top_speed"))


def whole_line(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The line of all windows from the lines of each: counts add up, the rate is taken anew."""
    total = parts.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ("pitches", "whiffs", "called", "ks")], F.max("top_speed").alias("top_speed"))
    return total.withColumn("csw", X.rnd((F.col("whiffs") + F.col("called")) * 100.0 / F.col("pitches"), 4)).select(*keys, "pitches", "whiffs", "called", "ks", "csw", "top_speed")


def interval_line(stream: DataFrame, stamp: str, width: str, keys: list[str], whiff: Column, late: str = LATENESS) -> DataFrame:
    """Counts per tumbling window, for streams that carry an event time; rows later than ``late`` are dropped."""
    return (
        stream.withWatermark(stamp, late).groupBy(F.window(stamp, width).alias("w"), *keys)
        .agg(F.count("*").alias("pitches"), F.count_if(whiff).alias("whiffs"))
        .select(F.col("w.start").alias("start"), *keys, "pitches", "whiffs")
    )


def pitcher_moments(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("pitches") >= PITCHER_PITCHES) & ((F.col("csw") >= PITCHER_CSW) | (F.col("ks") >= PITCHER_KS)))


def hitter_moments(lines: DataFrame) -> DataFrame:
    """``hr, hits, rbi`` per hitter and game: notable ones with their score."""
    score = F.lit(0.0)
    for name, weight in HITTER_WEIGHTS.items():
        score = score + F.col(name) * weight
    return lines.where("hr >= 1 OR hits >= 2 OR rbi >= 3").withColumn("score", score)


def rank_moments(moments: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return moments.orderBy(F.desc(score), tie).limit(k)


def busiest(lines: DataFrame, game: list[str], pitcher: str, count: str) -> DataFrame:
    """The pitcher with most pitches per game (lowest id on a tie)."""
    return lines.groupBy(*game).agg(F.min_by(pitcher, F.struct(-F.col(count), F.col(pitcher))).alias(pitcher), F.max(count).alias(count))
