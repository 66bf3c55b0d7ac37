"""Registered queries: the live path (R1-R7), run as streams over the event files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import shared_dir
from ..streaming import live as R
from ..streaming import watch as WT
from .registry import query

c = F.col


def stream(t):
    """The event table as a file stream, with a zoned event time."""
    raw = R.read_files(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    return raw.select("event_id", "user_id", "event_type", "value", c("ts").cast("timestamp").alias("ts")).withColumn("day", c("ts").cast("date"))


LIVE_BUCKETS = 2  # a day of the given tables is small


def place(t) -> str:
    return f"{shared_dir(t.spark)}/live-{uuid.uuid4().hex[:10]}"


@query("R1_live_ingest", "SELECT event_id, user_id, CAST(ts AS DATE) AS day, round(value, 6) AS value FROM @live")
def r1(t):
    at = place(t)
    # a user's day stands for a game; the table comes in one poll
    polled = stream(t).withColumn("poll", F.lit(1))
    R.ingest(polled, f"{at}/table", f"{at}/ck", ["user_id", "day"], "poll", ["event_id"], "day", tie=["ts"]).awaitTermination()
    return t.spark.read.parquet(f"{at}/table").select("event_id", "user_id", "day", X.r6("value").alias("value"))


@query("R1b_live_polls", """SELECT event_id, user_id, day, round(CASE WHEN sent THEN value ELSE value - 5 END, 6) AS value FROM (SELECT *, bool_or(stays) OVER (PARTITION BY user_id, day) AS sent FROM (SELECT *, CAST(ts AS DATE) AS day, event_id % 10 <> 3 OR event_id % 3 = 0 AS stays FROM @live)) WHERE stays OR NOT sent""")
def r1b(t):
    """Three polls of every game, one a batch: a first one with wrong values, the newest one, which lacks
    rows that were withdrawn (games that lost all their rows are not in it), and an old copy that comes last."""
    at = place(t)
    rows = t.live.withColumn("ts", c("ts").cast("timestamp"))
    rows = rows.select("event_id", "user_id", "ts", "value", c("ts").cast("date").alias("day"))
    polls = [(1, rows.withColumn("value", c("value") + 5)), (3, rows.where("event_id % 10 <> 3 OR event_id % 3 = 0")), (2, rows.withColumn("value", c("value") - 5))]
    for k, (poll, sent) in enumerate(polls):
        sent.withColumn("poll", F.lit(poll)).write.parquet(f"{at}/in/step={k}")
    schema = t.spark.read.parquet(f"{at}/in/step=0").schema
    for k in range(len(polls)):
        landed = R.bucketed(R.read_files(t.spark, f"{at}/in/step={k}", schema), ["user_id", "day"], LIVE_BUCKETS)
        R.ingest(landed, f"{at}/table", f"{at}/ck{k}", ["user_id", "day"], "poll", ["event_id"], ["day", "bucket"], tie=["ts"]).awaitTermination()
    return t.spark.read.parquet(f"{at}/table").select("event_id", "user_id", "day", X.r6("value").alias("value"))


WATCH_SQL = """SELECT user_id, opened, closed, reason, k AS polls FROM (
 SELECT *, CASE WHEN reason = 'silence' THEN polled + 28800000 ELSE polled END AS closed FROM (SELECT *, CASE WHEN fin THEN 'final' WHEN k = 40 THEN 'polls' WHEN nxt IS NULL OR nxt - polled > 28800000 THEN 'silence' END AS reason FROM (
  SELECT user_id, epoch_us(ts) // 1000 AS polled, event_type = 'signup' AND value > 60 AS fin, row_number() OVER w AS k, lead(epoch_us(ts) // 1000) OVER w AS nxt, first(epoch_us(ts) // 1000) OVER w AS opened, max(epoch_us(ts) // 1000) OVER () - 172800000 AS mark FROM @live WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)))
 WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k) = 1) WHERE closed <= mark"""


@query("R2b_watch_capped", WATCH_SQL)
def r2b(t):
    """Each user's game until a signup over 60, forty polls, or eight hours without one."""
    at = place(t)
    WT.watch(stream(t), f"{at}/closed", f"{at}/ck", "user_id", "ts", "event_id", (c("event_type") == "signup") & (c("value") > 60), R.LATENESS, 40, 8 * 3600 * 1000).awaitTermination()
    return WT.first_closings(t.spark, f"{at}/closed").withColumnRenamed("game", "user_id")


@query("R2_watch_until_final", "SELECT e.event_id, e.user_id FROM @live e LEFT JOIN (SELECT user_id AS u, min(ts) AS done FROM @live WHERE event_type = 'signup' AND value > 60 GROUP BY 1) ON u = e.user_id WHERE done IS NULL OR ts <= done")
def r2(t):
    at = place(t)
    step = R.until_final(f"{at}/table", f"{at}/finals", "user_id", "ts", (c("event_type") == "signup") & (c("value") > 60), "day", ["event_id"])
    q = stream(t).writeStream.foreachBatch(step).option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return R.finished(t.spark, f"{at}/table", f"{at}/finals", "user_id", "ts").select("event_id", "user_id")


LINE_SQL = """(SELECT user_id, count(*) AS pitches, count(*) FILTER (event_type = 'error') AS whiffs, count(*) FILTER (event_type = 'view') AS called, count(*) FILTER (event_type = 'purchase' AND value > 60) AS ks, round((count(*) FILTER (event_type = 'error') + count(*) FILTER (event_type = 'view')) * 100e0 / count(*), 4) AS csw, max(value) AS top_speed FROM @live GROUP BY 1)"""


def lines(rows, keys):
    e = c("event_type")
    return R.pitcher_line(rows, keys, e == "error", e == "view", (e == "purchase") & (c("value") > 60), c("value"))


def streamed_lines(t):
    at = place(t)
    once = R.deduplicated(stream(t), ["event_id"], "ts").withColumn("start", F.window("ts", "1 day"))
    R.run_updates(lines(once, ["start", "user_id"]), f"{at}/lines", f"{at}/ck", ["start", "user_id"]).awaitTermination()
    return R.whole_line(R.newest_changes(t.spark, f"{at}/lines", ["start", "user_id"]), ["user_id"])


@query("R3_live_pitcher_line", f"SELECT * FROM {LINE_SQL}")
def r3(t):
    return streamed_lines(t)


@query("R4_pitcher_moment", f"SELECT user_id, pitches, csw, ks FROM {LINE_SQL} WHERE pitches >= 25 AND (csw >= 30 OR ks >= 7)")
def r4(t):
    return R.pitcher_moments(streamed_lines(t)).select("user_id", "pitches", "csw", "ks")


HIT_SQL = "(SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase' AND value > 150) AS hr, count(*) FILTER (event_type = 'purchase') AS hits, count(*) FILTER (event_type = 'click') AS rbi, max(value) AS hardest FROM @live GROUP BY 1, 2)"
MOMENT_SQL = f"(SELECT *, hr * 50e0 + hits * 12e0 + rbi * 8e0 AS score FROM {HIT_SQL} WHERE hr >= 1 OR hits >= 2 OR rbi >= 3)"


def streamed_hits(t):
    at = place(t)
    e = c("event_type")
    agg = R.windowed(stream(t), "ts").groupBy("start", "user_id", "day").agg(
        F.count_if((e == "purchase") & (c("value") > 150)).alias("hr"), F.count_if(e == "purchase").alias("hits"), F.count_if(e == "click").alias("rbi"), F.max("value").alias("hardest"))
    R.run_updates(agg, f"{at}/hits", f"{at}/ck", ["user_id", "day"]).awaitTermination()
    return R.newest_changes(t.spark, f"{at}/hits", ["user_id", "day"]).drop("start")


@query("R5_hitter_moment", f"SELECT * FROM {MOMENT_SQL}")
def r5(t):
    return R.hitter_moments(streamed_hits(t))


@query("R6_rank_moments", f"SELECT user_id, day, score FROM {MOMENT_SQL} ORDER BY score DESC, user_id * 1000 + day(day) LIMIT 25")
def r6(t):
    m = R.hitter_moments(streamed_hits(t)).withColumn("tie", c("user_id") * 1000 + F.dayofmonth("day"))
    return R.rank_moments(m, "score", "tie", 25).select("user_id", "day", "score")


@query("R7_busiest_own_pitcher", "SELECT day, user_id, n FROM (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM @live WHERE user_id % 2 = 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) = 1")
def r7(t):
    at = place(t)
    own = R.windowed(stream(t).where("user_id % 2 = 0"), "ts").groupBy("start", "day", "user_id").agg(F.count("*").alias("n"))
    R.run_updates(own, f"{at}/own", f"{at}/ck", ["day", "user_id"]).awaitTermination()
    return R.busiest(R.newest_changes(t.spark, f"{at}/own", ["day", "user_id"]), ["day"], "user_id", "n")


@query("R8_interval_line", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS pitches, count(*) FILTER (value > 100) AS whiffs FROM @live GROUP BY 1, 2")
def r8(t):
    at = place(t)
    agg = R.interval_line(stream(t), "ts", "1 day", ["event_type"], c("value") > 100)
    R.run_updates(agg, f"{at}/iv", f"{at}/ck", ["start", "event_type"]).awaitTermination()
    return R.newest_changes(t.spark, f"{at}/iv", ["start", "event_type"]).select(c("start").cast("date").alias("day"), "event_type", "pitches", "whiffs")
