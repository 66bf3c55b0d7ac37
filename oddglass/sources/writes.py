"""Table maintenance: idempotent slices, keyed merges, ledgers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import latest_per_key

LEDGER_SCHEMA = "source string, started_at timestamp, finished_at timestamp, complete boolean, rows long, note string"


class folder:
    """A folder of the storage Spark writes to, wherever that is.  Errors of the storage are raised."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Names of what lies in it; none where it does not exist."""
        return [x.getPath().getName() for x in self._fs.listStatus(self._path)] if self._fs.exists(self._path) else []

    def remove(self) -> None:
        self._fs.delete(self._path, True)


def replace_slice(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite only the partitions present in ``df``; a second run changes nothing."""
    # Rebalanced by slice: few files per slice, and a slice with most of the rows is
    # still split over many tasks.
    even = df.hint("rebalance", *[F.col(k) for k in keys])
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Newest row per key of both tables; the incoming row wins a tie."""
    both = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, [stamp, "_in"]).drop("_in").select(*existing.columns, *[c for c in incoming.columns if c not in existing.columns])


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet, one per key."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else incoming.distinct()
    return one.join(existing.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def ledger_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, LEDGER_SCHEMA)


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """Add one run's rows to a written ledger; a repeated run replaces itself, other runs stay."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a written ledger."""
    return spark.read.parquet(path)


def last_complete(ledger: DataFrame) -> DataFrame:
    return ledger.where("complete").groupBy("source").agg(F.max("finished_at").alias("last_complete"))


def freshness_guard(ledger: DataFrame, sources: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Each source with its last complete run and whether it is too old (or missing)."""
    seen = sources.join(last_complete(ledger), "source", "left")
    age = F.timestamp_diff("HOUR", F.col("last_complete"), now)
    return seen.withColumn("stale", F.coalesce(age > hours, F.lit(True)))


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[], int]]], ledger: str | None = None, run: str = "1") -> DataFrame:
    """Run named actions in order; a failing one is recorded and the rest go on.

    With ``ledger`` the outcome rows are appended there and read back.
    """
    rows = []
    for name, step in steps:
        start = dt.datetime.now(dt.timezone.utc)
        try:
            count, ok, note = int(step() or 0), True, ""
        except Exception as e:  # recorded in the ledger
            count, ok, note = 0, False, f"{type(e).__name__}: {e}"
        rows.append((name, start, dt.datetime.now(dt.timezone.utc), ok, count, note))
    done = ledger_rows(spark, rows)
    if ledger is None:
        return done
    append_run(done, ledger, run)
    return read_ledger(spark, ledger).where(F.col("run").cast("string") == run).drop("run")
