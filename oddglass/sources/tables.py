"""Reading: schema contract, fallback source, newest period, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column contracts of the season, game and event tables; columns may be added, never removed.
CONTRACT = {
    "season_totals": T.StructType([
        T.StructField("subject_id", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("name", T.StringType()),
        T.StructField("team", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("hr", T.LongType()),
        T.StructField("price_c", T.LongType()), T.StructField("war", T.DoubleType()),
    ]),
    "game_log": T.StructType([
        T.StructField("subject_id", T.LongType()), T.StructField("game_date", T.DateType()), T.StructField("ab", T.LongType()),
        T.StructField("hits", T.LongType()), T.StructField("bb", T.LongType()), T.StructField("price_c", T.LongType()),
    ]),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the contract, add its missing columns as nulls, keep extra columns last."""
    have = set(df.columns)
    wanted = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return df.select(*wanted, *[c for c in df.columns if c not in schema.fieldNames()])


def resolve_source(fresh: DataFrame | None, historical: DataFrame | None) -> DataFrame:
    """The fresh table when it holds any row, else the historical copy."""
    if fresh is not None and not fresh.isEmpty():
        return fresh
    if historical is None:
        raise LookupError("neither the fresh nor the historical table is there")
    return historical


def period_column(df: DataFrame) -> str:
    for name in ("year", "season"):
        if name in df.columns:
            return name
    raise LookupError("table has no period column")


def max_period(df: DataFrame) -> DataFrame:
    return df.agg(F.max(period_column(df)).alias("max_period"))


class Namespace:
    """A second, read-only base folder of parquet tables."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def table(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.base}/{name}.parquet")


def normalise_events(df: DataFrame, keep, numbers: list[str], columns: dict[str, str]) -> DataFrame:
    """Keep the wanted rows, turn NaN into null, fix column order and types."""
    clean = df.where(keep).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in numbers})
    return clean.select(*[F.col(n).cast(t).alias(n) for n, t in columns.items()])


def backfill_plan(qualified: DataFrame, events: DataFrame, subject: str, day: str, since) -> DataFrame:
    """Qualified subjects whose newest event is older than ``since`` (or missing)."""
    newest = events.groupBy(subject).agg(F.max(day).alias("newest"))
    return qualified.join(newest, subject, "left").where(F.col("newest").isNull() | (F.col("newest") < since))


def window_totals(games: DataFrame, subject: str, day: str, as_of, days: int, sums: list[str]) -> DataFrame:
    """Two adjacent windows of ``days`` days ending at ``as_of``: totals per subject and label."""
    age = F.datediff(as_of, F.col(day))
    label = F.when(age.between(0, days - 1), "recent").when(age.between(days, 2 * days - 1), "prior")
    return (
        games.withColumn("win", label).where(F.col("win").isNotNull())
        .groupBy("win", subject).agg(*[F.sum(s).alias(s) for s in sums])
    )


def roster_lists(roster: DataFrame, status: str, position: str) -> DataFrame:
    """Available subjects with the work list each belongs to."""
    free = roster.where(F.col(status).isNull() | (F.lower(status) == "active"))
    return free.withColumn("work_list", F.when(F.col(position) == "P", "pitcher").otherwise("batter"))
