"""Fixed reference cohorts: dated levels, as-of lookups, and an own row ranked among earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering as O


def dated_levels(levels: DataFrame, key: str, year: str, value: str, kept: list[str] = ()) -> DataFrame:
    """A dated dimension: the level a key ended a year with holds through the following year.

    ``valid_from`` is the first day of the next year and ``valid_to`` the day after its last, so a
    lookup by day finds the level that was inherited, never one that is still being made.
    """
    day = lambda add: F.make_date(F.col(year) + add, F.lit(1), F.lit(1))
    return levels.select(key, F.col(value).alias("inherited"), *kept, day(1).alias("valid_from"), day(2).alias("valid_to"))


def as_of(rows: DataFrame, dimension: DataFrame, key: str, day: str, bring: list[str]) -> DataFrame:
    """Each row with the version of its key's level that was valid on its day; rows without one go.

    Versions do not overlap and last a year, so the year of the day makes the range an equi-join.
    """
    at = dimension.select(F.col(key), F.year("valid_from").alias("_y"), "valid_from", "valid_to", *bring)
    both = rows.withColumn("_y", F.year(day)).join(at, [key, "_y"])
    return both.where((F.col(day) >= F.col("valid_from")) & (F.col(day) < F.col("valid_to"))).drop("_y", "valid_from", "valid_to")


def moved(rows: DataFrame, now: str, before: str, out: str = "delta") -> DataFrame:
    """Points (thousandths) gained or lost against the inherited level."""
    return rows.withColumn(out, F.bround((F.col(now) - F.col(before)) * 1000, 0).cast("int"))


def reference_cohort(seasons: DataFrame, dimension: DataFrame, key: str, day: str, judged: Column, included: Column, bring: list[str]) -> DataFrame:
    """The fixed cohort: seasons before the judged one that meet the inclusion rule.

    ``seasons`` has a row per key and year with its result and the ``day`` it is looked up at.  The
    rule reads inherited columns only, so it cannot choose by outcome.
    """
    return as_of(seasons.where(~judged), dimension, key, day, bring).where(included)


def among(cohort: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """Own rows, each ranked in the cohort united with it: ``fell_further`` counts cohort rows below it.

    Own rows do not count each other: the cohort is the same for every one of them, so one
    cumulative count over the cohort's values answers all.
    """
    at = own.select(value, F.lit(0).cast("bigint").alias("_c")).unionByName(cohort.select(value, F.lit(1).cast("bigint").alias("_c")))
    counts = at.groupBy(value).agg(F.sum("_c").alias("_c"))
    below = O.running_totals(counts, [], [value], {"c": "_c"}).selectExpr(f"`{value}`", "before_c AS fell_further", "_c AS level_with", "whole_c AS cohort_n")
    return own.join(below, value).select(*own.columns, "fell_further", "level_with", "cohort_n")
