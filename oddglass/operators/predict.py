"""Predictions: logged once per subject, graded by re-measuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources.writes import insert_if_absent

# Movements below these are a push.
EPSILON = {"era": 0.10, "woba": 0.005}
HORIZON_DAYS = 30


def log_predictions(open_now: DataFrame, findings: DataFrame, as_of: Column, key: list[str]) -> DataFrame:
    """New open predictions; a subject with one open gets no second."""
    fresh = findings.withColumn("resolves_by", F.date_add(as_of, HORIZON_DAYS)).withColumn("outcome", F.lit("open"))
    return insert_if_absent(open_now, fresh, key)


def outcome(baseline: Column, target: Column, current: Column, epsilon: float) -> Column:
    moved = current - baseline
    toward = ((target < baseline) & (moved < 0)) | ((target > baseline) & (moved > 0))
    return F.when(current.isNull(), "ungradeable").when(F.abs(moved) < epsilon, "push").when(toward, "correct").otherwise("incorrect")


def grade(predictions: DataFrame, current: DataFrame, key: list[str], as_of: Column, epsilon: float) -> DataFrame:
    """Due open rows re-measured from ``current`` (key, value); the rest unchanged."""
    due = (F.col("outcome") == "open") & (F.col("resolves_by") <= as_of)
    got = predictions.join(current.withColumnRenamed("value", "_now"), key, "left")
    graded = outcome(F.col("baseline"), F.col("target"), F.col("_now"), epsilon)
    return got.withColumns({
        "resolved_value": F.when(due, F.col("_now")), "outcome": F.when(due, graded).otherwise(F.col("outcome")),
    }).drop("_now")


def scorecard(predictions: DataFrame, by: list[str]) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return predictions.groupBy(*by).agg(n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("push").alias("push")).withColumn(
        "accuracy", X.ratio(F.col("correct"), F.col("correct") + F.col("incorrect")))
