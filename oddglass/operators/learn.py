"""Ranking priors learned from past verdicts, engagement and graded predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .interest import verdict_band
from .joins import attach_row, latest_per_key

# Fixed values of the priors.
BETA = 2.0
MIN_EVIDENCE = 5.0
FEATURE_CLAMP = (0.80, 1.25)
COMBINED_CLAMP = (0.70, 1.40)
EVIDENCE_HALF_LIFE = 90.0
ENGAGEMENT_HALF_LIFE = 45.0
ENGAGEMENT_CLAMP = (0.7, 1.4)
MIN_POSTS = 3
RELIABILITY_PSEUDO = 3.0
RELIABILITY_CLAMP = (0.85, 1.15)


def feature_keys(detector: Column, score: Column, metric: Column, lens: Column, star: Column, members: Column) -> Column:
    """The feature strings of one finding; absent parts are left out."""
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}:"), value))
    return F.array_distinct(F.array_compact(F.array(
        tag("detector", detector), tag("lens", lens), tag("metric_family", X.metric_family(metric)), tag("interest_band", verdict_band(score)),
        F.when(star, "star_tier:star").otherwise("star_tier:regular"), F.when(members > 1, "shape:conjunction"))))


def feature_stats(observations: DataFrame, as_of: Column) -> DataFrame:
    """Decayed Beta(2, 2) approval rate of each feature over the global one, clamped.

    ``observations``: ``features array<string>, positive boolean, observed_at date``.
    """
    w = X.half_life_weight(F.datediff(as_of, F.col("observed_at")), EVIDENCE_HALF_LIFE)
    seen = observations.withColumn("_w", w)
    yes = F.when(F.col("positive"), F.col("_w")).otherwise(0.0)
    everyone = seen.agg(((F.sum(yes) + BETA) / (F.sum("_w") + 2 * BETA)).alias("_global"))
    per = seen.select(F.explode("features").alias("feature"), "_w", yes.alias("_p")).groupBy("feature").agg(F.sum("_p").alias("n_pos"), F.sum("_w").alias("n_total"))
    rate = (F.col("n_pos") + BETA) / (F.col("n_total") + 2 * BETA)
    mult = F.when(F.col("n_total") < MIN_EVIDENCE, 1.0).otherwise(X.clamp(rate / F.col("_global"), *FEATURE_CLAMP))
    return attach_row(per, everyone).select("feature", "n_pos", "n_total", mult.alias("multiplier"))


def combined_prior(items: DataFrame, item: str, stats: DataFrame) -> DataFrame:
    """Log-mean of an item's informative multipliers, clamped; 1 when nothing is known."""
    known = stats.where(F.col("multiplier") != 1.0).select("feature", "multiplier")
    laid = items.select(item, F.explode("features").alias("feature")).join(known, "feature", "left")
    got = laid.groupBy(item).agg(F.avg(F.ln("multiplier")).alias("_m"))
    return got.select(item, F.when(F.col("_m").isNull(), 1.0).otherwise(X.clamp(F.exp("_m"), *COMBINED_CLAMP)).alias("prior"))


def engagement_prior(metrics: DataFrame, post: list[str], stamp: list[str], angle: str, score: str, as_of: Column) -> DataFrame:
    """Mean decayed engagement per angle over the mean of all, neutral under three posts."""
    newest = latest_per_key(metrics, post, stamp)
    decayed = newest.withColumn("_s", F.col(score) * X.half_life_weight(F.datediff(as_of, F.col(stamp[0]).cast("date")), ENGAGEMENT_HALF_LIFE))
    overall = decayed.agg(F.avg("_s").alias("_all"))
    per = decayed.groupBy(angle).agg(F.count("*").alias("posts"), F.avg("_s").alias("_mine"))
    ratio = X.clamp(F.col("_mine") / F.col("_all"), *ENGAGEMENT_CLAMP)
    return attach_row(per, overall).select(angle, "posts", F.when((F.col("posts") < MIN_POSTS) | (F.col("_all") <= 0), 1.0).otherwise(ratio).alias("prior"))


def detector_reliability(correct: Column, graded: Column) -> Column:
    rate = (correct + RELIABILITY_PSEUDO) / (graded + 2 * RELIABILITY_PSEUDO)
    low, high = RELIABILITY_CLAMP
    return F.when(graded <= 0, 1.0).otherwise(X.clamp(1.0 + (rate - 0.5) * 2 * (high - 1.0), low, high))


def snapshot(stats: DataFrame, run_id: str, created_at: Column) -> DataFrame:
    return stats.withColumn("run_id", F.lit(run_id)).withColumn("created_at", created_at)


def newest_run(runs: DataFrame) -> DataFrame:
    """Rows of the newest run only."""
    last = runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    return runs.join(F.broadcast(last), "run_id", "left_semi")  # one row
