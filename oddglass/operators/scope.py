"""Strengthened scope: franchise tiers, conjunctions of several metrics, peer counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import settle
from . import ordering as O
from .joins import asof_anchor, best_per_key

MAX_MEMBERS = 3
PEER_CUT = 0.90


def passing_counts(rows: DataFrame, part: list[str], subject: list[str], cut: float) -> DataFrame:
    """Per subject, in how many metrics it is present and in how many it reaches the cut.

    ``rows`` is the long table ``metric_id, value, higher``; the cut is a quantile of
    each metric's live population in the direction that is better.
    """
    turned = rows.withColumn("_t", F.when(F.col("higher"), F.col("value")).otherwise(-F.col("value")))
    cuts = O.quantile_cut(turned.select("metric_id", *part, "_t"), ["metric_id", *part], "_t", cut)
    joined = turned.join(cuts, ["metric_id", *part])
    return joined.groupBy(*part, *subject).agg(
        F.count_if(F.col("_t") >= F.col("cut")).alias("passed"), F.count("*").alias("present"))


def franchise_scope(rows: DataFrame, history: DataFrame, team: str, period: str, subject: str, value: str, higher: bool = True) -> DataFrame:
    """Strongest provable tier of each row: record, or first since an earlier holder.

    A record also adds .05 to the rarity of the finding it strengthens.
    """
    got = asof_anchor(rows, history, team, period, subject, value, higher)
    sign = 1 if higher else -1
    record = F.col("prior_best").isNull() | (F.col(value) * sign > F.col("prior_best") * sign) | F.col("anchor_period").isNull()
    return got.withColumn("tier", F.when(record, "franchise_record").otherwise("first_since"))


def conjunctions(hits: DataFrame, part: list[str], subject: str) -> DataFrame:
    """Subjects rare in at least two skill families: best hit per family, strongest three."""
    skills = hits.withColumn("family", X.metric_family(F.col("metric_id"))).where(F.col("family") != "luck_residual")
    best = best_per_key(skills.select(*part, subject, "family", "metric_id", "rarity"), [*part, subject, "family"], F.col("rarity"), [F.col("metric_id")])
    # At most one row per family is left, nine families and the unmatched metrics.
    w = Window.partitionBy(*part, subject).orderBy(F.desc("rarity"), "metric_id")
    top = best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= MAX_MEMBERS)
    return (
        top.groupBy(*part, subject).agg(
            F.count("*").alias("members"), F.exp(F.avg(F.ln("rarity"))).alias("rarity"),
            F.array_join(F.sort_array(F.collect_list("metric_id")), "+").alias("metrics"))
        .where(F.col("members") >= 2)
    )


def conjunction_peers(groups: DataFrame, rows: DataFrame, part: list[str], subject: str, cut: float = PEER_CUT) -> DataFrame:
    """For each combination of metrics: subjects past the cut in all of them, and the universe.

    A combination is laid out over its (two or three) metrics and meets the subjects of a period
    by an equi-join on period and metric; only metrics that occur in a combination take part. A
    subject counts when it has, or passes, as many of them as the combination is long.
    """
    turned = settle(rows).withColumn("_t", F.when(F.col("higher"), F.col("value")).otherwise(-F.col("value")))
    cuts = O.quantile_cut(turned.select("metric_id", *part, "_t"), ["metric_id", *part], "_t", cut)
    flagged = turned.join(cuts, ["metric_id", *part]).select(*part, subject, "metric_id", (F.col("_t") >= F.col("cut")).cast("int").alias("_p"))
    combos = groups.select(*part, "metrics").distinct().withColumn("_m", F.split("metrics", r"\+"))
    wanted = combos.select(*part, "metrics", F.size("_m").alias("_k"), F.explode("_m").alias("metric_id"))
    seen = flagged.join(wanted, [*part, "metric_id"]).groupBy(*part, "metrics", "_k", subject).agg(F.count("*").alias("_have"), F.sum("_p").alias("_pass"))
    counted = seen.groupBy(*part, "metrics").agg(F.count_if(F.col("_pass") == F.col("_k")).alias("qualifying"), F.count_if(F.col("_have") == F.col("_k")).alias("population"))
    return combos.select(*part, "metrics").join(counted, [*part, "metrics"], "left").fillna(0, ["qualifying", "population"])
