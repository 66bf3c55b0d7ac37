"""A fixed decomposition of a gap: each question ends fired, quiet or insufficient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import ordering as O

GAP_FIRED_U = 20000  # millionths
COMPONENT_SHARE = 0.4
CONTACT_PERCENTILE = 0.6
APPROACH_Z = 1.0
NET_EFFECT = 0.010
PANEL_NODES = ("gap", "components", "contact", "approach")


def verdict(enough: Column, fired: Column) -> Column:
    return F.when(~enough | enough.isNull(), "insufficient").when(fired, "fired").otherwise("quiet")


def gap_node(season: DataFrame, min_pa: int) -> DataFrame:
    """``subject_id, pa, gap_u``: percentile of the gap's size among the qualified."""
    ok = season.where(F.col("pa") >= min_pa).withColumn("size_u", F.abs("gap_u"))
    ranked = O.ecdf(ok, [], "size_u").select("subject_id", "gap_u", X.rnd(F.col("pct") * 100, 0).alias("gap_percentile"), "pop_n")
    return season.select("subject_id", "pa").join(ranked, "subject_id", "left").withColumn(
        "verdict", verdict(F.col("pop_n").isNotNull(), F.abs("gap_u") >= GAP_FIRED_U))


def components_node(season: DataFrame) -> DataFrame:
    """Where the gap lives: in the average, in the power, or in both."""
    total = F.col("ba_gap_u") + F.col("slg_gap_u")
    share = X.ratio(F.col("ba_gap_u"), total)
    carrier = F.when(share >= 1 - COMPONENT_SHARE, "average").when(share <= COMPONENT_SHARE, "power").when(share.isNotNull(), "both")
    return season.withColumn("share", share).withColumn("carrier", carrier).withColumn(
        "verdict", verdict(F.lit(True), total > 0)).select("subject_id", "share", "carrier", "verdict")


def contact_node(season: DataFrame, speed: str, barrel: str, attempts: str, floor: int = 50, population: int = 30) -> DataFrame:
    ok = season.where((F.col(attempts) >= floor) & F.col(speed).isNotNull())
    ranked = O.ecdf(O.ecdf(ok.select("subject_id", speed, barrel), [], speed, out="ev_pct"), [], barrel, out="brl_pct", size="_pop")
    return season.select("subject_id").join(ranked.select("subject_id", "ev_pct", "brl_pct", "pop_n"), "subject_id", "left").withColumn(
        "verdict", verdict(F.col("pop_n") >= population, (F.col("ev_pct") >= CONTACT_PERCENTILE) | (F.col("brl_pct") >= CONTACT_PERCENTILE)))


def approach_node(subjects: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` from a year-over-year z (absent when the cohort is too thin)."""
    return subjects.join(moves.select("subject_id", "delta", "z", "cohort"), "subject_id", "left").withColumn(
        "verdict", verdict(F.col("z").isNotNull(), F.abs("z") >= APPROACH_Z))


def comps_node(subjects: DataFrame, matched: DataFrame, least: int = 20) -> DataFrame:
    enough = (F.col("treated_n") >= least) & (F.col("control_n") >= least)
    return subjects.join(matched, "subject_id", "left").withColumn("verdict", verdict(enough, F.abs("net") >= NET_EFFECT))


def dossier(nodes: dict[str, DataFrame]) -> DataFrame:
    """One row per subject: counts of verdicts and a digest over the sorted node verdicts."""
    long = None
    for name, df in nodes.items():
        part = df.select("subject_id", F.lit(name).alias("node"), "verdict")
        long = part if long is None else long.unionByName(part)
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "node", "verdict")))  # one entry per node
    return long.groupBy("subject_id").agg(
        F.count_if(F.col("verdict") == "fired").alias("fired"), F.count_if(F.col("verdict") == "insufficient").alias("insufficient"),
        F.count_if((F.col("verdict") == "fired") & F.col("node").isin(*PANEL_NODES)).alias("panels"),
        F.max(F.when(F.col("node") == "gap", F.col("verdict") == "fired")).alias("gap_fired"),
        F.substring(F.sha2(F.array_join(lines, ","), 256), 1, 16).alias("digest"))


def publishable(dossiers: DataFrame, panels: int = 3) -> DataFrame:
    return dossiers.where(F.col("gap_fired") & (F.col("panels") >= panels))
