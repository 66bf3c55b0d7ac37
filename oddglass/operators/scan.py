"""Steps of the scan: collapse, gates, evidence, scope strengthening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from . import ordering as O


def collapse_boards(hits: DataFrame, keys: list[str], score: str, subject: str, at_least: int = 3) -> DataFrame:
    """Metrics with several focal hits become one ranked row set: a row per subject with its place.

    Nothing is collected: places come from ordered buckets, however many subjects a metric has.
    """
    placed = O.ordinal(hits.withColumn("_o", -F.col(score)), keys, ["_o", subject], out="place", size="hits", few_parts=set(keys) <= O.LISTED)
    return placed.drop("_o").where(F.col("hits") >= at_least)


def boards_of(rows: DataFrame, keys: list[str], leader: list[str]) -> DataFrame:
    """One row per board: how many subjects it ranks, and its leader's columns."""
    top = rows.groupBy(*keys).agg(F.max("hits").alias("hits"), F.min_by(F.struct(*leader), "place").alias("_top"))
    return top.select(*keys, "hits", "_top.*")


def hero_gate(hits: DataFrame, marquee: DataFrame, subject: str, floor: float = 0.95) -> DataFrame:
    """Standing alone needs extremeness at the floor or a marquee subject."""
    marked = hits.join(marquee.select(subject).distinct().withColumn("_m", F.lit(True)), subject, "left")
    return marked.where(((F.col("lens") == "extremeness") & (F.col("rarity") >= floor)) | F.col("_m").isNotNull()).drop("_m")


def rank_evidence(rank, pop):
    return F.struct(F.lit("rank").alias("kind"), rank.cast("bigint").alias("qualifying"), pop.cast("bigint").alias("population"),
                    (rank / pop).alias("tail_p"), F.lit(1.0).alias("search_space"))


def tail_evidence(pct, pop):
    tail = F.greatest(1.0 - pct, 1.0 / pop)
    return F.struct(F.lit("tail").alias("kind"), F.lit(None).cast("bigint").alias("qualifying"), pop.cast("bigint").alias("population"),
                    tail.alias("tail_p"), F.lit(1.0).alias("search_space"))


def conjunction_evidence(qualifying, population, members):
    return F.struct(F.lit("conjunction").alias("kind"), qualifying.cast("bigint").alias("qualifying"), population.cast("bigint").alias("population"),
                    X.ratio(qualifying, population).alias("tail_p"), F.pow(F.lit(2.0), X.choose_bits(9, members)).alias("search_space"))


def emit(findings: DataFrame, existing: DataFrame, members: DataFrame, subject: str, threshold: float) -> DataFrame:
    """Findings to write: of enough interest, and new by their ``finding_id``, each once.

    A finding about somebody outside ``members`` is a fault of its detector and stops the run.
    """
    known = findings.join(members.select(subject).distinct().withColumn("_in", F.lit(True)), subject, "left")
    checked = known.withColumn("_ok", F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("not a member: "), F.col(subject).cast("string"))).cast("boolean")).otherwise(True))
    good = checked.where(F.col("_ok") & (F.col("interest") >= threshold)).drop("_in", "_ok")
    return good.join(existing.select("finding_id").distinct(), "finding_id", "left_anti").dropDuplicates(["finding_id"])
