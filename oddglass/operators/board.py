"""Board cards, leads and draft states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import best_per_key

# Allowed moves between draft states.
TRANSITIONS = (
    ("pending", "verified"), ("verified", "approved"), ("approved", "posted"),
    ("pending", "rejected"), ("verified", "rejected"), ("approved", "rejected"),
)


def refresh_leads(current: DataFrame, dismissed: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The new leads replace the old ones; dismissed leads stay as they are."""
    kept = current.join(dismissed.select(key).distinct(), key, "left_semi").withColumn("state", F.lit("dismissed"))
    new = fresh.join(dismissed.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("open"))
    return kept.unionByName(new)


def candidate_leads(candidates: DataFrame, subject: str, day: str, score: str, ident: str, as_of: Column, days: int = 2) -> DataFrame:
    """Best candidate per subject among the newest ``days`` days."""
    recent = candidates.where(F.col(day) > F.date_sub(as_of, days))
    return best_per_key(recent, [subject], F.col(score), [F.col(ident)])


def readable_subject(keys: DataFrame, key: str, sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Name of the id inside a key such as ``player:123:x``, from the first table that knows it."""
    out = keys.withColumn("_id", F.regexp_extract(key, r"(\d+)", 1).try_cast("bigint"))
    names = []
    for i, (table, ident, name) in enumerate(sources):
        one = table.groupBy(F.col(ident).cast("bigint").alias("_id")).agg(F.min(name).alias(f"_n{i}"))
        out = out.join(one, "_id", "left")
        names.append(F.col(f"_n{i}"))
    return out.withColumn("readable", F.coalesce(*names, F.col(key))).drop("_id", *[f"_n{i}" for i in range(len(sources))])


def apply_transitions(moves: DataFrame, src: str, dst: str) -> DataFrame:
    """Mark each requested move legal or not."""
    table = moves.sparkSession.createDataFrame(TRANSITIONS, f"{src} string, {dst} string").withColumn("legal", F.lit(True))
    return moves.join(F.broadcast(table), [src, dst], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))  # six rows
