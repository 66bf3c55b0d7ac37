"""Connected components of a link table, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def stars(edges: DataFrame) -> bool:
    """Is every larger end ``u`` of the distinct edges hung under one ``v``, and no ``v`` under another id?"""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("under"), F.lit(0).alias("over")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("under").alias("under"), F.max("over").alias("over")).where("under + over > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every linked id: ``c`` is the smallest id of its component.

    ``links`` holds pairs (a, b). Union-find without a shared table: every id is hung under the
    smallest id known to be linked with it, first for its larger and then for its smaller
    neighbours, until every component is a star around its smallest id; links that are stars
    already take no round, and each id is in one row. A round is an aggregate (combined before
    the shuffle) and a join that adaptive execution can split, so a star of any width is no
    single task's work. Rounds grow with the logarithm of the longest chain. Null ids are left
    out.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = settled(small)
    return edges.select(F.col("u").alias("v"), F.col("v").alias("c")).unionAll(edges.select("v", F.col("v").alias("c")).distinct())
