"""The generic roles (subject, season, pitch, game, ...) bound to the given tables.

Each role exists twice: as a DataFrame and as the SQL the result check uses.
Money and rates are summed as whole hundredths, so totals do not depend on the
order in which partitions are added up.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
FOCAL_TEAMS = 5  # focal suppliers: the first five nations
FOCAL_TEAM = 0  # focal customers: one nation


def cents_sql(column: str, name: str) -> str:
    """A money or rate column as whole hundredths."""
    return f"floor({column} * 100 + 0.5D) AS {name}"


def in_years(df: DataFrame, day: str, first: int, last: int | None = None) -> DataFrame:
    """Rows of whole calendar years, as day bounds that parquet statistics can use."""
    at = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")
    return df.where((F.col(day) >= at(first)) & (F.col(day) < at((last or first) + 1)))


class Tables:
    """Lazy readers of the given tables and of the roles bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def pitches(self) -> DataFrame:
        return self._pitches(self.lineitem)

    def pitches_in(self, first: int, last: int | None = None) -> DataFrame:
        """Pitches of the seasons ``first .. last``; the day bounds reach the scan."""
        return self._pitches(in_years(self.lineitem, "l_shipdate", first, last))

    def _pitches(self, lines: DataFrame) -> DataFrame:
        """Event grain: one row per line, seen as a pitch to a supplier."""
        qty = "CAST(l_quantity AS INT)"
        return lines.selectExpr(
            "l_suppkey AS subject_id", "l_orderkey AS game_pk", "l_linenumber AS seq", "l_partkey AS part_id",
            "CAST(l_shipdate AS DATE) AS game_date", "year(l_shipdate) AS season", "l_linestatus AS hand",
            "CASE WHEN l_linenumber <= 2 THEN 'FF' WHEN l_linenumber <= 4 THEN 'SL' WHEN l_linenumber <= 6 THEN 'CH' ELSE 'KN' END AS pitch_type",
            "CASE l_returnflag WHEN 'R' THEN 'swinging_strike' WHEN 'A' THEN 'foul' ELSE 'ball' END AS description",
            f"CASE WHEN {qty} <= 25 THEN 1 + ({qty} - 1) % 9 ELSE 11 + {qty} % 4 END AS zone",
            "(l_discount - 0.05D) * 30 AS plate_x", "0.5D + l_tax * 50 AS plate_z", "l_extendedprice / 1000 AS speed",
            cents_sql("l_extendedprice", "price_c"), cents_sql("l_discount", "disc_c"), cents_sql("l_tax", "tax_c"), f"{qty} AS qty")

    @cached_property
    def games(self) -> DataFrame:
        """Game grain: a customer's orders of one day."""
        return self.orders.groupBy(
            F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").cast("date").alias("game_date")
        ).agg(
            *[F.expr(e) for e in (
                "count(1) AS ab", "count_if(o_orderstatus = 'F') AS hits", "count_if(o_orderpriority = '1-URGENT') AS bb",
                "sum(floor(o_totalprice * 100 + 0.5D)) AS price_c")]
        )

    @cached_property
    def seasons(self) -> DataFrame:
        return self._seasons(self.orders)

    def seasons_in(self, first: int, last: int | None = None) -> DataFrame:
        return self._seasons(in_years(self.orders, "o_orderdate", first, last))

    def _seasons(self, orders: DataFrame) -> DataFrame:
        """Season grain: a customer's year, with name and team."""
        per = orders.groupBy(
            F.col("o_custkey").alias("subject_id"), F.year("o_orderdate").alias("year")
        ).agg(
            *[F.expr(e) for e in ("count(1) AS n", "count_if(o_orderstatus = 'F') AS hr", "sum(floor(o_totalprice * 100 + 0.5D)) AS price_c")]
        )
        who = self.customer.select(
            F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team")
        )
        return per.join(who, "subject_id").withColumn("war", F.col("price_c") / 10000000.0)

    @cached_property
    def stats(self) -> DataFrame:
        return self._stats(self.pitches)

    def stats_in(self, first: int, last: int | None = None) -> DataFrame:
        return self._stats(self.pitches_in(first, last))

    def _stats(self, pitches: DataFrame) -> DataFrame:
        """Season grain: a supplier's year with expected and actual rates."""
        swings, k = "count_if(description <> 'ball')", "count_if(description = 'swinging_strike')"
        per = pitches.groupBy("subject_id", F.col("season").alias("year")).agg(*[F.expr(e) for e in (
            "count(1) AS pa", f"{swings} AS swings",
            "sum(disc_c) * 0.064D / count(1) AS woba", "sum(tax_c) * 0.08D / count(1) AS est_woba",
            "sum(disc_c) * 0.05D / count(1) AS ba", "sum(tax_c) * 0.062D / count(1) AS est_ba",
            "sum(qty) / count(1) AS sprint_speed", "sum(price_c) / count(1) / 100000.0D AS exit_velocity",
            "100.0D * count_if(price_c > 8000000) / count(1) AS brl_percent", "100.0D * count_if(price_c > 6000000) / count(1) AS hard_hit_percent",
            f"100.0D * {k} / count(1) AS k_percent", f"100.0D * {k} / nullif({swings}, 0) AS whiff_percent",
            "100.0D * count_if(zone > 9 AND description <> 'ball') / nullif(count_if(zone > 9), 0) AS chase_percent",
        )])
        who = self.supplier.select(
            F.col("s_suppkey").alias("subject_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("team")
        )
        return per.join(who, "subject_id")

    @cached_property
    def live(self) -> DataFrame:
        return self.events.select(
            "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"), "props"
        )

    @cached_property
    def points(self) -> DataFrame:
        e = F.col("embedding")
        return self.embeddings.select(
            "vec_id", "label", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), e[2].cast("double").alias("z"),
        )


ROLE_SQL = {
    "pitches": """
SELECT l_suppkey AS subject_id, l_orderkey AS game_pk, l_linenumber AS seq, l_partkey AS part_id,
  CAST(l_shipdate AS DATE) AS game_date, CAST(year(l_shipdate) AS INTEGER) AS season, l_linestatus AS hand,
  CASE WHEN l_linenumber <= 2 THEN 'FF' WHEN l_linenumber <= 4 THEN 'SL' WHEN l_linenumber <= 6 THEN 'CH' ELSE 'KN' END AS pitch_type,
  CASE l_returnflag WHEN 'R' THEN 'swinging_strike' WHEN 'A' THEN 'foul' ELSE 'ball' END AS description,
  CASE WHEN l_quantity <= 25 THEN 1 + (CAST(l_quantity AS INTEGER) - 1) % 9 ELSE 11 + CAST(l_quantity AS INTEGER) % 4 END AS zone,
  (l_discount - 0.05::DOUBLE) * 30 AS plate_x, 0.5::DOUBLE + l_tax * 50 AS plate_z, l_extendedprice / 1000 AS speed,
  CAST(floor(l_extendedprice * 100 + 0.5::DOUBLE) AS BIGINT) AS price_c, CAST(floor(l_discount * 100 + 0.5::DOUBLE) AS BIGINT) AS disc_c,
  CAST(floor(l_tax * 100 + 0.5::DOUBLE) AS BIGINT) AS tax_c, CAST(l_quantity AS INTEGER) AS qty
FROM lineitem""",
    "games": """
SELECT o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS game_date, count(*) AS ab,
  count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderpriority = '1-URGENT') AS bb,
  CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS price_c
FROM orders GROUP BY 1, 2""",
    "seasons": """
SELECT o_custkey AS subject_id, CAST(year(o_orderdate) AS INTEGER) AS year, c_name AS name, c_nationkey AS team,
  count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hr,
  CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS price_c,
  CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) / 10000000.0::DOUBLE AS war
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3, 4""",
    "stats": """
SELECT q.*, s_name AS name, s_nationkey AS team FROM (
  SELECT subject_id, season AS year, count(*) AS pa, count(*) FILTER (description <> 'ball') AS swings,
    CAST(sum(disc_c) AS BIGINT) * 0.064::DOUBLE / count(*) AS woba, CAST(sum(tax_c) AS BIGINT) * 0.08::DOUBLE / count(*) AS est_woba,
    CAST(sum(disc_c) AS BIGINT) * 0.05::DOUBLE / count(*) AS ba, CAST(sum(tax_c) AS BIGINT) * 0.062::DOUBLE / count(*) AS est_ba,
    CAST(sum(qty) AS BIGINT) / count(*) AS sprint_speed, CAST(sum(price_c) AS BIGINT) / count(*) / 100000.0::DOUBLE AS exit_velocity,
    100.0::DOUBLE * count(*) FILTER (price_c > 8000000) / count(*) AS brl_percent,
    100.0::DOUBLE * count(*) FILTER (price_c > 6000000) / count(*) AS hard_hit_percent,
    100.0::DOUBLE * count(*) FILTER (description = 'swinging_strike') / count(*) AS k_percent,
    100.0::DOUBLE * count(*) FILTER (description = 'swinging_strike') / nullif(count(*) FILTER (description <> 'ball'), 0) AS whiff_percent,
    100.0::DOUBLE * count(*) FILTER (zone > 9 AND description <> 'ball') / nullif(count(*) FILTER (zone > 9), 0) AS chase_percent
  FROM @pitches GROUP BY 1, 2) q JOIN supplier ON s_suppkey = subject_id""",
    "live": "SELECT event_id, user_id, event_type, value, ts, props FROM events",
    "points": """
SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings""",
}
