"""Coverage audit: what each table holds and which claims it can carry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import period_column


@dataclass(frozen=True)
class Domain:
    name: str
    subject: str
    least: int
    supports: tuple[str, ...]
    day: str | None = None
    needs_current: bool = True
    needs_baseline: bool = False


# Claims that compare seasons need at least two.
CHANGE_CLAIMS = ("career_baseline", "game_trend", "contact_trend", "approach_trend")
DOMAINS = (
    Domain("season_batting", "subject_id", 20, ("career_baseline",)),
    Domain("expected", "subject_id", 100, ("season_luck",)),
    Domain("percentile_ranks", "subject_id", 100, ("approach_state", "swing_path_state"), needs_baseline=True),
    Domain("game_batting", "subject_id", 10, ("game_trend",), day="game_date"),
    Domain("batted_balls", "subject_id", 20, ("contact_trend",), day="game_date"),
    Domain("pitch_level", "subject_id", 20, ("approach_trend",), day="game_date"),
)


def inspect(df: DataFrame | None, domain: Domain, current: int, spark) -> DataFrame:
    """One row: rows, seasons, newest season and day, subjects, status."""
    schema = "domain string, n_rows long, seasons long, newest int, has_current boolean, latest date, subjects long"
    if df is None:
        got = spark.createDataFrame([(domain.name, None, None, None, None, None, None)], schema)
    else:
        period = period_column(df)
        latest = F.max(domain.day).cast("date") if domain.day else F.lit(None).cast("date")
        # Seasons are few; subjects are counted exactly through their own shuffle.
        got = df.agg(
            F.count("*").alias("n_rows"), F.countDistinct(period).alias("seasons"), F.max(period).cast("int").alias("newest"),
            F.max(F.col(period) == current).alias("has_current"), latest.alias("latest"), F.countDistinct(domain.subject).alias("subjects"),
        ).select(F.lit(domain.name).alias("domain"), "*")
    status = (
        F.when(F.col("n_rows").isNull(), "MISSING").when(F.col("n_rows") == 0, "EMPTY")
        .when(F.lit(domain.needs_current) & (F.col("seasons") > 0) & ~F.col("has_current"), "STALE")
        .when((F.col("subjects") > 0) & (F.col("subjects") < domain.least), "PARTIAL").otherwise("OK")
    )
    return got.withColumn("status", status).withColumn("supports", F.array(*[F.lit(s) for s in domain.supports]))


def audit(tables: dict[str, DataFrame], current: int, spark, domains=DOMAINS) -> DataFrame:
    out = None
    for d in domains:
        one = inspect(tables.get(d.name), d, current, spark)
        out = one if out is None else out.unionByName(one)
    return out


def can_support(report: DataFrame) -> DataFrame:
    """Each capability with whether it is backed; change claims need two seasons."""
    laid = report.select("domain", "status", "seasons", F.explode("supports").alias("capability"))
    change = F.col("capability").isin(*CHANGE_CLAIMS)
    return laid.withColumn("backed", (F.col("status") == "OK") & (~change | (F.col("seasons") >= 2))).drop("seasons")
