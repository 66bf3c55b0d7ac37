"""Joins of the data model: each one an equi-join, so skew handling applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate beside every row, as a scalar subquery.

    ``one_row`` has at most one row; when it has none (a gate failed) nothing is left.
    """
    row = one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).where(F.col("_row").isNotNull()).select(*df.columns, "_row.*")


def next_period(rows: DataFrame, subject: str, period: str, bring: dict[str, str]) -> DataFrame:
    """Each season beside the same subject's next one."""
    later = rows.select(subject, (F.col(period) - 1).alias(period), *[F.col(a).alias(b) for a, b in bring.items()])
    return rows.join(later, [subject, period])


def window_sum_by_direction(
    legs: DataFrame, seasons: DataFrame, leg_keys: list[str], subject: str, start: str, period: str, value: str, years: int
) -> DataFrame:
    """Left join of a leg to the subject's seasons ``start .. start+years-1``.

    Each leg is laid out over its few calendar years first, so the range condition
    becomes an equi-join on (subject, period).  Output has one row per leg-year.
    """
    laid = legs.withColumn(period, F.explode(F.sequence(F.col(start), F.col(start) + (years - 1))))
    return laid.join(seasons.select(subject, period, value, *[c for c in seasons.columns if c not in (subject, period, value, *legs.columns)]), [subject, period], "left")


def latest_per_key(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Newest row per key by a partial aggregate: a hot key is cut down before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return best.select(*keys, "_r.*")


def best_per_key(rows: DataFrame, keys: list[str], score: Column, ties: list[Column]) -> DataFrame:
    """Row with the highest score per key; ``ties`` are ascending."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-score).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])).alias("_r"))
    return best.select(*keys, "_r.*")


def prior_holders(history: DataFrame, team: str, period: str, subject: str, value: str, higher: bool = True) -> DataFrame:
    """Per team, an array with one entry per period: its best holder and best other holder.

    Bounded by the number of calendar periods, whatever the number of subjects.
    """
    sign = 1 if higher else -1
    ranked = history.where(F.col(value).isNotNull()).groupBy(team, period, subject).agg(F.max(F.col(value) * sign).alias("_v"))
    # The best two of a team's period; each task cuts its own rows down before it sends any.
    place = F.row_number().over(Window.partitionBy(team, period).orderBy(F.desc("_v"), subject))
    top = ranked.withColumn("_k", place).where(F.col("_k") <= 2)
    of = lambda k, col: F.max(F.when(F.col("_k") == k, F.col(col)))
    per = top.groupBy(team, period).agg(of(1, subject).alias("id1"), of(1, "_v").alias("v1"), of(2, subject).alias("id2"), of(2, "_v").alias("v2"))
    entry = F.struct(F.col(period).alias("period"), "id1", "v1", "id2", "v2")
    return per.groupBy(team).agg(F.array_sort(F.collect_list(entry)).alias("_hist"))


def asof_anchor(rows: DataFrame, history: DataFrame, team: str, period: str, subject: str, value: str, higher: bool = True, row_value: str | None = None) -> DataFrame:
    """Most recent earlier season by another subject of the team that matched or beat the row.

    Adds ``prior_best`` (best earlier value by another), ``prior_best_id``,
    ``anchor_period`` and ``anchor_id``; null when there is none.  ``row_value`` names the
    rows' own column where it differs from the history's.
    """
    sign = 1 if higher else -1
    mine = F.col(row_value or value) * sign
    who = lambda h: F.when(h.id1 != F.col(subject), h.id1).otherwise(h.id2)
    how = lambda h: F.when(h.id1 != F.col(subject), h.v1).otherwise(h.v2)
    joined = rows.join(prior_holders(history, team, period, subject, value, higher), team, "left")
    past = F.transform(
        F.filter("_hist", lambda h: h.period < F.col(period)),
        lambda h: F.struct(h.period.alias("period"), who(h).alias("id"), how(h).alias("v")),
    )
    past = F.filter(past, lambda h: h.v.isNotNull())
    joined = joined.withColumn("_past", past)
    best = F.array_max(F.transform("_past", lambda h: F.struct(h.v.alias("v"), (-h.period).alias("p"), (-h.id).alias("o"))))
    hit = F.array_max(F.transform(F.filter("_past", lambda h: h.v >= mine), lambda h: F.struct(h.period.alias("p"), h.v.alias("v"), (-h.id).alias("o"))))
    return (
        joined.withColumn("_best", best).withColumn("_hit", hit)
        .select(
            *rows.columns,
            (F.col("_best.v") * sign).alias("prior_best"), (-F.col("_best.o")).alias("prior_best_id"),
            F.col("_hit.p").alias("anchor_period"), (-F.col("_hit.o")).alias("anchor_id"),
        )
    )


def first_of_partition(df: DataFrame, part: list[str], order: list[Column], bring: dict[str, str]) -> DataFrame:
    """Bring columns of the first row of each partition to all its rows (small partitions)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumns({new: F.first(src).over(w) for src, new in bring.items()})


#: Rows that one task groups, about; its hash tables of them take some hundred MB at most.
ROWS_TOGETHER = 250_000


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by key to as many tasks as their number asks for.

    Adaptive execution joins small shuffle partitions by their packed size, and the hash tables of
    one task then grow with the input; a number that is asked for is kept, and grows instead.
    """
    return rows.repartition(max(1, -(-rows.count() // ROWS_TOGETHER)), *keys)
