"""Second routes: every stated number derived again by a way that shares no expression with the first.

``operators.audit.reconcile`` lays the two answers side by side; this module makes the second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering as O


# ---- windows ------------------------------------------------------------------
def sums_between(rows: DataFrame, part: list[str], order: list[str], amounts: dict[str, str], cited: DataFrame, window: str = "window") -> DataFrame:
    """Sums over cited stretches of each key's ordered rows, from one cumulative sum.

    ``cited`` has the key, the name of a ``window`` and, for every order column, ``first_<col>`` and
    ``last_<col>``: the first and last row that the finding names.  The sum of a stretch is the
    cumulative sum behind its last row less the one before its first, so however many windows are
    cited, the rows are added up once.  A cited end that is not a row of its key gives null sums.
    """
    cum = O.running_totals(rows, part, order, amounts)
    at = cum.selectExpr(*[f"`{c}`" for c in [*part, *order]], *[f"before_{n} AS _lo_{n}" for n in amounts], *[f"before_{n} + ({a}) AS _hi_{n}" for n, a in amounts.items()])
    low = at.select(*part, *[F.col(o).alias(f"first_{o}") for o in order], *[f"_lo_{n}" for n in amounts])
    high = at.select(*part, *[F.col(o).alias(f"last_{o}") for o in order], *[f"_hi_{n}" for n in amounts])
    both = cited.join(low, [*part, *[f"first_{o}" for o in order]], "left").join(high, [*part, *[f"last_{o}" for o in order]], "left")
    return both.selectExpr(*[f"`{p}`" for p in part], f"`{window}`", *[f"_hi_{n} - _lo_{n} AS {n}" for n in amounts])


def cited_ends(rows: DataFrame, keys: list[str], order: list[str], window: str = "window") -> DataFrame:
    """The first and last row of each stretch: what a finding cites beside its numbers."""
    at = F.struct(*order)
    ends = rows.groupBy(*keys, window).agg(F.min(at).alias("_a"), F.max(at).alias("_z"))
    return ends.select(*keys, window, *[F.col(f"_a.{o}").alias(f"first_{o}") for o in order], *[F.col(f"_z.{o}").alias(f"last_{o}") for o in order])


# ---- row sets -----------------------------------------------------------------
def digest(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """An order-free digest of each key's rows: their number, and the sum and the xor of their hashes.

    Repeated rows count (the sum sees a doubled row that the xor loses).  Parts add up, so a hot
    key is digested in all tasks and only three numbers are sent.
    """
    h = F.xxhash64(*columns)
    return rows.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).alias("hash_sum"), F.expr(f"bit_xor(xxhash64({O._names(columns)}))").alias("hash_xor"))


def drifted(cited: DataFrame, rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Keys whose rows are no longer those of the cited digest, with both row counts."""
    now = digest(rows, key, columns).selectExpr(*[f"`{k}`" for k in key], "rows AS rows_now", "hash_sum AS _s", "hash_xor AS _x")
    both = cited.join(now, key, "full_outer")
    same = F.col("hash_sum").eqNullSafe(F.col("_s")) & F.col("hash_xor").eqNullSafe(F.col("_x")) & F.col("rows").eqNullSafe(F.col("rows_now"))
    return both.where(~same).select(*key, F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows_cited"), F.coalesce("rows_now", F.lit(0).cast("bigint")).alias("rows_now"))


def drift_rows(source: DataFrame, rows: DataFrame, key: list[str], columns: list[str], entity: list[str]) -> DataFrame:
    """The rows behind a drifted digest: each as dropped, doubled, changed or added.

    ``entity`` names what a row is about: a row of it on either side whose values differ was changed.
    Only rows of drifted keys are compared.
    """
    gone = drifted(digest(source, key, columns), rows, key, columns).select(*key)
    count = lambda df, name: df.join(gone, key, "left_semi").groupBy(*key, *columns).agg(F.count("*").alias(name))
    names = [*key, *columns]
    both = count(source, "_a").withColumn("_b", F.lit(0).cast("bigint")).unionByName(count(rows, "_b").withColumn("_a", F.lit(0).cast("bigint"))).groupBy(*names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a <> _b")
    per = both.groupBy(*key, *entity).agg(F.sum("_a").alias("cited"), F.sum("_b").alias("drawn"), F.count_if(F.col("_a") > F.col("_b")).alias("_less"), F.count_if(F.col("_b") > F.col("_a")).alias("_more"))
    kind = F.when((F.col("_less") > 0) & (F.col("_more") > 0), "changed").when(F.col("cited") == 0, "added").when(F.col("_more") > 0, "doubled").otherwise("dropped")
    return per.select(*key, *entity, kind.alias("kind"), "cited", "drawn")


# ---- player and pitcher -----------------------------------------------------------
def pulled_by_rows(rows: DataFrame, key: list[str], value: Column, n: Column, center: Column, k: float) -> DataFrame:
    """A small-sample pull written as data: each key gets ``k`` more observations at the center, then one weighted mean."""
    own = rows.select(*key, value.alias("_v"), n.cast("double").alias("_w"))
    more = rows.select(*key, center.alias("_v"), F.lit(float(k)).alias("_w"))
    return own.unionByName(more).groupBy(*key).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("pulled"))


def weighted_events(events: DataFrame, key: list[str], weights: DataFrame, kind: str) -> DataFrame:
    """Per key, the sum of each event's weight: a linear formula as a join with its weight table."""
    return events.join(F.broadcast(weights), kind).groupBy(*key).agg(F.sum("weight").alias("weighted"))  # one row for each kind


# ---- ranks ----------------------------------------------------------------------
def at_stated_rank(stated: DataFrame, found: DataFrame, keys: list[str], rank: str, value: str, tolerances: dict[str, float], kind: str, default: float = 0.0) -> DataFrame:
    """Stated (rank, value) pairs beside the value that the source holds at that rank.

    Tolerances go by the class of the number (``kind``): a count must match exactly, a rate to its
    last shown digit.  ``verdict`` is ok, mismatch, or missing where the source has no such rank.
    """
    allowed = F.lit(default)
    for name, tol in tolerances.items():
        allowed = F.when(F.col(kind) == name, F.lit(tol)).otherwise(allowed)
    both = stated.join(found.select(*keys, rank, "at_rank").distinct(), [*keys, rank], "left").withColumn("tolerance", allowed)
    off = F.abs(F.col(value) - F.col("at_rank")) > F.col("tolerance") + 1e-9
    verdict = F.when(F.col("at_rank").isNull() | F.col(value).isNull(), "missing").when(off, "mismatch").otherwise("ok")
    return both.withColumn("verdict", verdict)
