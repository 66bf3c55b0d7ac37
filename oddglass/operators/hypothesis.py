"""Proposed metric specs: checked against the schema, run in bulk, outcomes recorded."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lenses as L

OUTCOMES = ("invalid", "coverage_blocked", "no_data", "below_gate", "emitted", "unsupported_window")
LENSES = ("extremeness", "rank")
MAX_WINDOW_DAYS = 120
NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


@dataclass(frozen=True)
class Hypothesis:
    value: str
    how: str = "avg"  # avg for rates, sum for counts
    higher_is_better: bool = True
    window_days: int | None = None
    lens: str = "extremeness"
    stabilization_n: int = 50
    rationale: str = ""

    @property
    def spec_id(self) -> str:
        """Structural identity: the rationale does not count."""
        body = {k: v for k, v in asdict(self).items() if k != "rationale"}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:12]


def enqueue(pending: list[Hypothesis], proposed: list[Hypothesis]) -> list[Hypothesis]:
    """Proposals whose structure is not pending yet, each once."""
    seen = {h.spec_id for h in pending}
    out = []
    for h in proposed:
        if h.spec_id not in seen:
            seen.add(h.spec_id)
            out.append(h)
    return out


def problem(h: Hypothesis, df: DataFrame, day: str | None) -> str | None:
    """Why a spec may not run on ``df``, or None."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", h.value):
        return "invalid"
    types = dict(df.dtypes)
    if types.get(h.value) not in NUMERIC or h.lens not in LENSES or h.how not in ("avg", "sum"):
        return "invalid"
    if h.window_days is not None:
        if not 1 <= h.window_days <= MAX_WINDOW_DAYS:
            return "invalid"
        if day is None:
            return "unsupported_window"
    return None


def check_proposals(proposals: DataFrame, schema: DataFrame, *, windowed: bool = True) -> DataFrame:
    """Each proposal ``column, how, lens, window_days`` with its ``outcome``, in bulk.

    ``schema`` holds the allowed ``column, type``; a name that is no plain identifier is refused
    before it is looked up.
    """
    known = proposals.join(schema.withColumnRenamed("type", "_type"), "column", "left")
    name = F.coalesce(F.col("column").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))
    fits = name & F.coalesce(F.col("_type").isin(*NUMERIC), F.lit(False)) & F.coalesce(F.col("lens").isin(*LENSES) & F.col("how").isin("avg", "sum"), F.lit(False))
    window = F.col("window_days")
    outcome = (
        F.when(~fits | (window.isNotNull() & ~window.between(1, MAX_WINDOW_DAYS)), "invalid")
        .when(window.isNotNull() & F.lit(not windowed), "unsupported_window").otherwise("runnable"))
    return known.withColumn("outcome", outcome).drop("_type")


def schema_of(df: DataFrame) -> DataFrame:
    """The table's own columns and types: a handful of rows."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def record_outcomes(ledger: DataFrame, path: str, run: str) -> None:
    """Write one run's outcomes beside those of earlier runs; a repeated run replaces itself."""
    ledger.write.mode("overwrite").parquet(f"{path}/run={run}")


def outcome_summary(ledger: DataFrame) -> DataFrame:
    """Per spec: its runs, how many emitted, and the last outcome."""
    return ledger.groupBy("metric_id").agg(
        F.count("*").alias("runs"), F.count_if(F.col("outcome") == "emitted").alias("emitted"), F.max_by("outcome", "run").alias("last_outcome"))


def catalog(tables: dict[str, DataFrame], days: dict[str, str]) -> DataFrame:
    """Numeric columns of each table with its newest day: what may be proposed."""
    out = None
    for name, df in tables.items():
        cols = [n for n, t in df.dtypes if t in NUMERIC]
        day = days.get(name)
        newest = F.max(F.col(day)).cast("date") if day else F.lit(None).cast("date")
        one = df.agg(newest.alias("newest")).select(
            F.lit(name).alias("tab"), F.lit(day is not None).alias("windowed"), "newest", F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
        out = one if out is None else out.unionByName(one)
    return out


def population_rows(df: DataFrame, specs: list[Hypothesis], subject: str, day: str, as_of: Column, floor: int) -> DataFrame:
    """All specs' per-subject values from one aggregate over the event table."""
    aggs = []
    for i, h in enumerate(specs):
        use = F.lit(True) if h.window_days is None else (F.col(day) >= F.date_sub(as_of, h.window_days)) & (F.col(day) <= as_of)
        v = F.when(use, F.col(h.value))
        total, k = F.sum(v), F.count(v)
        aggs += [(total / k if h.how == "avg" else total.cast("double")).alias(f"v{i}"), k.alias(f"n{i}")]
    wide = df.groupBy(subject).agg(*aggs)
    cells = [F.struct(
        F.lit(h.spec_id).alias("metric_id"), F.col(f"v{i}").alias("value"), F.col(f"n{i}").alias("n"),
        F.lit(h.higher_is_better).alias("higher"), F.lit(h.stabilization_n).alias("stab")) for i, h in enumerate(specs)]
    return wide.select(F.col(subject).alias("subject_id"), F.inline(F.array(*cells))).where((F.col("n") >= floor) & F.col("value").isNotNull())


def run_specs(df: DataFrame, specs: list[Hypothesis], subject: str, day: str | None, as_of: Column, *, floor: int = 8, population: int = 30, rarity: float = 0.85, max_stale_days: int = 3) -> DataFrame:
    """One ledger row per spec: its outcome and its best hit.

    A spec that may not run is recorded and does not stop the others.  A window whose
    newest row is too old, a thin population and a population with nobody extreme are
    told apart.
    """
    spark = df.sparkSession
    status = [(h.spec_id, problem(h, df, day), h.window_days is not None) for h in specs]
    good = [h for h, s in zip(specs, status) if s[1] is None]
    ledger = spark.createDataFrame(status, "metric_id string, refused string, windowed boolean")
    if not good:
        return ledger.select("metric_id", F.col("refused").alias("outcome"), F.lit(None).cast("bigint").alias("subject_id"), F.lit(None).cast("double").alias("rarity"))
    rows = population_rows(df, good, subject, day, as_of, floor)
    sizes = rows.groupBy("metric_id").agg(F.count("*").alias("pop"))
    of = lambda lens: rows.where(F.col("metric_id").isin([h.spec_id for h in good if h.lens == lens]))
    hits = L.extremeness(of("extremeness"), ["metric_id"]).select("metric_id", "subject_id", "rarity").unionAll(
        L.rank(of("rank"), ["metric_id"]).select("metric_id", "subject_id", "rarity"))
    from .joins import attach_row, best_per_key
    best = best_per_key(hits.select("metric_id", "subject_id", "rarity"), ["metric_id"], F.col("rarity"), [F.col("subject_id")])
    stale = df.agg((F.datediff(as_of, F.max(day).cast("date")) > max_stale_days).alias("stale"))
    out = attach_row(ledger.join(sizes, "metric_id", "left").join(best, "metric_id", "left"), stale)
    outcome = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("windowed") & F.col("stale"), "coverage_blocked")
        .when(F.coalesce("pop", F.lit(0)) < population, "no_data")
        .when(F.coalesce("rarity", F.lit(0.0)) < rarity, "below_gate").otherwise("emitted"))
    return out.select("metric_id", outcome.alias("outcome"), "subject_id", "rarity")
