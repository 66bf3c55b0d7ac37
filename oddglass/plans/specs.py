"""Metric, population and scan settings: small frozen records held by the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENSES = ("extremeness", "rank", "pace", "milestone_proximity", "percentile_elite", "split_contrast")
NUMERIC_TYPES = ("int", "bigint", "float", "double", "smallint", "tinyint")
# Columns of a season table that are never metrics.
SKIP_COLUMNS = (
    "player_id", "year", "season", "team_id", "ingested_at", "pa", "bip", "attempts", "competitive_runs", "brl", "barrels",
)


@dataclass(frozen=True)
class MetricSpec:
    id: str
    label: str = ""
    value: str | None = None
    derived: str | None = None
    higher_is_better: bool = True
    population: str | None = None
    lenses: tuple[str, ...] = ("extremeness", "rank")
    stabilization_n: int = 100
    milestones: tuple[float, ...] = ()
    filter: str | None = None

    def expression(self) -> Column:
        return F.expr(self.derived) if self.derived else F.col(self.value)


@dataclass(frozen=True)
class PopulationSpec:
    id: str
    filter: str


@dataclass(frozen=True)
class ScanConfig:
    top_k: int = 12
    alpha: float = 0.05
    fdr_mode: str = "advisory"
    population_floor: int = 30
    rarity_floor: float = 0.85
    exploration: int = 2
    collapse_at: int = 3
    hero_floor: float = 0.95


@dataclass(frozen=True)
class Registry:
    metrics: tuple[MetricSpec, ...]
    populations: dict[str, PopulationSpec] = field(default_factory=dict)
    scan: ScanConfig = ScanConfig()


def load_registry(path: str | Path = Path(__file__).with_name("metrics.toml")) -> Registry:
    raw = tomllib.loads(Path(path).read_text())
    populations = {p["id"]: PopulationSpec(p["id"], p["filter"]) for p in raw.get("population", [])}
    metrics = []
    for m in raw.get("metric", []):
        unknown = set(m.get("lenses", [])) - set(LENSES)
        if unknown:
            raise ValueError(f"metric {m['id']}: unknown lenses {sorted(unknown)}")
        metrics.append(
            MetricSpec(
                id=m["id"], label=m.get("label", m["id"]), value=m.get("value"), derived=m.get("derived"),
                higher_is_better=m.get("direction", "higher") == "higher", population=m.get("population"),
                lenses=tuple(m.get("lenses", ("extremeness", "rank"))), stabilization_n=m.get("stabilization_n", 100),
                milestones=tuple(m.get("milestones", ())), filter=m.get("filter"),
            )
        )
    return Registry(tuple(metrics), populations, ScanConfig(**raw.get("scan", {})))


def discover_metrics(df: DataFrame, skip: tuple[str, ...] = SKIP_COLUMNS) -> list[MetricSpec]:
    """One percentile metric per numeric column, plus the expected-minus-actual gaps."""
    numeric = [n for n, t in df.dtypes if t in NUMERIC_TYPES and n not in skip]
    specs = [MetricSpec(id=f"pctl_{n}", label=n.replace("_", " ").title(), value=n, lenses=("percentile_elite", "rank")) for n in numeric]
    for actual, expected, formula in (("woba", "est_woba", "est_woba - woba"), ("era", "xera", "era - xera")):
        if actual in df.columns and expected in df.columns:
            specs.append(MetricSpec(id=f"gap_{actual}", label=f"{actual} gap", derived=formula, filter="pa >= 50"))
    return specs


def metric_rows(df: DataFrame, specs, keys: list[str], n: str = "pa", populations: dict[str, PopulationSpec] | None = None) -> DataFrame:
    """Long table ``metric_id, keys, value, n``: every metric of every row in one pass."""
    cells = []
    for m in specs:
        keep = F.lit(True)
        pop = (populations or {}).get(m.population) if m.population else None
        for text in (m.filter, pop.filter if pop else None):
            if text:
                keep = keep & F.expr(text)
        cells.append(F.struct(
            F.lit(m.id).alias("metric_id"), F.when(keep, m.expression().cast("double")).alias("value"), F.col(n).cast("bigint").alias("n"),
            F.lit(m.higher_is_better).alias("higher"), F.lit(m.stabilization_n).alias("stab"),
        ))
    return df.select(*keys, F.inline(F.array(*cells))).where(F.col("value").isNotNull())
