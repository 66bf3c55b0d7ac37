"""All detectors behind one protocol: each a lazy plan, all laid into one candidate table.

A detector is a name, a plan over the tables, the column that names its subject, and its strength
between 0 and 1 as SQL over its own columns.  ``run_all`` writes each detector's candidates as a part
of one table; a detector that fails, while it is planned or while it runs, is recorded with its error
and left out, and never stops the others.  Everything that ranks or writes findings reads that table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .registry import ORACLES, QUERIES, _same_rounding
from .roles import Tables

#: Detectors whose jobs are in the scheduler together.
AT_ONCE = 4
SCHEMA = "candidate_id string, subject string, kind string, payload map<string, string>, interest double, evidence string, detector string"


@dataclass(frozen=True)
class Detector:
    name: str
    run: Callable[[Tables], DataFrame]
    subject: str
    strength: str
    kind: str = "player"  # what the subject is: player, team or period


DETECTORS: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    if detector.name in DETECTORS:
        raise ValueError(f"detector {detector.name} registered twice")
    DETECTORS[detector.name] = detector
    return detector


def get_detector(name: str) -> Detector:
    if name not in DETECTORS:
        raise KeyError(f"no detector {name}; there are {sorted(DETECTORS)}")
    return DETECTORS[name]


def candidate_rows(detector: Detector, t: Tables) -> DataFrame:
    """A detector's findings in the common schema; its own columns become the payload."""
    found = detector.run(t)
    cells = [F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("string").alias("value")) for n in sorted(found.columns)]
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr(detector.strength).cast("double"), F.lit(0.0))))
    laid = found.select(F.expr(detector.subject).cast("string").alias("subject"), F.map_from_entries(F.array(*cells)).alias("payload"), strength.alias("interest"), F.to_json(F.struct(*sorted(found.columns))).alias("evidence"))
    return laid.select(
        F.sha2(F.concat_ws("|", F.lit(detector.name), "subject", "evidence"), 256).alias("candidate_id"), "subject", F.lit(detector.kind).alias("kind"), "payload", "interest", "evidence")


def run_all(t: Tables, path: str, names: Iterable[str] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """Write every detector's candidates under ``path`` and return the ledger: detector, complete, error.

    Detectors do not wait for each other: ``at_once`` of them have their jobs in the scheduler, so that
    the small last stages of one leave no executor idle.
    """

    def one(name: str) -> tuple[str, bool, str | None]:
        try:
            candidate_rows(get_detector(name), t).write.mode("overwrite").parquet(f"{path}/detector={name}")
            return name, True, None
        except Exception as e:  # recorded in the ledger; the other detectors still run
            # what a failed write left behind holds no finished part
            at = t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/detector={name}")
            at.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(at, True)
            return name, False, f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"

    with ThreadPoolExecutor(at_once) as pool:
        ledger = list(pool.map(one, sorted(DETECTORS) if names is None else list(names)))
    return t.spark.createDataFrame(ledger, "detector string, complete boolean, error string")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("basePath", path).parquet(path)


_DONE: dict[tuple[str, str], str] = {}


def candidates(t: Tables) -> DataFrame:
    """The candidate table over these tables, written once in a session and read by all who rank it."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _DONE:
        path = f"{shared_dir(t.spark)}/candidates-{uuid.uuid4().hex[:10]}"
        bad = run_all(t, path).where("NOT complete").collect()
        if bad:
            raise RuntimeError(f"detectors failed: {[(r.detector, r.error) for r in bad]}")
        _DONE[key] = path
    return read_candidates(t.spark, _DONE[key])


def candidates_sql(names: Iterable[str] | None = None) -> str:
    """Check SQL of the table: every detector's own check SQL, laid into detector, kind, subject, interest."""
    parts = []
    for name in sorted(DETECTORS) if names is None else names:
        d = DETECTORS[name]
        parts.append(f"SELECT '{name}' AS detector, '{d.kind}' AS kind, CAST({d.subject} AS VARCHAR) AS subject, greatest(0e0, least(1e0, coalesce(CAST({d.strength} AS DOUBLE), 0e0))) AS interest FROM ({ORACLES[name]}) AS found")
    return "(" + " UNION ALL ".join(parts) + ")"


def checked(name: str, sql: Callable[[str], str]) -> None:
    """Register check SQL made around the candidate table's (which is expanded already)."""
    ORACLES[name] = _same_rounding(sql("@@")).replace("@@", candidates_sql())


def of(name: str) -> Callable[[Tables], DataFrame]:
    """The plan of a registered query."""
    return lambda t: QUERIES[name](t.spark, t.sf_dir)


# Detector, subject, strength, kind of subject.  A ladder's head is worth more than its foot, a smaller
# club more than a large one; percentiles and probabilities stand for themselves.
_LADDER = "0.95e0 - 0.08e0 * (rank - 1)"
_TIER = "CASE tier WHEN 'record' THEN 0.95e0 WHEN 'chase' THEN 0.75e0 ELSE 0.5e0 END"
_BOARD = "1e0 - (rank - 1) / 25e0"
for _name, _subject, _strength, _kind in (
    ("D1_on_this_day_results", "team", "0.45e0", "team"),
    ("D2_on_this_day_transactions", "o_orderkey", "0.45e0", "player"),
    ("D3_leaderboard", "subject_id", _BOARD, "player"),
    ("D4_statcast_profile", "subject_id", "best", "player"),
    ("D5_xstats_unlucky", "subject_id", _BOARD, "player"),
    ("D6_sprint_speed", "subject_id", _BOARD, "player"),
    ("D7_barrel_rate", "subject_id", _BOARD, "player"),
    ("D8_power_cluster", "subject_id", "CASE WHEN is_focal THEN 1e0 / rank ELSE 0e0 END", "player"),
    ("D9_franchise_war_rank", "subject_id", _LADDER, "player"),
    ("D10_milestone_watch", "subject_id", "0.55e0 + 0.4e0 * (1e0 - gap / 2500000e0)", "player"),
    ("D11_first_since", "subject_id", "1e0 / (1 + precedents)", "player"),
    ("D12_career_chase", "subject_id", _TIER, "player"),
    ("D13_pitcher_career_chase", "subject_id", _TIER, "player"),
    ("D14_milestone_club", "subject_id", "1e0 / (1 + club_size)", "player"),
    ("D15_hit_streak", "subject_id", "0.35e0 + games / 40e0", "player"),
    ("D16_cold_streak", "subject_id", "0.35e0 + ab / 40e0", "player"),
    ("D17_weakness", "subject_id", "1e0 - pct", "player"),
    ("D18_career_conjunction", "subject_id", "1e0 / club", "player"),
    ("D19_dollar_per_war", "team", "1e0 / rank", "team"),
    ("D20_trade_war_balance", "gm", "abs(net) / 1000e0", "period"),
    ("D21_division_race", "team", "1e0 - games_back / 15e0", "team"),
    ("D22_deadline_history", "year", "0.55e0", "period"),
    ("D23_farm_performance", "subject_id", "0.5e0", "player"),
    ("D24_scan", "who", "rarity", "player"),
    ("D25_hypothesis", "subject_id", "rarity", "player"),
    ("G1_team_luck", "team", "abs(owed) / 40e0 * reliability", "team"),
    ("G2_manager_case", "team", "abs(owed) / 40e0", "team"),
    ("G3b_manager_cohort", "team", "CASE WHEN fell_further = 0 THEN 0.9e0 WHEN fell_further = 1 THEN 0.7e0 ELSE 0.2e0 END", "team"),
    ("G4_player_luck", "subject_id", "abs(owed) / 60e0", "player"),
    ("G5_approach_outlier", "subject_id", "abs(50 - pct) / 50e0", "player"),
    ("G6_power_outlier", "subject_id", "pct / 100e0", "player"),
    ("G7_change", "user_id", "p_real", "player"),
    ("G8_contact_change", "user_id", "p_real", "player"),
    ("G9_pitcher_luck", "subject_id", "abs(gap) / 2e0", "player"),
    ("G10_league_control", "subject_id", "abs(z) / 4e0", "player"),
):
    register(Detector(_name, of(_name), _subject, _strength, _kind))
