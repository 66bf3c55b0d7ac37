"""Editorial interest as column expressions, and the capped board."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X

# Fixed values of the scoring rules.
BITS_FULL = 6.0
FAMILY_COUNT = 9
MEANINGFUL_GAP_YEARS = 5
RUNNER_UP_SHARE = 0.35
REPEAT_FACTOR = 0.25
EMIT_THRESHOLD = 0.25
BANDS = ((0.70, "strong"), (0.50, "ok"), (0.35, "thin"))
ONE_FAMILY_BITS = math.log2(FAMILY_COUNT)


def surprise(raw_bits: Column, search_bits: Column) -> Column:
    return X.between01(F.greatest(raw_bits - search_bits, F.lit(0.0)) / BITS_FULL)


def evidence_bits(tail_p: Column, search_space: Column) -> tuple[Column, Column]:
    """Bits of a measured tail and of the search that found it; no tail, no bits."""
    raw = F.when(tail_p.isNull(), 0.0).otherwise(X.surprisal_bits(tail_p))
    search = F.when(tail_p.isNull(), 0.0).otherwise(F.log2(F.greatest(search_space, F.lit(1.0))))
    return raw, search


def conjunction_bits(qualifying: Column, population: Column, members: Column) -> tuple[Column, Column]:
    known = qualifying.isNotNull() & (population > 0)
    raw = F.when(known, X.surprisal_bits(qualifying / population)).otherwise(0.0)
    return raw, X.choose_bits(FAMILY_COUNT, F.greatest(F.lit(1), F.least(members, F.lit(FAMILY_COUNT))))


def percentile_bits(percentile: Column, population: Column) -> tuple[Column, Column]:
    tail = F.greatest((100.0 - percentile) / 100.0, 1.0 / population)
    return X.surprisal_bits(tail), F.lit(ONE_FAMILY_BITS)


def contrast_bits(z: Column, gap_percentile: Column, population: Column) -> tuple[Column, Column]:
    """A self-baseline z where there is one, else the gap's percentile, else the median."""
    far = F.greatest((1.0 - X.two_sided_confidence(z)) / 2.0, F.lit(1e-9))
    tail = F.coalesce(F.greatest((100.0 - gap_percentile) / 100.0, 1.0 / population), F.lit(0.5))
    return X.surprisal_bits(F.when(z.isNotNull(), far).otherwise(tail)), F.lit(ONE_FAMILY_BITS)


def roster_max_bits(roster: Column) -> tuple[Column, Column]:
    return F.log2(F.greatest(roster, F.lit(2))), F.lit(ONE_FAMILY_BITS)


def crowded(qualifying: Column, population: Column) -> Column:
    return (qualifying > 1) & (qualifying / population > 0.02)


def stakes(tier: Column, franchise_rank: Column, gap_total: Column, gap: Column, has_milestone: Column, club: Column, games_back: Column) -> Column:
    listed = F.when((tier == "franchise_record") | (franchise_rank == 1), 0.95).when(
        franchise_rank <= 10, X.clamp(0.95 - 0.08 * (franchise_rank - 1), 0.30, 0.95))

    def near(distance: Column, scale: float) -> Column:
        close = X.between01(1.0 - F.abs(distance) / scale)
        return F.when(close > 0.5, 0.55 + 0.4 * close)

    zero = F.lit(0.0)
    return F.greatest(
        F.coalesce(listed, zero), F.coalesce(near(gap_total, 1.0), zero),
        F.coalesce(F.when(has_milestone, near(gap, 25.0)), zero),
        F.coalesce(F.when(club <= 3, 0.75), zero), F.coalesce(X.between01(1.0 - games_back / 15.0), zero))


# Detectors whose occasion is the date itself.
CALENDAR_OCCASION = {"on_this_day": 0.45, "deadline_history": 0.55, "farm_performance": 0.45}


def occasion(detector: Column, streak: Column) -> Column:
    out = F.when(streak.isNotNull(), X.clamp(0.35 + streak / 40.0, 0.0, 0.9))
    for name, value in CALENDAR_OCCASION.items():
        out = out.when(detector == name, value)
    return out.otherwise(0.0)


def tension(has_gap: Column, has_two_sides: Column, has_baseline: Column) -> Column:
    return F.when(has_gap, 0.85).when(has_two_sides, 0.80).when(has_baseline, 0.75).otherwise(0.0)


def legibility(headline: Column, members: Column) -> Column:
    ands = F.size(F.split(F.lower(headline), " and ")) - 1
    score = 1.0 - 0.22 * F.greatest(members - 1, F.lit(0)) - 0.08 * F.greatest(ands - 1, F.lit(0))
    return X.clamp(score - F.when(F.length(headline) > 120, 0.15).otherwise(0.0), 0.1, 1.0)


def since_factor(year: Column, anchor: Column) -> Column:
    gap = year - anchor
    return F.when(gap.isNull() | (gap >= MEANINGFUL_GAP_YEARS), 1.0).otherwise(X.clamp(gap / MEANINGFUL_GAP_YEARS, 0.15, 1.0))


def interest(surprise_: Column, stakes_: Column, tension_: Column, occasion_: Column, legibility_: Column, since: Column, unchanged: Column) -> Column:
    """Best route plus a share of the headroom for the runner-up, gated by legibility."""
    routes = F.reverse(F.array_sort(F.array(surprise_, stakes_, tension_, occasion_)))
    core = routes[0] + (1.0 - routes[0]) * RUNNER_UP_SHARE * routes[1]
    repeat = F.when(unchanged, REPEAT_FACTOR).otherwise(1.0)
    return X.between01(core * (0.55 + 0.45 * legibility_) * since * repeat)


def verdict_band(score: Column) -> Column:
    out = None
    for floor, name in BANDS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.otherwise("boring")


def unchanged_repeat(rows: DataFrame, claim: str, order: list[str]) -> DataFrame:
    """Mark every emission of a claim but its first.

    The first is found by an aggregate, so a claim repeated very often stays spread out.
    """
    first = rows.groupBy(claim).agg(F.min(F.struct(*order)).alias("_first"))
    return rows.join(first, claim).withColumn("unchanged", F.struct(*order) != F.col("_first")).drop("_first")


# Default weights and bonuses of the weighted novelty score.
NOVELTY_WEIGHTS = {"rarity": 0.30, "magnitude": 0.20, "timeliness": 0.20, "rootability": 0.20, "legibility": 0.10}
DETECTOR_BONUS = {"on_this_day": 0.05, "leaderboard": 0.10, "crossjoin": 0.15, "milestone": 0.12}


def weighted_novelty(components: dict[str, Column], detector: Column, weights=NOVELTY_WEIGHTS, bonuses=DETECTOR_BONUS) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(components.get(name, F.lit(0.0)), F.lit(0.0)) * weight
    for name, bonus in bonuses.items():
        total = total + F.when(detector == name, bonus).otherwise(0.0)
    return X.between01(total)


def diversity_board(rows: DataFrame, limit: int = 12, per_detector: int = 3, per_subject: int = 2, exploration: int = 0) -> DataFrame:
    """Best first, at most ``per_detector`` per detector and ``per_subject`` per subject.

    ``rows``: ``id, detector, subject, score, rank_value``.  The greedy walk is not a
    window, but it never looks past the first ``per_subject`` rows of a (detector,
    subject) pair, nor past ``per_detector + per_subject * (limit // per_subject)``
    rows of a detector: full subjects can block no more.  Those two cuts lose nothing
    and leave a few rows per detector for the walk.
    """
    eligible = rows.where(F.col("score") >= BANDS[-1][0])
    if exploration:
        first = eligible.orderBy(F.desc("score"), "id").limit(exploration).select("id").withColumn("explored", F.lit(1))
        eligible = eligible.join(F.broadcast(first), "id", "left").withColumn("explored", F.coalesce("explored", F.lit(0)))
    else:
        eligible = eligible.withColumn("explored", F.lit(0))
    best = [F.desc("explored"), F.desc("rank_value"), F.col("id")]
    pair_limit = F.when(F.col("subject") == "", per_detector).otherwise(min(per_detector, per_subject))
    pair = Window.partitionBy("detector", "subject").orderBy(*best)
    a = eligible.withColumn("_k", F.row_number().over(pair)).where((F.col("_k") <= max(per_detector, per_subject)) & (F.col("_k") <= pair_limit))
    det = Window.partitionBy("detector").orderBy(*best)
    blocked = per_subject * (limit // per_subject)
    trimmed = a.withColumn("_k", F.row_number().over(det)).where(F.col("_k") <= per_detector + blocked).drop("_k")
    return _walk(trimmed, limit, per_detector, per_subject)


def _walk(rows: DataFrame, limit: int, per_detector: int, per_subject: int) -> DataFrame:
    """The greedy walk as a fold over one ordered array, its state the used counts and the rows kept.

    ``rows`` are the few that the cuts before it leave; a subject that is empty or unknown has no limit.
    """
    entry = "struct(-explored AS e, -rank_value AS r, id, detector, coalesce(subject, '') AS subject, score, rank_value, explored)"
    ordered = rows.selectExpr(f"{entry} AS entry").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    element = "struct<e: int, r: double, id: string, detector: string, subject: string, score: double, rank_value: double, explored: int>"
    start = f"named_struct('d', CAST(map() AS map<string, int>), 's', CAST(map() AS map<string, int>), 'kept', CAST(array() AS array<{element}>))"
    used = lambda m, k: f"coalesce(try_element_at(a.{m}, x.{k}), 0)"
    more = lambda m, k: f"map_concat(map_filter(a.{m}, (k, v) -> k <> x.{k}), map(x.{k}, {used(m, k)} + 1))"
    full = f"size(a.kept) >= {limit} OR {used('d', 'detector')} >= {per_detector} OR (x.subject <> '' AND {used('s', 'subject')} >= {per_subject})"
    step = f"CASE WHEN {full} THEN a ELSE named_struct('d', {more('d', 'detector')}, 's', {more('s', 'subject')}, 'kept', concat(a.kept, array(x))) END"
    kept = ordered.selectExpr(f"posexplode(aggregate(CAST(entries AS array<{element}>), {start}, (a, x) -> {step}, a -> a.kept)) AS (at, x)")
    return kept.selectExpr("CAST(at + 1 AS BIGINT) AS slot", "x.id", "x.detector", "x.subject", "x.score", "x.rank_value", "x.explored")
