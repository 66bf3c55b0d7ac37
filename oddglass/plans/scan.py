"""The scan: metric population -> lenses -> floor -> FDR -> dedup -> scope -> conjunctions -> board."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import interest as I
from ..operators import lenses as L
from ..operators.joins import best_per_key
from ..operators.learn import combined_prior
from ..operators.scan import boards_of, collapse_boards, hero_gate
from ..operators.scope import conjunction_peers, conjunctions, franchise_scope
from ..operators.windows import topk_with_exploration
from ..session import settle
from .specs import MetricSpec, ScanConfig

HIT_COLUMNS = ["metric_id", "year", "subject_id", "lens", "value", "rarity", "rank", "pct", "pop_n"]


def apply_lenses(rows: DataFrame, metrics: tuple[MetricSpec, ...], focal: DataFrame, population_floor: int = 30) -> DataFrame:
    """Hits of focal subjects under every lens their metric declares."""
    with_lens = lambda name: [m.id for m in metrics if name in m.lenses]
    pick = lambda df: df.select(*[F.col(k) if k in df.columns else F.lit(None).cast("double" if k == "pct" else "bigint").alias(k) for k in HIT_COLUMNS])
    part = ["metric_id", "year"]
    of = lambda name: rows.where(F.col("metric_id").isin(with_lens(name)))
    found = [
        pick(L.extremeness(of("extremeness"), part)),
        pick(L.rank(of("rank"), part).withColumn("rank", F.col("rank").cast("bigint"))),
    ]
    sizes = rows.groupBy(*part).agg(F.count("*").alias("pop_n"))
    for m in metrics:
        if "milestone_proximity" in m.lenses and m.milestones:
            near = L.milestone_proximity(rows.where(F.col("metric_id") == m.id), "value", list(m.milestones))
            found.append(pick(near.join(sizes, part)))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits.where(F.col("pop_n") >= population_floor).join(focal, "subject_id", "left_semi").select(*HIT_COLUMNS)


def survivors(hits: DataFrame, cfg: ScanConfig) -> DataFrame:
    """False-discovery control by family; ``advisory`` only marks, ``strict`` filters."""
    if cfg.fdr_mode == "off":
        return hits.withColumn("survives", F.lit(True))
    tagged = hits.withColumn("family", X.metric_family(F.col("metric_id"))).withColumn("p", F.bround(1 - F.col("rarity"), 9))
    tested = L.bh(tagged, ["family"], "p", ["metric_id", "subject_id", "year", "lens"], cfg.alpha)
    sizes = tested.groupBy("family").agg(F.max("pop_n").alias("_pop"))
    got = tested.join(sizes, "family").withColumn(
        "survives", F.col("survives") | ~L.bh_feasible(F.col("_pop"), F.col("bh_m"), cfg.alpha)).drop("_pop", "p", "bh_rank", "bh_m", "family")
    return got.where("survives") if cfg.fdr_mode == "strict" else got


@dataclass(frozen=True)
class ScanInputs:
    rows: DataFrame      # metric_id, year, subject_id, value, n, higher, stab: all periods
    focal: DataFrame     # subject_id
    marquee: DataFrame   # subject_id
    team: DataFrame      # subject_id, team
    period: int
    others: DataFrame | None = None  # kind, what, who, rarity: findings of other shapes


def strengthen(hits: DataFrame, inputs: ScanInputs) -> DataFrame:
    """Franchise tier of every hit, by one grouped history lookup for all metrics."""
    sign = F.when(F.col("higher"), F.col("value")).otherwise(-F.col("value"))
    history = inputs.rows.join(inputs.team, "subject_id").select(
        F.concat_ws("|", "metric_id", F.col("team").cast("string")).alias("grp"), "year", "subject_id", sign.alias("turned"))
    ours = hits.join(inputs.rows.select("metric_id", "higher").distinct(), "metric_id").join(inputs.team, "subject_id").withColumn(
        "turned", sign).withColumn("grp", F.concat_ws("|", "metric_id", F.col("team").cast("string")))
    got = franchise_scope(ours, history, "grp", "year", "subject_id", "turned")
    return got.withColumn("rarity", F.when(F.col("tier") == "franchise_record", F.least(F.col("rarity") + 0.05, F.lit(1.0))).otherwise(F.col("rarity"))).select(
        *hits.columns, "tier", "anchor_period")


def scored_findings(inputs: ScanInputs, metrics: tuple[MetricSpec, ...], cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """All findings with their score: conjunctions, boards, heroes and the given others.

    Conjunctions come first and spend their members; a metric with several hits left becomes one
    board and shows no single finding.  ``survives`` is the false-discovery mark of a finding's
    hit (of a board's leader); in strict mode hits without it are gone before anything is built.
    """
    now = settle(inputs.rows.where(F.col("year") == inputs.period))  # one population, five readers
    hits = apply_lenses(now, metrics, inputs.focal, cfg.population_floor).where(F.col("rarity") >= cfg.rarity_floor)
    best = best_per_key(survivors(hits, cfg), ["subject_id", "metric_id", "year"], F.col("rarity"), [F.col("lens")]).select(*HIT_COLUMNS, "survives")
    by_count = F.col("rank").isNotNull() & (F.col("lens") == "rank")
    scoped = settle(strengthen(best, inputs).withColumn(
        "tail_p", F.when(by_count, F.col("rank") / F.col("pop_n")).otherwise(F.greatest(1.0 - F.col("pct"), 1.0 / F.col("pop_n")))))
    none = lambda t: F.lit(None).cast(t)
    groups = settle(conjunctions(scoped, ["year"], "subject_id").where(F.col("rarity") >= cfg.rarity_floor))
    spent = groups.select("subject_id", "year", F.explode(F.split("metrics", r"\+")).alias("metric_id"))
    left = settle(scoped.join(spent, ["subject_id", "year", "metric_id"], "left_anti"))
    boards = boards_of(collapse_boards(left, ["metric_id", "year"], "rarity", "subject_id", cfg.collapse_at), ["metric_id", "year"], ["subject_id", "rarity", "tier", "anchor_period", "tail_p", "survives"])
    finding = ["rarity", "tier", "anchor_period", "tail_p", F.lit(9.0).alias("search_space"), F.lit(1).alias("members"), "survives"]
    who = F.col("subject_id").cast("string").alias("who")
    shown = boards.select(F.lit("board").alias("kind"), F.col("metric_id").alias("what"), who, *finding)
    alone = hero_gate(left.join(boards.select("metric_id", "year"), ["metric_id", "year"], "left_anti"), inputs.marquee, "subject_id", cfg.hero_floor)
    hero = alone.select(F.lit("scan").alias("kind"), F.col("metric_id").alias("what"), who, *finding)
    peers = conjunction_peers(groups, now, ["year"], "subject_id")
    conj = groups.join(peers, ["year", "metrics"]).select(
        F.lit("conjunction").alias("kind"), F.col("metrics").alias("what"), who, "rarity", none("string").alias("tier"),
        none("int").alias("anchor_period"), (F.col("qualifying") / F.col("population")).alias("tail_p"),
        F.pow(F.lit(2.0), X.choose_bits(9, F.col("members"))).alias("search_space"), F.col("members").cast("int").alias("members"), none("boolean").alias("survives"))
    found = hero.unionByName(shown).unionByName(conj)
    if inputs.others is not None:  # contrasts and career shifts: built by their own operators, ranked with the rest
        found = found.unionByName(inputs.others.select(
            "kind", "what", "who", "rarity", none("string").alias("tier"), none("int").alias("anchor_period"), (1.0 - F.col("rarity")).alias("tail_p"),
            F.lit(9.0).alias("search_space"), F.lit(1).alias("members"), none("boolean").alias("survives")))
    raw, search = I.evidence_bits(F.col("tail_p"), F.col("search_space"))
    no = F.lit(None).cast("double")
    score = I.interest(
        I.surprise(raw, search), I.stakes(F.coalesce("tier", F.lit("")), no, no, no, F.lit(False), no, no), F.lit(0.0), F.lit(0.0),
        X.clamp(1.0 - 0.22 * (F.col("members") - 1), 0.1, 1.0), I.since_factor(F.lit(inputs.period), F.col("anchor_period")), F.lit(False))
    return found.withColumn("score", X.r6(score)).withColumn("rarity", X.r6("rarity"))


def run_scan(inputs: ScanInputs, metrics: tuple[MetricSpec, ...], cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """The ``top_k`` findings by score."""
    return scored_findings(inputs, metrics, cfg).orderBy(F.desc("score"), "kind", "what", "who").limit(cfg.top_k)


def run_scan_learned(inputs: ScanInputs, metrics: tuple[MetricSpec, ...], cfg: ScanConfig, features: Column, learned: DataFrame) -> DataFrame:
    """The ``top_k`` findings by score times what was learned about their features.

    ``learned`` has a multiplier per feature; ``exploration`` slots go to the best raw scores first,
    so that findings of an unloved kind are still seen.  Adds prior, adjusted, slot and explored.
    """
    found = settle(scored_findings(inputs, metrics, cfg).withColumn("item", F.concat_ws("|", "kind", "what", "who")))
    prior = combined_prior(found.select("item", features.alias("features")), "item", learned)
    ranked = found.join(prior, "item").withColumn("adjusted", X.r6(F.col("score") * F.col("prior")))
    return topk_with_exploration(settle(ranked), "item", "adjusted", "score", cfg.top_k, cfg.exploration)
