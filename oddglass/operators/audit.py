"""Checks that re-derive or bound every number: texts, structures, sources, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X

# A claim of the first scope may not use the phrases of the second.
SCOPE_RULES = (
    (("this season", "current season", "season_best"),
     ("franchise", "all-time", "all time", "ever", "in history", "statcast era", "since 2015")),
    (("statcast era", "since 2015", "since_2015"),
     ("all-time", "all time", "ever", "in history", "in franchise history")),
    (("franchise record", "franchise history"),
     ("all-time in mlb", "mlb history", "ever in major league", "ever in baseball history")),
)
# What a post should not contain.
MAX_LENGTH = 270
MAX_HASHTAGS = 1
BAIT = (
    "like if", "retweet if", "rt if", "follow for", "like and retweet",
    "smash that", "tag a friend", "drop a follow", "comment below if",
)
TELLS = ("delve", "in the realm of", "it's worth noting", "a testament to", "tapestry", "navigating the", "in today's fast-paced")
# Which failure modes each review lens may report.
LENS_MODES = {
    "statistician": ("arbitrary_endpoint", "cherry_picked_window", "wrong_denominator", "survivorship_population",
                     "sample_too_small", "multiplicity_unaccounted", "correlated_conjunction"),
    "causal": ("causal_no_control", "confounded_comparison"),
    "coverage": ("scope_overreach", "stale_source", "coverage_mismatch", "one_team_as_league"),
    "editor": ("trivial", "tautological", "filter_artifact"),
    "voice": ("voice_tell", "register_mismatch", "jargon_ungloss"),
}
BLOCK_WHEN_UNSURE = ("causal", "coverage")
CONFIDENCE_FLOOR = 0.6


def digit_audit(texts: DataFrame, key: str, text: str, facts: str) -> DataFrame:
    """Number tokens of each text that do not occur in its facts (either zero form counts)."""
    token = F.col("token")
    other = F.when(token.startswith("0."), F.regexp_replace(token, "^0", "")).when(token.startswith("."), F.concat(F.lit("0"), token)).otherwise(token)
    laid = texts.select(key, facts, F.explode(F.array_distinct(X.number_tokens(F.col(text)))).alias("token"))
    return laid.where(~F.col(facts).contains(token) & ~F.col(facts).contains(other)).select(key, "token")


def scope_upgrades(texts: DataFrame, key: str, framing: str, caption: str, club_marks: tuple[str, ...] = ()) -> DataFrame:
    """Phrases of a wider scope than the finding's own.

    ``club_marks`` are further framings of the last, club-wide rule, such as the club's own name.
    """
    f, c = F.lower(framing), F.lower(caption)
    found = []
    for i, (marks, phrases) in enumerate(SCOPE_RULES):
        marks = (*marks, *[m.lower() for m in club_marks]) if i == len(SCOPE_RULES) - 1 else marks
        within = F.lit(False)
        for m in marks:
            within = within | f.contains(m)
        found += [F.when(within & c.contains(p), F.struct(F.lit(i).alias("rule"), F.lit(p).alias("phrase"))) for p in phrases]
    return texts.select(key, F.inline(F.array_compact(F.array(*found))))


def text_lint(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    any_of = lambda words: F.greatest(*[low.contains(w) for w in words])
    return {
        "no_question": ~text.contains("?"), "has_link": low.rlike(r"https?://|www\."),
        "hashtags": F.length(text) - F.length(F.translate(text, "#", "")) > MAX_HASHTAGS,
        "bait": any_of(BAIT), "tell": any_of(TELLS), "too_long": F.length(text) > MAX_LENGTH,
    }


def violations(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row per broken check; an unknown result counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(*key, F.explode(broken).alias("check"))


def reconcile(stated: DataFrame, again: DataFrame, key: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Stated numbers beside a second, differently computed route: the ones that differ."""
    b = again.select(*key, *[F.col(n).alias(f"_{n}") for n in tolerances])
    both = stated.select(*key, *tolerances).join(b, key, "left")
    cells = [F.struct(F.lit(n).alias("number"), F.col(n).cast("double").alias("stated"), F.col(f"_{n}").cast("double").alias("again"), F.lit(tol).alias("tolerance")) for n, tol in tolerances.items()]
    laid = both.select(*key, F.inline(F.array(*cells)))
    return laid.where(F.col("stated").isNotNull() & (F.col("again").isNull() | (F.abs(F.col("stated") - F.col("again")) > F.col("tolerance")))).drop("tolerance")


def rows_differ(stated: DataFrame, again: DataFrame) -> DataFrame:
    """Rows cited but not recomputed, and the other way round."""
    cols = stated.columns
    a = stated.exceptAll(again.select(*cols)).withColumn("side", F.lit("stated_only"))
    b = again.select(*cols).exceptAll(stated).withColumn("side", F.lit("recomputed_only"))
    return a.unionByName(b)


def owns_mode(lens: Column, mode: Column) -> Column:
    ok = F.lit(False)
    for name, modes in LENS_MODES.items():
        ok = ok | ((lens == name) & mode.isin(*modes))
    return ok


def effective_verdict(lens: Column, verdict: Column, confidence: Column) -> Column:
    unsure = (verdict == "PASS") & (confidence < CONFIDENCE_FLOOR) & lens.isin(*BLOCK_WHEN_UNSURE)
    return F.when(unsure, "BLOCK").otherwise(verdict)


def adjudicate(panel: DataFrame, target: str) -> DataFrame:
    """One outcome per target from its lenses' verdicts; broken contracts are counted beside it."""
    e = effective_verdict(F.col("lens"), F.col("verdict"), F.col("confidence"))
    rejects = F.col("verdict").isin("BLOCK", "REVISE")
    broken = (rejects & F.col("failure_mode").isNull()) | (F.col("failure_mode").isNotNull() & ~owns_mode(F.col("lens"), F.col("failure_mode")))
    got = panel.groupBy(target).agg(
        F.count_if(e == "BLOCK").alias("blocks"), F.count_if(e == "REVISE").alias("revises"), F.count("*").alias("lenses"),
        (F.count_if(broken) + F.count("*") - F.countDistinct("lens")).alias("contract_breaks"))
    return got.withColumn("outcome", F.when(F.col("blocks") > 0, "blocked").when(F.col("revises") > 0, "revise").otherwise("cleared"))


def packet_gaps(population: Column, coverage_ok: Column, season: Column, members: Column, peers: Column) -> Column:
    """Names of what a review packet leaves unchecked; two gaps always hold."""
    return F.array_compact(F.array(
        F.when(population.isNull(), "population"), F.when(~coverage_ok, "coverage"), F.when(season.isNull(), "season"),
        F.when((members > 1) & peers.isNull(), "peers"), F.lit("park"), F.lit("defense")))


def stat_tokens(stats: Column) -> Column:
    """The written forms in which a finding's numbers may appear: whole, one and two places, and a rate's three."""
    forms = lambda x: F.array(
        F.format_string("%.0f", F.bround(x["value"], 0)), F.format_string("%.1f", X.rnd(x["value"], 1)), F.format_string("%.2f", X.rnd(x["value"], 2)),
        F.when(x["unit"] == "rate", F.regexp_replace(F.format_string("%.3f", X.rnd(x["value"], 3)), "^0", "")))
    return F.array_compact(F.flatten(F.transform(stats, forms)))


def unbacked(text: Column, stats: Column) -> Column:
    """Number tokens of a text that no stat stands behind, compared as whole tokens: 5 is not backed by 150."""
    return F.array_except(X.number_tokens(text), stat_tokens(stats))


def angle_audit(angles: DataFrame, key: list[str], headline: str, stats: str, reliability: str, tier: str, caveats: str) -> DataFrame:
    """One row per broken check of a finding: its tier, its reliability, its headline's numbers, its corpus."""
    own = F.col(reliability)
    return violations(angles, key, {
        "tier": F.col(tier) == X.reliability_tier(own), "reliability": own.between(0.0, 1.0) & ~F.isnan(own),
        "headline": F.size(unbacked(F.col(headline), F.col(stats))) == 0, "corpus": F.size(stats) > 0, "caveat": F.size(caveats) > 0})
