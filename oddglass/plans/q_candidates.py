"""Registered queries over the one candidate table: all detectors, emission, board, leads, rerank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import interest as I
from ..operators import lenses as L
from ..operators import scan as S
from ..operators.joins import best_per_key
from . import candidates as CA
from . import q_learn as QE
from . import q_reconcile as QR  # noqa: F401  registers a detector of the table
from . import q_windows as QW
from .q_lenses import l16b
from .q_scan import board_sql
from .registry import ORACLES, expand, query

c = F.col


@query("P0_all_detectors")
def p0(t):
    """Every detector's candidates, each as its detector left it."""
    return CA.candidates(t).select("detector", "kind", "subject", X.r6("interest").alias("interest"))


CA.checked("P0_all_detectors", lambda at: f"SELECT detector, kind, subject, round(interest, 6) AS interest FROM {at} AS c")


@query("P11b_emit_candidates")
def p11b(t):
    """New candidates of enough interest, each once; the leaderboards' were written by an earlier run."""
    found = CA.candidates(t).withColumnRenamed("candidate_id", "finding_id")
    earlier = found.where("detector = 'D3_leaderboard'").select("finding_id")
    got = S.emit(found, earlier, found.select("subject"), "subject", I.EMIT_THRESHOLD)
    return got.groupBy("detector").agg(F.count("*").alias("written"), F.countDistinct("subject").alias("subjects"), X.r6(F.max("interest")).alias("best"))


CA.checked("P11b_emit_candidates", lambda at: f"SELECT detector, count(*) AS written, count(DISTINCT subject) AS subjects, round(max(interest), 6) AS best FROM (SELECT * FROM {at} AS c WHERE interest >= 0.25e0 AND detector <> 'D3_leaderboard') GROUP BY 1")


@query("T6b_board_of_candidates")
def t6b(t):
    """The day's board over all detectors."""
    rows = CA.candidates(t)
    ident = F.concat_ws("-", "detector", "subject", X.rnd(c("interest") * 1000000, 0).cast("bigint").cast("string"))
    rows = rows.select(ident.alias("id"), "detector", "subject", X.r6("interest").alias("score"), X.r6("interest").alias("rank_value")).distinct()
    return I.diversity_board(rows, exploration=2)


def _board(at: str) -> str:
    base = f"SELECT DISTINCT detector || '-' || subject || '-' || CAST(round(interest * 1000000, 0) AS BIGINT) AS id, detector, subject, round(interest, 6) AS score, round(interest, 6) AS rank_value FROM {at} AS c"
    sql = board_sql(2)
    return f"WITH RECURSIVE b AS MATERIALIZED ({base})" + sql[sql.index(",\n e AS"):]


CA.checked("T6b_board_of_candidates", _board)


@query("B2b_leads_from_candidates")
def b2b(t):
    """The strongest candidate of each subject, as a lead for the board."""
    rows = CA.candidates(t).where(c("interest") >= I.EMIT_THRESHOLD).select("kind", "subject", "detector", X.r6("interest").alias("interest"))
    return best_per_key(rows, ["kind", "subject"], c("interest"), [c("detector")])


CA.checked("B2b_leads_from_candidates", lambda at: f"SELECT kind, subject, detector, round(interest, 6) AS interest FROM {at} AS c WHERE interest >= 0.25e0 QUALIFY row_number() OVER (PARTITION BY kind, subject ORDER BY round(interest, 6) DESC, detector) = 1")


# Angle kinds stand for the event types whose posts and reviews the given tables hold.
ANGLES = ("click", "error", "purchase", "signup", "view")
ANGLE_SQL = "CASE CAST(regexp_extract(detector, '[0-9]+') AS INTEGER) % 5 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ANGLES)) + " END"


def angle():
    n = F.regexp_extract("detector", "[0-9]+", 0).cast("int") % 5
    out = F.when(n == 0, ANGLES[0])
    for i, name in enumerate(ANGLES[1:], 1):
        out = out.when(n == i, name)
    return out


@query("G11b_rerank_angles")
def g11b(t):
    """Interest times surprise (by the subject's own past, or the team's against the league), novelty,
    engagement and editorial history, each factor beside it, best first."""
    found = CA.candidates(t).where("detector LIKE 'G%'").select("detector", "kind", "subject", "interest", angle().alias("angle"))
    own = QW.baseline(t).where("current IS NOT NULL AND career IS NOT NULL").select(
        F.lit("player").alias("kind"), c("subject_id").cast("string").alias("subject"), L.self_surprise(c("current") - c("career")).alias("surprise"))
    team = l16b(t).select(F.lit("team").alias("kind"), c("team").cast("string").alias("subject"), c("multiplier").alias("surprise"))
    seen = t.lineitem.where(c("l_shipdate") >= F.lit("2001-10-28").cast("timestamp_ntz")).select(F.lit("player").alias("kind"), c("l_suppkey").cast("string").alias("subject")).distinct().withColumn("novelty", F.lit(0.7))
    engaged = QE.e3(t).select("angle", c("prior").alias("engagement"))
    edited = QE.stats(t).where("feature LIKE 'detector:%'").select(F.substring_index("feature", ":", -1).alias("angle"), X.r6("multiplier").alias("editorial"))
    one = F.lit(1.0)
    got = found.join(own.unionByName(team), ["kind", "subject"], "left").join(seen, ["kind", "subject"], "left").join(engaged, "angle", "left").join(edited, "angle", "left").withColumns({
        k: F.coalesce(k, one) for k in ("surprise", "novelty", "engagement", "editorial")})
    total = c("interest") * c("surprise") * c("novelty") * c("engagement") * c("editorial")
    return got.select("detector", "subject", *[X.r6(k).alias(k) for k in ("surprise", "novelty", "engagement", "editorial")], X.r6(total).alias("interest"))


def _rerank(at: str) -> str:
    return f"""SELECT detector, c.subject, round(coalesce(s.v, 1e0), 6) AS surprise, round(CASE WHEN f.subject IS NULL THEN 1e0 ELSE 0.7e0 END, 6) AS novelty, round(coalesce(g.prior, 1e0), 6) AS engagement, round(coalesce(e.multiplier, 1e0), 6) AS editorial,
 round(interest * coalesce(s.v, 1e0) * CASE WHEN f.subject IS NULL THEN 1e0 ELSE 0.7e0 END * coalesce(g.prior, 1e0) * coalesce(e.multiplier, 1e0), 6) AS interest FROM (SELECT *, {ANGLE_SQL} AS angle FROM {at} AS x WHERE detector LIKE 'G%') c
 LEFT JOIN (SELECT 'player' AS kind, CAST(subject_id AS VARCHAR) AS subject, 0.8e0 + least(0.7e0, abs(current - career) / 0.15e0 * 0.7e0) AS v FROM BASE_SQL WHERE current IS NOT NULL AND career IS NOT NULL UNION ALL SELECT 'team', CAST(team AS VARCHAR), multiplier FROM (TEAM_SQL)) s ON s.kind = c.kind AND s.subject = c.subject
 LEFT JOIN (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS subject FROM lineitem WHERE l_shipdate >= DATE '2001-10-28') f ON c.kind = 'player' AND f.subject = c.subject
 LEFT JOIN (ENGAGED_SQL) g ON g.angle = c.angle LEFT JOIN (EDITED_SQL) e ON e.feature = 'detector:' || c.angle"""


def _register_rerank() -> None:
    CA.checked("G11b_rerank_angles", _rerank)
    sql = ORACLES["G11b_rerank_angles"]
    for name, part in (("BASE_SQL", expand(QW.BASELINE_SQL)), ("TEAM_SQL", ORACLES["L16b_team_surprise"]), ("ENGAGED_SQL", ORACLES["E3_engagement_prior"]), ("EDITED_SQL", ORACLES["E2_editorial_prior"])):
        sql = sql.replace(name, part)
    ORACLES["G11b_rerank_angles"] = sql


_register_rerank()
