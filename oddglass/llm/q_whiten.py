"""Query 11."""

from . import whiten
from .common import table
from .registry import query


@query("op11_whiten")
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    made = whiten.whiten(vectors, whiten.fit(whiten.fit_list(vectors)))
    # A deviation beyond 64 bits (n in the hundreds of millions) is null here; the operator gives it whole.
    return made.selectExpr("vec_id", "component", "n", "try_cast(deviation AS BIGINT) AS deviation", "whitened", "explained", "identity_error")
