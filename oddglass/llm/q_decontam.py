"""Query 4."""

from . import decontam
from .common import table
from .registry import query


@query("op4_decontam")
def op4(spark, sf_dir):
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage")
