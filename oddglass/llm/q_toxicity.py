"""Query 9."""

from . import toxicity
from .common import table
from .registry import query


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
