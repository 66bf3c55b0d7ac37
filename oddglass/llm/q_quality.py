"""Query 3."""

from . import quality
from .common import table
from .registry import query


@query("op3_quality")
def op3(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
