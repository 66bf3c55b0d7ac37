"""Query 2."""

from . import lm
from .common import table
from .registry import query


@query("op2_lm")
def op2(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))
