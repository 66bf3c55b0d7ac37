"""Query 1."""

from . import bpe
from .common import table
from .registry import query


@query("op1_bpe")
def op1(spark, sf_dir):
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
