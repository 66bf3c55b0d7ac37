"""Query 8."""

from . import secrets
from .common import table
from .registry import query


@query("op8_secrets")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(docs, secrets.train(docs))
