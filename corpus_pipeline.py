"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark passages go, secrets are masked, and what is left is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every stage's
result as Parquet to the shared folder and gives it, read again, to the next. All stages but the
last return the columns of ``documents``. Every stage judges its own input:

* ``toxicity`` keeps documents whose score is under 0.5 (texts null or empty included).
* ``near_dups`` keeps the document of smallest id in each group; rows with a null id stay.
* ``decontam`` keeps documents that cover no benchmark item by half or more.
* ``secrets`` keeps all documents, replaces every secret by a mask and counts ``n_chars`` anew.
* ``bpe`` returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left.

SQL can express neither the classifiers nor the encoder, so ORACLE_SQL is None; the tests compare
the stages with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddglass.llm import bpe, decontam, near_dups, secrets
from oddglass.llm import toxicity as toxic
from oddglass.llm.common import settled, table

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxic.reject(docs, toxic.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; of rows that repeat an id, each stays or goes with it."""
    gone = near_dups.groups(docs).where("component_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs, secrets.train(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the encoded texts."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dups", near_duplicates),
    ("decontam", decontaminate),
    ("secrets", mask_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
    return docs
