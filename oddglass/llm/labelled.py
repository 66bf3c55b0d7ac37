"""Labelled documents, all or a bounded sample, for fitting classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, narrow, sample_by_hash

#: One row in so many is held out: crc32 of the id as text, modulo this, is 0.
FOLDS = 5
#: Bits sent for each mark.
BITS_EACH = 16


def held_out() -> F.Column:
    return fold(FOLDS) == 0


def marked(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of all labelled training documents: of several labels of one document the largest counts."""
    marks = narrow(labels, doc_id="long", **{label: "int"}).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    return marks.groupBy("doc_id").agg(F.max(label).alias("label"))


def marks_test(marks: DataFrame) -> tuple[F.Column, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """A column ``place`` and a function of batches that have it: it keeps all rows whose id has a mark, and about one in BITS_EACH of the others.

    A bit for each hash of an id tells, so that no text is moved; BITS_EACH bits a mark are sent.
    """
    size = 64 * math.ceil(max(1024, BITS_EACH * marks.count()) / 64)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")))
    got = marks.select(place.alias("place")).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(bits.alias("bits")).toArrow()
    field = np.zeros(size // 64, np.int64)
    field[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    sent = marks.sparkSession.sparkContext.broadcast(field)

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column("place").to_numpy()
        return batch.filter(pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1))

    return place.alias("place"), kept


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, **extra: str) -> DataFrame:
    """(doc_id, text, label, extra...) of at most ``bound`` labelled training documents.

    The sample is taken by key hash, so it is the same at every run. Rows without an id or a
    label are left out; of several labels of one document the largest counts. The sample has at
    most ``bound`` rows of 16 bytes, which bounds the broadcast.
    """
    marks = sample_by_hash(marked(labels, label), bound)
    found = narrow(docs, doc_id="long", text="string", **extra).join(F.broadcast(marks), "doc_id")
    return found.dropDuplicates(["doc_id"])
