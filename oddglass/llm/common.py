"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word of a text: what stands between blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-casing of A-Z only, as bytes.lower() and str.translate do it.
LOWER = {c: c + 32 for c in range(65, 91)}
#: Text taken at once inside a task, in bytes.
PIECE = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(spark: SparkSession) -> None:
    """Workers find this package where the driver found it, also if the driver was started elsewhere."""
    paths = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [paths.get("PYTHONPATH"), root]))


def narrow(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, in their types; other columns, whatever their names, are left behind."""
    reachable(df.sparkSession)
    return df.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in kinds.items()])


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``size`` bytes of ``column``; a longer row stays whole."""
    if not batch.num_rows:
        return
    n = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(n, dtype=np.int64) - n) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """``fn`` over pieces of bounded size, inside Spark's own partitions; no shuffle."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                out = fn(piece)
                yield from [out] if isinstance(out, pa.RecordBatch) else out
                del out
        release()

    reachable(df.sparkSession)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Hand freed memory back to the system, so that a worker waiting for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows(**columns) -> pa.RecordBatch:
    """A record batch of named Arrow arrays, numpy arrays or lists."""
    made = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in made.values()], names=list(made))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list column of ``values`` cut at ``sizes``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


_WRITTEN: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    for spark, path in _WRITTEN:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session ended first: its scratch folder is the cluster's to clear
            return


def settled(df: DataFrame) -> DataFrame:
    """Write once into the shared folder and go on from there: lineage ends, sizes are known to the planner.

    The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(modulus: int, column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def sample_by_hash(df: DataFrame, rows_wanted: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows_wanted`` rows, the same at every run: those of least key hash (a documented training bound)."""
    return df.orderBy(F.xxhash64(key), key).limit(rows_wanted)
