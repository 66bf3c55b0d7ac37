"""Documents in blocks, and exchanges of sorted 64-bit keys between blocks and buckets.

A block holds some thousand whole documents in one row. Blocks are written once to the shared
folder, so that every later pass sees the very same blocks, also after an executor was lost. For
statistics over the whole corpus a block sends each of its distinct keys once, cut by key range
into buckets; a bucket gathers the same range of all blocks and answers in the order of each
block's keys. What a bucket holds is bounded by the number of buckets, which grows with the data;
a key that stands in a third of all documents is one entry for each block.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, pieces, rows, settled

#: Text of one block, in bytes; a longer document is a block of its own.
BLOCK_BYTES = 6 << 20
#: Keys that one bucket holds, about.
BUCKET_KEYS = 1_000_000
_U = np.uint64


def make_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, docs, bytes, payload): the documents' ids and texts as compressed Arrow, by block."""
    count = [0, -1]

    def pack(batch: pa.RecordBatch):
        part = TaskContext.get().partitionId()
        if count[1] != part:
            count[:] = [0, part]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(batch)
        count[0] += 1
        raw = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        return rows(block=pa.array([(part << 32) | count[0]], pa.int64()), docs=pa.array([batch.num_rows], pa.int64()), bytes=pa.array([raw], pa.int64()), payload=pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", block_bytes):
                yield pack(piece)

    return settled(narrow(docs, doc_id="long", text="string").mapInArrow(run, "block long, docs long, bytes long, payload binary"))


def unpack(payload: bytes) -> pa.RecordBatch:
    """A block's documents: doc_id, text."""
    return next(iter(pa.ipc.open_stream(payload)))


def bucket_count(blocks: DataFrame, bytes_per_key: float, bucket_keys: int = BUCKET_KEYS) -> int:
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return max(1, math.ceil(total / bytes_per_key / bucket_keys))


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from one bucket's range to the next: positions of all bucket starts and the end."""
    starts = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])


@functools.lru_cache(maxsize=1)
def _packer():
    """A worker's own compressor and decompressor: a new one for every piece would cost more than the piece."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed differences, byte by byte."""
    step = np.diff(keys, prepend=_U(0)) if len(keys) else keys
    planes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return _packer()[0](planes.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_packer()[1](data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers, mostly small, byte by byte."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return _packer()[0](planes.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_packer()[1](data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").ravel()
