"""Quality: a compression classifier.

Two zstandard dictionaries are built, one from half of the texts labelled good and one from half
of those labelled bad, picked by hash: shares of 512 bytes at even distances over all their bytes.
A text is compressed with both, in blocks short enough that the dictionary matters for all of it;
good text comes out smaller with the good dictionary. The difference of the two sizes for each byte
of text is the only input of the score: a logistic curve of it, steeper or flatter beyond zero, is
calibrated on the other half of the training rows.

Fitting takes at most ``bound`` labelled rows (a documented parameter). Their texts stay in the tasks:
the driver gets the shares, which fill two dictionaries, and one number for each other row, however
long the texts are. Scoring reads whole texts inside Spark's own partitions, block by block and
without a shuffle. Null and empty texts have difference zero and get the curve's value there. With
fewer than four rows of a label, every score is the smoothed share of label 1. Rows are kept one for
one, repeated ones and those without an id included; equal texts have equal scores. An empty table
gives no rows; other columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, narrow, rows, settled, texts
from .labelled import held_out, training_rows

BLOCK = 512
DICTIONARY = 256 << 10
LEVEL = 9
SHARE = 512
LEAST = 4


class Model:
    def __init__(self, good: bytes, bad: bytes, curve: np.ndarray, constant: float | None = None):
        self.good, self.bad, self.curve, self.constant = good, bad, curve, constant
        self.packers = None

    def __getstate__(self):
        return {**self.__dict__, "packers": None}

    def differences(self, docs: list[str]) -> np.ndarray:
        """How much smaller each text comes out with the good dictionary than with the bad one, for each of its bytes."""
        import zstandard as zstd

        if self.packers is None:
            self.packers = []
            for text in (self.good, self.bad):
                d = zstd.ZstdCompressionDict(text, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.packers.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        good, bad = (p.compress for p in self.packers)
        out = np.zeros(len(docs))
        for i, text in enumerate(docs):
            raw = text.encode("utf-8", "replace")
            out[i] = sum(len(bad(raw[at:at + BLOCK])) - len(good(raw[at:at + BLOCK])) for at in range(0, len(raw), BLOCK)) / max(1, len(raw))
        return out

    def scores(self, docs: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        return 1 / (1 + np.exp(-np.clip(_expand(self.differences(docs)) @ self.curve, -500, 500)))


def _expand(d: np.ndarray) -> np.ndarray:
    """The curve's terms: all of them functions of the difference alone."""
    return np.column_stack([np.ones(len(d)), d * 10, np.maximum(d, 0) * 10])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; a step that makes the loss larger is halved, or it may swing and never settle."""
    w = np.zeros(x.shape[1])
    loss = lambda w: float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + ridge * (w @ w) / 2)
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-9 and loss(w + size * step) > now:
            size /= 2
        if size <= 1e-9:
            break
        w = w + size * step
        now = loss(w)
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def shares(text: str, place: int, distance: int) -> list[bytes]:
    """Shares of a text at even distances from a start of its own, by hash; all of it where the distance is 0."""
    raw = text.encode("utf-8", "replace")
    return [raw] if not distance else [raw[at:at + SHARE] for at in range(place % distance, len(raw), distance)]


def dictionary(found: list[tuple[int, int, bytes]], size: int = DICTIONARY) -> bytes:
    """The shares (place, number, bytes) of one label, in the order of their texts' hashes."""
    return b"\n".join(part for *_, part in sorted(found))[-size:]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 4_000) -> Model:
    place = F.xxhash64("doc_id")
    # At most ``bound`` rows: the first half of each label, by hash, gives the dictionary.
    half = F.row_number().over(Window.partitionBy("label").orderBy("place", "doc_id")) <= F.floor(F.count("*").over(Window.partitionBy("label")) / 2)
    own = training_rows(docs, labels, label, bound).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), place.alias("place"))
    own = settled(own.withColumn("gives", half))
    sizes = {r["label"]: (r["n"], r["bytes"] or 0) for r in own.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gives"), F.octet_length("text"))).alias("bytes")).collect()}
    n = sum(k for k, _ in sizes.values())
    if min(sizes.get(0, (0, 0))[0], sizes.get(1, (0, 0))[0]) < LEAST:
        return Model(b"", b"", np.zeros(0), (sizes.get(1, (0, 0))[0] + 1) / (n + 2))
    distance = {k: 0 if size <= DICTIONARY else max(SHARE + 1, size // (DICTIONARY // (SHARE + 1))) for k, (_, size) in sizes.items()}

    def draw(batch: pa.RecordBatch):
        out = [(k, p, i, part) for k, p, t in zip(batch.column("label").to_pylist(), batch.column("place").to_pylist(), texts(batch)) for i, part in enumerate(shares(t, p, distance[k]))]
        return rows(label=pa.array([x[0] for x in out], pa.int32()), place=pa.array([x[1] for x in out], pa.int64()), number=pa.array([x[2] for x in out], pa.int64()), part=pa.array([x[3] for x in out], pa.binary()))

    drawn = map_texts(own.where("gives").select("label", "place", "text"), draw, "label int, place long, number long, part binary").collect()
    model = Model(*[dictionary([(r["place"], r["number"], bytes(r["part"])) for r in drawn if r["label"] == k]) for k in (1, 0)], np.zeros(0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def measure(batch: pa.RecordBatch):
        return rows(label=batch.column("label"), place=batch.column("place"), difference=pa.array(sent.value.differences(texts(batch))))

    rest = map_texts(own.where("NOT gives").select("label", "place", "text"), measure, "label int, place long, difference double").toPandas().sort_values(["place", "difference"])
    model.packers = None
    model.curve = _logistic(_expand(rest["difference"].to_numpy()), rest["label"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        return rows(doc_id=batch.column("doc_id"), score=pa.array(sent.value.scores(texts(batch)).astype(np.float64)))

    return map_texts(narrow(docs, doc_id="long", text="string"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 4_000, cut: float = 0.3) -> DataFrame:
    scored = score(docs, train(docs, labels, label, bound))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
