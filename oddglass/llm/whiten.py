"""Whitening of embeddings from an exact covariance, by polarisation.

Entries c become whole numbers x = floor(64 c) + 1000000. The covariance V of the distinct x
vectors comes from variances alone: for every dimension i and every pair sum i + j the squares of
centred values are added up, and 2 cov(i, j) = var(i + j) - var(i) - var(j). All sums are whole
numbers and exact, so nothing cancels however far the values lie from zero: with n vectors, sums S
and m = floor(S / n), a value u = x - m is centred up to a remainder t = S - n m common to all
rows, and the sum of (n x - S)^2 is n (n sum(u^2) - t^2), for pair sums likewise. The driver gets
d (d + 1) / 2 whole numbers for vectors of d entries, however many vectors there are, assembles V
and takes its eigenvectors.

Passes: distinct vectors (one shuffle of packed vectors, copies combined before it), their sums,
their squares, the covariance of what was whitened, and the answer for every row. Each task sends
one row a dimension or pair, so hot vectors or long tables load no single task.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped, and
so are vectors without entries, which have no component. Vectors of another length are another
population with a fit of its own. |64 c| beyond 2^62 is held at that bound. Repeated rows and rows
without an id are answered like any other. Components whose eigenvalue is not above rounding (one
distinct vector, constant or dependent dimensions) have whitened and explained 0 and take no part
in ``identity_error``. An empty table gives no rows; other columns are left behind. Very long
vectors cost d^2 numbers in the driver and in a task.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, reachable, release, rows, settled

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Whole numbers held exactly by 64 bits: squares of pair sums of values under this, over a block.
SMALL = 1 << 20
#: Vectors taken at once.
BLOCK = 4096
#: Covariance sums of whitened values are added as whole multiples of 2^-40.
_GRAIN = 1 << 40


def _vectors(batch: pa.RecordBatch, column: str):
    """(positions, x) for each length: rows of the batch whose vectors take part, as whole numbers."""
    col = batch.column(column)
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(col).to_pylist()], dtype=np.int64)
    flat = pc.list_flatten(col)
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        v = values[starts[at][:, None] + np.arange(d)]
        at, v = at[np.isfinite(v).all(axis=1)], v[np.isfinite(v).all(axis=1)]
        if len(at):
            yield d, at, np.clip(np.floor(v * SCALE), -2.0**62, 2.0**62).astype(np.int64) + OFFSET


def _pack(x: np.ndarray) -> list[bytes]:
    """Each vector as the narrowest whole numbers that hold it; equal vectors, equal bytes."""
    x = x - OFFSET
    most = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
    width = np.where(most < 1 << 7, 1, np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8)))
    out: list = [None] * len(x)
    for w in (1, 2, 4, 8):
        at = np.flatnonzero(width == w)
        raw, d = x[at].astype(f"<i{w}").tobytes(), x.shape[1] * w
        for k, i in enumerate(at.tolist()):
            out[i] = bytes([w]) + raw[k * d:(k + 1) * d]
    return out


def _unpack(batch: pa.RecordBatch):
    """(d, x) of packed vectors, by length and width."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    packed = batch.column("packed").to_pylist()
    kinds: dict[tuple, list] = {}
    for d, p in zip(dims.tolist(), packed):
        kinds.setdefault((d, p[0]), []).append(p[1:])
    for (d, w), parts in kinds.items():
        whole = np.frombuffer(b"".join(parts), f"<i{w}").reshape(-1, d).astype(np.int64)
        for a in range(0, len(whole), BLOCK):
            yield d, whole[a:a + BLOCK] + OFFSET


def _exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose squares can be added without overflow: Python's own where 64 bits may not do."""
    return x if not x.size or int(np.abs(x).max()) < SMALL else x.astype(object)


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, packed): each distinct x vector once, written to the shared folder."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                for d, _, x in _vectors(batch.slice(a, BLOCK), column):
                    yield rows(dim=np.full(len(x), d), packed=pa.array(_pack(x), pa.binary()))
        release()

    reachable(vectors.sparkSession)
    return settled(narrow(vectors, **{column: "array<double>"}).mapInArrow(run, "dim long, packed binary").distinct())


def _decimals(values) -> pa.Array:
    """Whole numbers as decimals; null beyond 38 digits."""
    with decimal.localcontext() as c:
        c.prec = 60
        return pa.array([decimal.Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def _totals(fit: DataFrame, per_block) -> dict[int, list[int]]:
    """Per vector length d, the sums over all (d, x) blocks of the numbers that ``per_block`` makes.

    A task adds its own blocks first. A sum may have 76 digits: it is sent in two parts of 30.
    """

    def run(batches):
        held: dict = {}
        for batch in batches:
            for d, x in _unpack(batch):
                part = per_block(d, x)
                held[d] = held[d] + part if d in held else part
        for d, total in held.items():
            high, low = zip(*[divmod(int(v), 10**30) for v in total])
            yield rows(dim=np.full(len(total), d), at=np.arange(len(total)), high=_decimals(high), low=_decimals(low))
        release()

    made = fit.mapInArrow(run, "dim long, at long, high decimal(38,0), low decimal(38,0)").groupBy("dim", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out: dict[int, dict] = {}
    for r in made.collect():
        out.setdefault(r["dim"], {})[r["at"]] = int(r["high"]) * 10**30 + int(r["low"])
    return {d: [found[i] for i in range(len(found))] for d, found in out.items()}


@dataclass
class Fit:
    """What whitening needs for vectors of one length; ``center`` and ``rest`` are m and t."""

    n: int
    sums: list[int]
    center: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def whitened(self, u: np.ndarray) -> np.ndarray:
        """Values less their whole centre, projected on the components and divided by their spread."""
        shift = np.array([int(t) / self.n for t in self.rest])
        spread = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), 1.0)
        return np.where(self.values > 0, (u.astype(np.float64) - shift) @ self.axes / spread, 0.0)

    def deviations(self, u: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2 for each vector, exact."""
        u, t, n = _exact(u), self.rest, self.n
        square = (u * u).sum(axis=1)
        mixed = (u.astype(object) * t.astype(object)).sum(axis=1) if n * u.shape[1] >= 1 << 42 else (u * t.astype(u.dtype)).sum(axis=1)
        own = sum(int(v) ** 2 for v in t)
        return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(square.tolist(), mixed.tolist())]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The model of each vector length, from the distinct vectors."""
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sums = _totals(distinct, lambda d, x: x.sum(axis=0, dtype=object))
    center = {d: np.array([s // sizes[d] for s in found]) for d, found in sums.items()}
    pairs = {d: np.triu_indices(d) for d in sizes}

    def squares(d, x):
        # Every dimension (the pair of it with itself is left to the driver) and every pair sum.
        u = _exact(x - center[d])
        own = (u * u).sum(axis=0).astype(object)
        both = [np.einsum("bi,bi->i", s, s) if s.dtype != object else (s * s).sum(axis=0) for s in (u[:, i:i + 1] + u[:, i + 1:] for i in range(d - 1))]
        return np.concatenate([own, *[b.astype(object) for b in both]])

    out = {}
    for d, found in _totals(distinct, squares).items():
        n, rest = sizes[d], [s - sizes[d] * int(m) for s, m in zip(sums[d], center[d])]
        # n^2 times the variance of each dimension and pair sum, exact.
        own = [n * found[i] - rest[i] ** 2 for i in range(d)]
        cov = np.zeros((d, d))
        k = d
        for i in range(d):
            cov[i, i] = own[i] / (n * n)
            for j in range(i + 1, d):
                both = n * found[k] - (rest[i] + rest[j]) ** 2
                cov[i, j] = cov[j, i] = (both - own[i] - own[j]) / (2 * n * n)
                k += 1
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        trace = sum(own) / (n * n)
        values = np.where(values > max(values[0], 0) * d * np.finfo(float).eps * 4, values, 0.0)
        out[d] = Fit(n, sums[d], center[d], np.array(rest), cov, axes, values, values / trace if trace else values * 0)

    def products(d, x):
        w = out[d].whitened(x - center[d])
        return np.array([int(v) for v in np.rint(np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]) * _GRAIN)], dtype=object)

    for d, found in _totals(distinct, products).items():
        k, n = len(out[d].values), out[d].n
        mean = np.array([v / _GRAIN / n for v in found[:k]])
        cov = np.array([v / _GRAIN / n for v in found[k:]]).reshape(k, k) - np.outer(mean, mean)
        live = out[d].values > 0
        out[d].error = round(float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max(initial=0.0)), 12)
    return out


def whiten(vectors: DataFrame, models: dict[int, Fit], column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector
    that takes part and each component, largest first.

    ``deviation`` is decimal(38, 0); beyond 38 digits it is null. One pass, no shuffle.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(a, BLOCK)
                for d, at, x in _vectors(piece, column):
                    if d not in models:
                        continue
                    m = models[d]
                    u, k = x - m.center, len(m.values)
                    apart = _decimals(m.deviations(u))
                    again = pa.array(np.repeat(np.arange(len(at)), k))
                    yield rows(vec_id=piece.column(key).take(pa.array(at)).take(again), component=np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), n=np.full(len(again), m.n),
                               deviation=apart.take(again), whitened=m.whitened(u).ravel(), explained=np.tile(m.explained, len(at)), identity_error=np.full(len(again), m.error))
        release()

    reachable(vectors.sparkSession)
    return narrow(vectors, **{key: "long", column: "array<double>"}).mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
