"""Whitening of embeddings by a spectral divide and conquer of their covariance.

Counts, sums and centred products are added up inside every task and then over the tasks; only
square matrices of the vectors' length reach the driver. There the covariance is divided by polar
decompositions: the polar factor of a shifted matrix is the sign of its spectrum, which gives the
projector on the part above the shift, and both parts are divided again. The components go back
to the tasks as a matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest vectors that are taken: a covariance of 128 MB.
MOST_DIMENSIONS = 4096
#: Rows that a task turns into one matrix.
ROWS = 4096
SCALE, SHIFT = 1024, 100_000
EPS = np.finfo(np.float64).eps


# Spectral divide and conquer ----------------------------------------------------
def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, not singular matrix, by dynamically weighted
    Halley steps, each a QR factorisation."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = min(max(1 / float(np.linalg.norm(np.linalg.inv(x))), EPS), 1.0)  # below the least singular value
    for _ in range(60):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        weight = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (weight + b * low**2) / (1 + c * low**2))
        if moved < np.cbrt(EPS) * n**0.5 * 1e-3 and 1 - low < 1e-8:
            break
    return x


def _ranges(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement, by subspace steps that
    begin with the projector's largest columns."""
    n = len(projector)
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    start = np.random.default_rng(0).standard_normal((n, n))
    start[:, :rank] = projector @ start[:, :rank] + projector[:, order[:rank]]
    for _ in range(2):
        q, _ = np.linalg.qr(start)
        start = np.hstack([projector @ q[:, :rank], q[:, rank:] - projector @ q[:, rank:]])
    q, _ = np.linalg.qr(start)
    return q[:, :rank], q[:, rank:]


def divide(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (all by default) of a symmetric matrix, falling, and their
    unit eigenvectors as columns.

    The spectrum is divided at a shift, both invariant subspaces get an orthonormal basis, and the
    matrix is divided again inside each. Parts that hold none of the wanted values are left. A part
    whose spread is rounding error only is a multiple of the identity: any basis will do.
    """
    scale = float(np.linalg.norm(a)) or 1.0

    def inside(block: np.ndarray, basis: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray]]:
        n = len(block)
        middle = float(np.trace(block)) / n
        spread = float(np.linalg.norm(block - middle * np.eye(n)))
        if n == 1 or spread <= 4 * EPS * scale:
            return [(float(block[k, k]), basis[:, k]) for k in range(n)]
        for shift in (float(np.median(np.diag(block))), *(middle + step * spread / n**0.5 for step in (0.0, 0.13, -0.29, 0.41, -0.53, 0.05, -0.03))):
            shifted = block - shift * np.eye(n)
            try:
                sign = polar_factor(shifted)
            except np.linalg.LinAlgError:  # an eigenvalue is the shift itself
                continue
            projector = (sign + np.eye(n)) / 2
            rank = round(float(np.trace(projector)))
            if not 0 < rank < n or not np.isfinite(sign).all():
                continue
            upper, lower = _ranges(projector, rank)
            if np.linalg.norm(lower.T @ block @ upper) > 1e3 * n * EPS * scale:
                continue
            first = inside(_part(block, upper), basis @ upper, wanted)
            left = wanted - rank
            return first + (inside(_part(block, lower), basis @ lower, left) if left > 0 else [])
        raise np.linalg.LinAlgError(f"no shift divides the spectrum of a part of {n} dimensions")

    wanted = len(a) if wanted is None else min(wanted, len(a))
    found = sorted(inside((a + a.T) / 2, np.eye(len(a)), wanted), key=lambda pair: -pair[0])[:wanted]
    vectors = np.column_stack([v for _, v in found]) if found else np.zeros((len(a), 0))
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = [1 if v[np.argmax(np.abs(v))] > 0 else -1 for v in vectors.T]
    return np.array([e for e, _ in found]), vectors * np.array(signs)


def _part(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    part = basis.T @ block @ basis
    return (part + part.T) / 2


# Over the tasks -----------------------------------------------------------------
def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows and their vectors as a matrix of whole numbers."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            entries = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            if len(entries) != part.num_rows * dims:
                raise ValueError(f"vectors of different lengths: {dims} is not the length of all")
            scaled = np.floor(SCALE * entries.astype(np.float64))
            if np.abs(scaled).max(initial=0) >= 2**62:
                raise ValueError("an entry is too large for a whole number of 64 bits")
            yield part, scaled.astype(np.int64).reshape(part.num_rows, dims) + SHIFT


def _added(rows: DataFrame, work: Callable[[Iterator[np.ndarray]], np.ndarray], dims: int, height: int) -> np.ndarray:
    """``work`` (a matrix of doubles, of ``height`` rows) over the vectors of every task, added up
    row by row: no task holds more than one matrix, and the driver gets one."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = work(x for _, x in _matrices(batches, dims))
        yield pa.RecordBatch.from_pydict({"row": [*range(height)], "sums": [r.tobytes() for r in total]}, schema=_ROWS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, packed in zip(batch.column("row").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[row] = sums.get(row, 0.0) + np.frombuffer(packed)
        yield pa.RecordBatch.from_pydict({"row": [*sums], "sums": [r.tobytes() for r in sums.values()]}, schema=_ROWS)

    summed = rows.mapInArrow(one, "row int, sums binary").repartition("row").mapInArrow(add, "row int, sums binary")
    return np.stack([np.frombuffer(r["sums"]) for r in sorted(summed.collect())])


_ROWS = pa.schema([("row", pa.int32()), ("sums", pa.binary())])
_SUMS = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])


@dataclass(frozen=True)
class Whitening:
    """What whitening needs to know: rows and sums of the vectors, the components (columns) with
    their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, over the root of their eigenvalues; 0 on a component
        without variance."""
        return (x - np.array(self.sums) / self.n) @ self.matrix

    @property
    def matrix(self) -> np.ndarray:
        held = self.eigenvalues > 64 * EPS * max(self.trace, 0.0)
        return np.where(held, self.components / np.sqrt(np.where(held, self.eigenvalues, 1.0)), 0.0)


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null, NaN or infinite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def fit(rows: DataFrame, dims: int, wanted: int) -> Whitening:
    """Counts, sums, covariance and components of ``rows`` (vector), all of length ``dims``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, dtype=object)
        for _, x in _matrices(batches, dims):
            exact = np.abs(x).max(initial=0) < 2**62 // len(x)
            n, sums = n + len(x), sums + (x if exact else x.astype(object)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": [*range(dims)], "n": [n] * dims, "s": [*map(int, sums)]}, schema=_SUMS)

    added = rows.mapInArrow(part, "at int, n long, s long").groupBy("at").agg(F.sum("n"), F.sum("s")).collect()
    found = sorted(map(tuple, added))
    n, sums = found[0][1], [s for _, _, s in found]
    mean = np.array(sums) / n

    def products(parts: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((dims, dims))
        for x in parts:
            centred = x - mean
            total += centred.T @ centred
        return total

    covariance = _added(rows, products, dims, dims) / n
    eigenvalues, components = divide(covariance, wanted)
    return Whitening(n, sums, eigenvalues, components, float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on
    all rows, over the components that have variance."""
    dims, k = model.components.shape

    def products(parts: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for x in parts:
            w = model.whitened(x)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        return total

    total = _added(rows, products, dims, k + 1) / model.n
    covariance = total[:k] - np.outer(total[k], total[k])  # the means are rounding error
    held = np.abs(model.matrix).max(axis=0) > 0
    return float(np.abs(covariance - np.eye(k))[np.ix_(held, held)].max(initial=0.0))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component up to ``components``: (vec_id, component, n,
    deviation, whitened, explained, identity_error).

    An entry c counts as floor(1024 * c) + 100000. ``deviation`` is exact (decimal). Rows whose
    vector is null, or has an entry that is null or not finite, are left out; every other row
    counts and is returned, whatever its id: null and repeated ids, too. A component without variance
    is 0 on all rows, explains 0 and is left out of ``identity_error``. Vectors shorter than
    ``components`` have as many components as entries. No usable vectors: no rows. Vectors of
    different lengths, of more than 4096 entries, or entries beyond 64 bits are an error. Other
    columns are left out.

    The table is read once for its facts, once each for sums, covariance and error, and once for
    the result. Nothing but sums is shuffled.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    shape = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    low, high = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not high:
        return spark.createDataFrame([], shape)
    if low != high or high > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {low} to {high} entries; they must have one length, {MOST_DIMENSIONS} at most")
    model = fit(rows, high, components)
    error, k = identity_error(rows, model), len(model.eigenvalues)
    share = np.where(np.abs(model.matrix).max(axis=0) > 0, model.eigenvalues / model.trace if model.trace > 0 else 0.0, 0.0)
    sums = np.array(model.sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, high):
            size = len(x)
            most = model.n * float(np.abs(x - (sums / model.n).astype(np.float64)).max(initial=0)) + 1
            small = model.n * float(np.abs(x).max(initial=0)) < 2**62 and most * most * high < 2**62
            if small:
                from_mean = model.n * x - sums.astype(np.int64)
                deviation = pa.array((from_mean * from_mean).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                from_mean = model.n * x.astype(object) - sums
                deviation = pa.array([int(d) for d in (from_mean * from_mean).sum(axis=1)], pa.decimal128(38, 0))
            at = np.repeat(np.arange(size), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, model.n)),
                    deviation.take(pa.array(at)),
                    pa.array(model.whitened(x).reshape(-1)),
                    pa.array(np.tile(share, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, shape)
