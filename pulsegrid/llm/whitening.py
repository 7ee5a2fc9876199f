"""Whitening of vectors by their principal components, found by block Lanczos without ever forming the covariance.

Entries become whole numbers, so sums and means are exact. A pass over the vectors multiplies the centred covariance
with a block of directions: each task sums Yt(Yv) of its own rows, which Spark adds up by dimension, so what travels is
the size of the block, whatever the number of rows. The driver holds the basis (dimensions times directions), makes
every new block orthogonal to all before it, twice, and solves the small projected problem. It ends when all wanted
pairs have residuals of TOLERANCE of the largest eigenvalue, or when the basis spans the whole space. Directions in
which a block has nothing new (breakdown: vectors of low rank, repeated eigenvalues) are replaced by fresh ones.

The trace comes from the rows' own squared deviations, not from the eigenvalues, so explained shares are right when only some
components are asked for.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; so are vectors of another
length than the most frequent one (of equally frequent ones the longest). Entries are held within 2**52 after scaling.
Repeated rows and ids count and are returned as often as they are there; null ids are carried. Components without
variance (eigenvalues below SINGULAR of the largest) don't exist: equal vectors, one vector and none give no rows.
A deviation beyond a long is null. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

#: Directions of a block; residuals at which a pair counts as found, and eigenvalues that count as none, of the largest.
BLOCK, TOLERANCE, SINGULAR = 16, 1e-14, 1e-12
_MOST, _LOW = float(1 << 52), 26


def fixed_point(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * entry) + shift as longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(_MOST)), F.lit(-_MOST))) + shift)


def usable(vectors: DataFrame, vector_col: str, id_col: str, scale: float, shift: int) -> tuple[DataFrame, int]:
    """(_id, _x) of the vectors that count, as a written table, and their length."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: F.coalesce((c < float("inf")) & (c > float("-inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("_id"), fixed_point(v, scale, shift).alias("_x")).where(v.isNotNull() & finite)
    rows = stored(rows, "vectors")
    size = rows.groupBy(F.size("_x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return (rows.where(F.size("_x") == size[0]), size[0]) if size else (rows, 0)


@dataclass(frozen=True)
class Fit:
    """base + rest / rows is the mean of each dimension, exactly; components are rows of unit length."""

    rows: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    passes: int


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy().reshape(-1, size)


def _summed(rows: DataFrame, size: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a table of ``width`` columns that ``of`` makes of the vectors of a batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(_matrix(batch, size))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *[pa.array(total[:, i]) for i in range(width)]], names=["_i", *[f"_{i}" for i in range(width)]])

    kind = "bigint" if of is _halves else "double"
    parts = rows.select("_x").mapInArrow(sums, ", ".join(["_i int", *[f"_{i} {kind}" for i in range(width)]]))
    found = parts.groupBy("_i").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(width)]).orderBy("_i").collect()  # a row a dimension
    return np.array([list(r)[1:] for r in found], np.int64 if of is _halves else np.float64).reshape(len(found), width)


def _halves(x: np.ndarray) -> np.ndarray:
    """Sums of rows, and of the high and low bits of each dimension, so that none overflows."""
    return np.stack([np.full(x.shape[1], len(x)), (x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)], axis=1)


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - base).astype(np.float64) - rest / n


def deviations(x: np.ndarray, base: np.ndarray, rest: np.ndarray, n: int) -> list[int]:
    """Of each row the sum over dimensions of (n * x - sum)**2, exactly."""
    a = x - base
    most = int(np.abs(a).max(initial=0))
    wide = most * max(most, n) * a.shape[1] >= 1 << 62
    a, r = (a.astype(object), rest.astype(object)) if wide else (a, rest)
    squares, products, own = (a * a).sum(axis=1), (a * r).sum(axis=1), sum(int(v) ** 2 for v in rest)
    return [n * n * int(s) - 2 * n * int(p) + own for s, p in zip(squares, products, strict=True)]


def _orthogonal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what the block has beyond ``basis``, without directions of a length of least and below."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > least]
    for _ in range(2):
        u = u - basis @ (basis.T @ u)
        u = np.linalg.qr(u)[0]
    return u


def lanczos(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest ``wanted`` eigenvalues, their vectors as rows, and the passes it took, of a symmetric matrix of which only the
    product with a block is known."""
    wanted, random = min(wanted, size), np.random.default_rng(7)
    basis = images = np.zeros((size, 0))
    new = np.linalg.qr(random.standard_normal((size, min(block, size))))[0]
    passes = 0
    while True:
        basis, images, passes = np.hstack([basis, new]), np.hstack([images, times(new)]), passes + 1
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
        largest = max(float(values[0]), 0.0)
        residual = np.linalg.norm(images @ vectors - (basis @ vectors) * values, axis=0)
        if basis.shape[1] == size or len(values) == wanted and residual.max() <= tolerance * largest:
            found = np.linalg.qr(basis @ vectors)[0] * np.sign(np.einsum("ij,ij->j", np.linalg.qr(basis @ vectors)[0], basis @ vectors))
            return values, found.T, passes
        room = min(block, size - basis.shape[1])
        new = _orthogonal(images[:, -new.shape[1] :], basis, 1e-10 * largest)[:, :room]
        while new.shape[1] < room:  # breakdown: go on from directions that are not there yet
            all_ = np.hstack([basis, new])
            new = np.hstack([new, _orthogonal(random.standard_normal((size, room - new.shape[1])), all_, 1e-8)])


def fit(rows: DataFrame, size: int, components: int, block: int = BLOCK) -> Fit | None:
    """Of the table of ``usable``; None without rows."""
    halves = _summed(rows, size, 3, _halves) if size else np.zeros((0, 3), np.int64)
    if not len(halves):
        return None
    n = int(halves[0, 0])
    sums = [(int(h) << _LOW) + int(low) for h, low in halves[:, 1:]]
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)

    def times(directions: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = _centred(x, base, rest, n)
            return y.T @ (y @ directions)

        return _summed(rows, size, directions.shape[1], of) / n

    own = _summed(rows, size, 1, lambda x: np.array([[math.fsum(deviations(x, base, rest, n))]]))
    values, vectors, passes = lanczos(times, size, components, block)
    real = (values > SINGULAR * max(float(values[0]), 0.0)) & (values > 0)
    vectors = vectors[real] * np.where(np.take_along_axis(vectors[real], np.abs(vectors[real]).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    return Fit(n, base, rest, values[real], vectors, float(own[0, 0]) / float(n) ** 3, passes)


def identity_error(rows: DataFrame, size: int, model: Fit) -> float:
    """How far the covariance of the whitened vectors is from the identity, in its worst entry."""
    turn = model.components.T / np.sqrt(model.values)

    def of(x: np.ndarray) -> np.ndarray:
        w = _centred(x, model.base, model.rest, model.rows) @ turn
        return np.hstack([w.T @ w, w.sum(axis=0)[:, None]])

    k = len(model.values)
    if not k:
        return 0.0
    sums = _summed(rows, size, k + 1, of) / model.rows
    return float(np.abs(sums[:, :k] - np.outer(sums[:, k], sums[:, k]) - np.eye(k)).max())


def transformed(rows: DataFrame, size: int, model: Fit) -> DataFrame:
    """_id, deviation (long) and whitened (array) of each row."""
    turn = model.components.T / np.sqrt(model.values)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, size)
            w = _centred(x, model.base, model.rest, model.rows) @ turn
            own = [v if v < 1 << 63 else None for v in deviations(x, model.base, model.rest, model.rows)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(own, pa.int64()), lists], names=["_id", "_deviation", "_whitened"])

    schema = T.StructType([rows.schema["_id"], T.StructField("_deviation", T.LongType()), T.StructField("_whitened", T.ArrayType(T.DoubleType()))])
    return rows.select("_id", "_x").mapInArrow(out, schema)


def whitened(
    vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = 32, scale: float = 64.0, shift: int = 1_000_000, block: int = BLOCK
) -> DataFrame:
    """A row for each vector that counts and each component from 1 on: id, component, n, deviation, whitened, explained,
    identity_error."""
    small_batches(vectors.sparkSession)
    rows, size = usable(vectors, vector_col, id_col, scale, shift)
    model = fit(rows, size, components, block)
    error = identity_error(rows, size, model) if model else 0.0
    if model is None or not len(model.values):
        cells = rows.select("_id", F.lit(None).cast("bigint").alias("_deviation"), F.array().cast("array<double>").alias("_whitened"))
        model = Fit(0, *[np.zeros(0)] * 4, 1.0, 0)
    else:
        cells = transformed(rows, size, model)
    shares = F.array(*map(F.lit, (model.values / model.trace).tolist())).cast("array<double>")
    return cells.select("_id", "_deviation", F.posexplode("_whitened").alias("_i", "_w")).select(
        F.col("_id").alias(id_col), (F.col("_i") + 1).alias("component"), F.lit(model.rows).cast("bigint").alias("n"), F.col("_deviation").alias("deviation"),
        F.col("_w").alias("whitened"), F.get(shares, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
