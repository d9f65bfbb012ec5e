"""Embedding whitening by LOBPCG: the leading principal components of all vectors, scaled to unit variance.

An embedding entry c becomes the whole number x = floor(scale * c).  The fit list holds every distinct x
vector once; its count and sums are exact.  The covariance is never formed: each step of LOBPCG
(locally optimal block preconditioned conjugate gradients) takes an orthonormal basis of the iterate,
residual and previous direction blocks, multiplies the covariance with it in one pass over the fit
list (rows centred first, each task sends a matrix as high as a vector is long), and the
Rayleigh-Ritz procedure on the driver takes the best vectors within the basis.  A step's product
is also the fresh residual of the vectors it gave, so convergence is certified by products, not by
updates.  Iteration ends when the residual norms of the wanted components are below `TOLERANCE`
of the largest eigenvalue (times the root of d / 64 for longer vectors, as rounding grows); else it goes on, and fails after `MAX_STEPS`.  A last pass
measures the covariance of the whitened fit list.

Bounds.  The driver and each task hold a few matrices of a vector's length d times three blocks;
d is checked (`MAX_DIMENSION`).  Vectors themselves never leave the tasks; the fit list is a table in
the shared folder, so a lost executor costs a pass at most.  Copies are combined before the shuffle
that finds distinct vectors, by the whole vector, so no key is hot.

Cases.  Rows whose vector is null or holds a null or an entry that is not finite take no part and have
no result.  Vectors shorter than the longest count as followed by zeros.  Entries beyond 2**40
after scaling raise an error: sums of them could not be exact.  Repeated rows each get their
rows; a null vec_id is kept.  With fewer dimensions than components there are as many components as
dimensions.  A component without variance (eigenvalue below 1e-12 of the trace: fewer distinct
vectors than components, or constant ones) has `whitened` null and `explained` 0 and is left out of
`identity_error`.  Ties: of equal eigenvalues any orthonormal vectors of their space can come.  An
empty table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.store import scratch, stored

from .common import in_arrow

COMPONENTS = 4
SCALE = 256
#: Vectors iterated beside the wanted ones: they widen the gap that convergence depends on.
GUARDS = 12
TOLERANCE = 1e-13
MAX_STEPS = 500
MAX_DIMENSION = 16_384
LIMIT = 1 << 40
NO_VARIANCE = 1e-12
#: Rows centred and multiplied at once.
ROWS = 4096


def numbers(embedding: Column, scale: int = SCALE) -> Column:
    """The whole numbers of a vector; null for a vector that takes no part."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # beyond the limit the product may not fit a long
    whole = F.transform(x, lambda c: F.when(F.abs(c) * scale > 2 * LIMIT, F.lit(2 * LIMIT)).otherwise(F.floor(c * scale)))
    return F.when(~bad, whole)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The lists of an Arrow array as rows of d numbers, short ones followed by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == d).all():
        return flat.reshape(len(column), d)
    out = np.zeros((len(column), d), flat.dtype)
    at = np.arange(d) < sizes[:, None]
    out[at] = flat
    return out


class Fit(NamedTuple):
    """n distinct vectors of d entries, their exact sums, the trace of their covariance."""

    n: int
    sums: list[int]
    trace: float
    vectors: DataFrame

    @property
    def d(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # true division of whole numbers is rounded once


def fit_list(x: DataFrame, folder: str | None = None) -> Fit | None:
    """The distinct vectors of a column `x`, as a table, and their exact sums; None without vectors."""
    vectors = stored(x.select("x").distinct(), folder)
    shape = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("x"), F.lit(0))), F.abs(F.coalesce(F.array_min("x"), F.lit(0)))))).first()
    n, d, widest = shape
    if not n:
        return None
    if d > MAX_DIMENSION or widest > LIMIT:
        raise ValueError(f"vectors of at most {MAX_DIMENSION} entries, each below {LIMIT} after scaling")
    if not d:
        return Fit(n, [], 0.0, vectors)

    def totals(batches):
        s, q = [0] * d, [0] * d
        for batch in batches:
            m = matrix(batch.column("x"), d)
            for a in range(0, len(m), ROWS):
                part = m[a : a + ROWS]
                # squares are summed by halves of the numbers, so that no sum leaves 64 bits
                high, low = part >> 20, part & 0xFFFFF
                squares = [(int(h) << 40) + (int(c) << 21) + int(v) for h, c, v in zip((high * high).sum(0), (high * low).sum(0), (low * low).sum(0), strict=True)]
                s = [p + int(v) for p, v in zip(s, part.sum(0), strict=True)]
                q = [p + v for p, v in zip(q, squares, strict=True)]
        columns = [pa.array(range(d), pa.int32())] + [pa.array([Decimal(v) for v in c], pa.decimal128(38, 0)) for c in (s, q)]
        yield pa.RecordBatch.from_arrays(columns, ["k", "s", "q"])

    schema = "k int, s decimal(38,0), q decimal(38,0)"
    rows = in_arrow(vectors, totals, vectors.sparkSession.createDataFrame([], schema).schema).groupBy("k").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    rows.sort(key=lambda r: r.k)
    sums = [int(r.s) for r in rows]
    trace = sum(n * int(r.q) - s * s for r, s in zip(rows, sums, strict=True)) / n**2
    return Fit(n, sums, trace, vectors)


def product(fit: Fit, basis: np.ndarray) -> np.ndarray:
    """The covariance times a block of columns: one pass over the fit list."""
    mean, d, k = fit.mean, *basis.shape

    def run(batches):
        total = np.zeros((d, k))
        for batch in batches:
            m = matrix(batch.column("x"), d)
            for a in range(0, len(m), ROWS):
                rows = m[a : a + ROWS] - mean
                total += rows.T @ (rows @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "v"])

    parts = in_arrow(fit.vectors, run, fit.vectors.sparkSession.createDataFrame([], "k int, v array<double>").schema)
    added = parts.groupBy("k").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(k)]).alias("v")).toPandas()
    return np.array(added.sort_values("k")["v"].tolist()).reshape(d, k) / fit.n


def orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns; columns that lie in the space of those before go."""
    out = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - out @ (out.T @ block)
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > 1e-10]
            block = block - out @ (out.T @ block)
            out = np.hstack([out, np.linalg.qr(block)[0]])
    return out


class Components(NamedTuple):
    values: np.ndarray  # falling
    vectors: np.ndarray  # unit columns
    residuals: np.ndarray  # norms of V u - e u, over the largest eigenvalue
    steps: int


def lobpcg(multiply, d: int, k: int = COMPONENTS, guards: int = GUARDS, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS, seed: int = 7) -> Components:
    """The k largest eigenvalues and their vectors of the symmetric matrix that `multiply` applies."""
    k, block = min(k, d), min(k + guards, d)
    x = np.random.default_rng(seed).standard_normal((d, block))
    residual = direction = np.zeros((d, 0))
    tolerance *= max(1.0, np.sqrt(d / 64))
    for step in range(1, max_steps + 1):
        basis = orthonormal([x, residual, direction])
        image = multiply(basis)
        inner = basis.T @ image
        values, c = np.linalg.eigh((inner + inner.T) / 2)
        values, c = values[::-1][:block], c[:, ::-1][:, :block]
        new = basis @ c
        residual = image @ c - new * values
        direction = new - x @ (x.T @ new) if step > 1 else direction
        x = new
        largest = max(values[0], 0.0) or 1.0
        norms = np.linalg.norm(residual, axis=0)[:k] / largest
        if (norms <= tolerance).all():
            return Components(values[:k], x[:, :k] / np.linalg.norm(x[:, :k], axis=0), norms, step)
    raise RuntimeError(f"residuals {norms} after {max_steps} steps")


class Whitening(NamedTuple):
    fit: Fit
    found: Components
    scale: np.ndarray  # 1 / sqrt(eigenvalue); 0 for a component without variance
    identity_error: float


def fitted(x: DataFrame, k: int = COMPONENTS, folder: str | None = None, **options) -> Whitening | None:
    """The whitening of a column `x` of vectors; None without vectors."""
    fit = fit_list(x, folder)
    if fit is None or not fit.d:
        return None
    found = lobpcg(lambda basis: product(fit, basis), fit.d, k, **options)
    live = found.values > NO_VARIANCE * fit.trace
    scale = np.where(live, 1 / np.sqrt(np.where(live, found.values, 1)), 0.0)
    return Whitening(fit, found, scale, identity_error(fit, (found.vectors * scale)[:, live]))


def identity_error(fit: Fit, projection: np.ndarray) -> float:
    """The largest entry of |covariance of the projected fit list - identity|, measured in one pass."""
    mean, d, k = fit.mean, fit.d, projection.shape[1]
    if not k:
        return 0.0

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = (matrix(batch.column("x"), d) - mean) @ projection
            first += y.sum(0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[first, second.ravel()]], pa.list_(pa.float64()))], ["v"])

    parts = in_arrow(fit.vectors, run, fit.vectors.sparkSession.createDataFrame([], "v array<double>").schema)
    row = parts.agg(*[F.sum(F.col("v")[j]) for j in range(k + k * k)]).first()
    first, second = np.array(row[:k]) / fit.n, np.array(row[k:]).reshape(k, k) / fit.n
    return float(np.abs(second - np.outer(first, first) - np.eye(k)).max())


def whiten(rows: DataFrame, k: int = COMPONENTS, scale: int = SCALE, **options) -> DataFrame:
    """`vec_id`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error` for every row of
    `vec_id`, `embedding` that takes part, and every component.

    deviation: sum over the dimensions of (n * x - sum)**2, exact (decimal(38,0)).
    """
    spark = rows.sparkSession
    folder = scratch(spark, "whiten")
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    # the row's numbers are made again for the projection: cheaper than to store them
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), numbers(F.col("embedding"), scale).alias("x")).where("x is not null")
    model = fitted(x, k, folder, **options)
    schema = spark.createDataFrame([], out).schema
    if model is None:
        return spark.createDataFrame([], schema)
    fit, found = model.fit, model.found
    n, sums, mean, d, wanted = fit.n, fit.sums, fit.mean, fit.d, len(found.values)
    projection, live = found.vectors * model.scale, model.scale > 0
    explained = np.where(live, found.values / (fit.trace or 1.0), 0.0)
    squared, error = sum(s * s for s in sums), model.identity_error
    exact = np.array(sums, object)

    def run(batches):
        for batch in batches:
            m = matrix(batch.column("x"), d)
            for a in range(0, len(m), ROWS):
                part, ids = m[a : a + ROWS], batch.column("vec_id").slice(a, ROWS)
                whole = part.astype(object)  # numbers without bound
                deviation = n * n * (whole * whole).sum(1) - 2 * n * (whole @ exact) + squared
                y = (part - mean) @ projection
                size, each = len(part), np.repeat(np.arange(len(part)), wanted)
                values = [
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, wanted + 1), size), pa.int32()), pa.array(np.full(len(each), n), pa.int64()),
                    pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)).take(pa.array(each)), pa.array(y.ravel(), mask=np.tile(~live, size)),
                    pa.array(np.tile(explained, size)), pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(values, schema.fieldNames())

    return in_arrow(x, run, schema)
