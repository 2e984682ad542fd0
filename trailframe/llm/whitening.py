"""Embedding whitening by polarisation.

Entries become whole numbers, so that all sums are exact.  One pass gives the sums of all dimensions.
A second one centres every vector and adds up the squares of each dimension
and of each sum of two dimensions.  With ``A(u)`` the sum of squared deviations of
``u``, the cross term of two dimensions follows from ``A(x + y) - A(x) - A(y)``,
half of which is their sum of products.  The covariance matrix goes to ``eigh``; it has
dimensions squared entries, whatever the number of rows.

A vector is centred on the whole part of the mean, and the rest (less than one per
entry) is taken into account in whole numbers afterwards, so nothing is rounded
before the covariances themselves.  Squares that do not fit 64 bits are added up
as Python integers; partial sums travel as several 30-bit digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.session import write_through

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
_DIGITS, _BITS = 7, 30
_CHUNK = 4096
_SAFE = 1 << 52
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation; as large as the square of the dimensions."""

    n: int
    centre: tuple[int, ...]  # whole part of each mean
    rest: tuple[int, ...]  # sums of the entries after centring
    vectors: np.ndarray  # dimensions x components
    values: np.ndarray  # eigenvalues of the components
    explained: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.centre)


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """``floor(1024 * c) + 100000``; beyond the range of a long, its nearest end."""
    with np.errstate(over="ignore"):
        scaled = np.floor(entries * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < _SAFE:
        return scaled.astype(np.int64) + OFFSET
    scaled = np.clip(scaled, -(2.0**70), 2.0**70)
    flat = [min(max(int(v) + OFFSET, _LOW), _HIGH) for v in scaled.ravel()]
    return np.array(flat, object).reshape(scaled.shape)


def _minus(x: np.ndarray, centre: tuple[int, ...]) -> np.ndarray:
    if x.dtype == object or any(abs(c) >= _SAFE for c in centre):
        return x.astype(object) - np.array(centre, object)
    return x - np.array(centre, np.int64)


def _largest(z: np.ndarray) -> int:
    return int(np.abs(z).max()) if z.size else 0


def square_sums(z: np.ndarray) -> list[np.ndarray]:
    """For each dimension the sum of its squares, then those of its sums with all later ones."""
    if z.dtype != object and len(z) * (2 * _largest(z)) ** 2 > _HIGH:
        z = z.astype(object)
    out = []
    for a in range(z.shape[1]):
        pair = z[:, a:] + z[:, a : a + 1]
        pair[:, 0] = z[:, a]
        out.append((pair * pair).sum(axis=0) if z.dtype == object else np.einsum("ij,ij->j", pair, pair))
    return out


def _digits(value: int) -> list[int]:
    low = [(value >> (_BITS * k)) & ((1 << _BITS) - 1) for k in range(_DIGITS - 1)]
    return [*low, value >> (_BITS * (_DIGITS - 1))]


_NAMES = [f"d{k}" for k in range(_DIGITS)]
_PARTS = "key bigint, " + ", ".join(f"{d} bigint" for d in _NAMES)


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(batch), dimensions)


def _exact_sums(vectors: DataFrame, dimensions: int, chunk_sums) -> dict[int, int]:
    """Sums of whole numbers over all rows; ``chunk_sums`` maps a matrix to the sums of its rows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            matrix = _matrix(batch, dimensions)
            for k in range(0, len(matrix), _CHUNK):
                sums = chunk_sums(whole_numbers(matrix[k : k + _CHUNK])).astype(object)
                total = sums if total is None else total + sums
        if total is not None:
            rows = np.array([[k, *_digits(int(v))] for k, v in enumerate(total)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], ["key", *_NAMES])

    summed = vectors.mapInArrow(parts, _PARTS).groupBy("key").agg(*[F.sum(d).alias(d) for d in _NAMES])
    return {r["key"]: sum(r[d] << (_BITS * k) for k, d in enumerate(_NAMES)) for r in summed.collect()}


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, vector`` of the rows whose vector and entries are there and finite."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~odd)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The rows of one length and their whitening.

    ``rows`` are ``usable`` ones.  A matrix needs vectors of one length; the most
    frequent one is taken (the longest of equally frequent ones), and rows of
    other lengths are left out.  Without any entry there is no whitening.
    """
    length = F.size("vector")
    common = rows.groupBy(length.alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None or not common["length"]:
        return rows.limit(0), None
    d, n = common["length"], common["count"]
    rows = rows.where(length == d)

    def plain(x: np.ndarray) -> np.ndarray:
        return (x.astype(object) if _largest(x) * len(x) > _HIGH else x).sum(axis=0)

    sums = _exact_sums(rows.select("vector"), d, plain)
    centre = tuple(sums[a] // n for a in range(d))

    def centred(x: np.ndarray) -> np.ndarray:
        z = _minus(x, centre)
        return np.concatenate([s.astype(object) for s in square_sums(z)])

    squares = _exact_sums(rows.select("vector"), d, centred)
    rest = tuple(sums[a] - n * centre[a] for a in range(d))
    exact: dict[tuple[int, int], int] = {}
    key = 0
    for a in range(d):
        for b in range(a, d):
            left_over = rest[a] if a == b else rest[a] + rest[b]
            # n times the sum of squares less the squared sum: n times the squared deviations.
            exact[a, b] = n * squares[key] - left_over**2
            key += 1
    cov = np.empty((d, d))
    for (a, b), value in exact.items():
        cov[a, b] = cov[b, a] = value / n**2 if a == b else (value - exact[a, a] - exact[b, b]) / (2 * n**2)
    # Powers of two keep extreme entries inside the range of the solver and change no digit.
    largest = float(np.abs(cov).max())
    unit = 2.0 ** np.floor(np.log2(largest)) if largest > 0 else 1.0
    values, vectors = np.linalg.eigh(cov / unit)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, vectors = values[order] * unit, vectors[:, order]
    # Below the rounding of the largest one an eigenvalue is zero.
    values = np.where(values > largest * d * 4e-16, values, 0.0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = float(np.trace(cov / unit)) * unit
    explained = values / trace if trace > 0 else np.zeros(len(values))
    return rows, Whitening(n, centre, rest, vectors * np.where(signs < 0, -1.0, 1.0), values, explained)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """``key, deviation, whitened`` (one entry per component) for rows of the model's length."""
    d, n = model.dimensions, model.n
    scaled = model.vectors / np.where(model.values > 0, np.sqrt(model.values), np.inf)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean_rest = np.array([r / n for r in model.rest])
        for batch in batches:
            z = _minus(whole_numbers(_matrix(batch, d)), model.centre)
            if d * (n * _largest(z) + max(map(abs, model.rest))) ** 2 > _HIGH:
                z = z.astype(object)
            off = n * z - np.array(model.rest, z.dtype)
            far = (off * off).sum(axis=1).tolist()
            white = (z.astype(np.float64) - mean_rest) @ scaled
            columns = [
                batch.column("key"),
                pa.array([v if v <= _HIGH else None for v in far], pa.int64()),
                pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "deviation", "whitened"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(apply, f"key {kind}, deviation bigint, whitened array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened covariance less the identity, over components that vary."""
    live = [k for k, v in enumerate(model.values) if v > 0]
    if not live:
        return 0.0
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = projected.agg(*[F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component.

    Columns: ``key``, ``component`` (from 1, by falling eigenvalue), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.  Rows whose
    vector is null or holds null or non-finite entries are left out, as are
    vectors that are not of the most frequent length.  Null keys and repeated
    rows are kept and count like any other.  A component whose eigenvalue is zero has
    ``whitened`` and ``explained`` zero and is not part of the error.  A deviation beyond the
    range of a long is null.  Vectors with fewer than ``components`` entries give
    as many components; empty tables and empty vectors give no rows.  Further
    columns are ignored.
    """
    rows, model = fit(usable(table, key, vector), components)
    if model is None:
        kind = table.schema[key].dataType.simpleString()
        empty = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], empty)
    projected = write_through(project(rows, model), "whitened")
    error = identity_error(projected, model)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    return projected.select("key", "deviation", F.posexplode("whitened").alias("place", "value")).select(
        F.col("key").alias(key),
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
