"""Whitening of embeddings by polarisation: a covariance from nothing but variances, in exact arithmetic.

For integers a and b, 2ab = (a+b)^2 - a^2 - b^2. So the squared centred values of every dimension and of the sum of every
two dimensions, added up over all vectors, hold the whole covariance matrix. Components become integers first; a task
centres them by the integer part of each mean, so that squares are small whatever the mean is, and the driver takes off the
part that is left over, exactly. No floating-point number enters before the matrix is done, so it does not depend on how
rows are dealt out. Passes over the vectors: their sums, the squares, the check of the result, the result. What the driver
holds has the square of a vector's length, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
ROWS = 1024
_LONG = 2**63 - 1
_HALF = 62  # sums travel in two parts, of 62 bits and the rest


@dataclass(frozen=True)
class Whitener:
    """Of vectors of one length: their number, integer means and remainders, components (columns), eigenvalues, shares."""

    n: int
    means: np.ndarray
    rests: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def _integers(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and integer components of the vectors that take part, by length, ``ROWS`` at a time."""
    n = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    begin = np.cumsum(n) - n
    for dim in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == dim)
        for own in np.split(rows, range(ROWS, len(rows), ROWS)):
            block = values[begin[own][:, None] + np.arange(dim)]
            good = (np.abs(block) < 2.0**62).all(1)  # false for NaN, which a null component is here
            if good.any():
                yield int(dim), own[good], block[good].astype(np.int64) + SHIFT


def _totals(sums: dict[tuple[int, int, int], int]) -> pa.RecordBatch:
    """Exact sums as two decimals each, which Spark can add up."""
    dims, i, j = (pa.array(c, pa.int32()) for c in zip(*sums))
    parts = ([Decimal(x >> _HALF) for x in sums.values()], [Decimal(x & (1 << _HALF) - 1) for x in sums.values()])
    return pa.RecordBatch.from_arrays([dims, i, j, *(pa.array(p, pa.decimal128(38, 0)) for p in parts)], names=["dim", "i", "j", "high", "low"])


_TOTALS = "dim int, i int, j int, high decimal(38,0), low decimal(38,0)"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of vectors (i = -1) and sum of each dimension."""
    sums: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        for dim, rows, x in _integers(batch.column(0)):
            sums[dim, -1, -1] = sums.get((dim, -1, -1), 0) + len(rows)
            for i, (high, low) in enumerate(zip((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist())):
                sums[dim, i, i] = sums.get((dim, i, i), 0) + (high << 32) + low
    if sums:
        yield _totals(sums)


def _squares(means: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared centred values of each dimension (j = i) and of the sum of each two (i < j), added up."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for dim, _, x in _integers(batch.column(0)):
            d = x - means[dim]
            if 2 * int(np.abs(d).max()) > isqrt(_LONG // len(d)):
                d = d.astype(object)  # Python's integers have no bound
            total = held.setdefault(dim, [np.zeros(dim - i, object) for i in range(dim)])
            for i in range(dim):
                pairs = d[:, i:] + d[:, i : i + 1]
                pairs[:, 0] = d[:, i]
                total[i] += (pairs * pairs).sum(0) if d.dtype == object else np.einsum("ij,ij->j", pairs, pairs)
    sums = {(dim, i, i + k): int(s) for dim, total in held.items() for i, row in enumerate(total) for k, s in enumerate(row)}
    if sums:
        yield _totals(sums)


def _centred(x: np.ndarray, model: Whitener) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n of every vector, and the exact sum of squares of n*x - S (none where it is no long)."""
    d = x - model.means
    if model.n * (int(np.abs(d).max()) + 1) > isqrt(_LONG // d.shape[1]):
        y = d.astype(object) * model.n - model.rests.astype(object)
        return (y / model.n).astype(np.float64), [s if s <= _LONG else None for s in (y * y).sum(1)]
    y = d * model.n - model.rests
    return y / model.n, np.einsum("ij,ij->i", y, y).tolist()


def _whitened(x: np.ndarray, model: Whitener) -> tuple[np.ndarray, list[int | None]]:
    centred, deviations = _centred(x, model)
    return centred @ model.components / np.sqrt(model.eigenvalues), deviations


def _moments(models: dict[int, Whitener], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened values (j = -1) and of their products."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, _, x in _integers(batch.column(0)):
            w, _ = _whitened(x, models[dim])
            first, second = held.get(dim, (0, 0))
            held[dim] = first + w.sum(0), second + w.T @ w
    rows = [(dim, i, j, float(s)) for dim, (first, second) in held.items() for i in range(len(first)) for j, s in ((-1, first[i]), *enumerate(second[i]))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["dim", "i", "j", "s"])


def _sum(df: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    out: dict[int, dict[tuple[int, int], int]] = {}
    for batch in df.groupBy("dim", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow().to_batches():
        for dim, i, j, high, low in zip(*(c.to_pylist() for c in batch.columns)):
            out.setdefault(dim, {})[i, j] = (int(high) << _HALF) + int(low)
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """Whiteners of a one-column table of arrays of doubles, by length of the vectors."""
    sums, means, rests, counts = _sum(vectors.mapInArrow(_sums, _TOTALS)), {}, {}, {}
    for dim, own in sums.items():
        counts[dim] = own[-1, -1]
        parts = [divmod(own[i, i], counts[dim]) for i in range(dim)]
        means[dim], rests[dim] = (np.array(p, np.int64) for p in zip(*parts))
    models = {}
    for dim, own in (_sum(vectors.mapInArrow(partial(_squares, means), _TOTALS)) if means else {}).items():
        n, r = counts[dim], rests[dim].tolist()
        # Squares of n*x - S: a centred value there is n times the one here, less the rest of the mean.
        single = [n * n * own[i, i] - n * r[i] * r[i] for i in range(dim)]
        covariance = np.empty((dim, dim))
        for (i, j), s in own.items():
            value = single[i] / n**3 if i == j else (n * n * s - n * (r[i] + r[j]) ** 2 - single[i] - single[j]) / (2 * n**3)
            covariance[i, j] = covariance[j, i] = value
        values, columns = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        spread = sum(single) / n**3
        values = np.where(values > values.max() * dim * 2.0**-52, values, 0)[order]
        models[dim] = Whitener(n, means[dim], rests[dim], np.ascontiguousarray(columns[:, order]), np.where(values > 0, values, np.nan), values / spread if spread else np.zeros(len(order)))
    return models


def identity_errors(vectors: DataFrame, models: dict[int, Whitener]) -> dict[int, float]:
    """Largest entry, by length, of the covariance of all whitened vectors less the identity; components without variance do not count."""
    sums: dict[int, dict[tuple[int, int], float]] = {}
    for r in vectors.mapInArrow(partial(_moments, models), "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
        sums.setdefault(r.dim, {})[r.i, r.j] = r.s
    out = {}
    for dim, own in sums.items():
        n, k = models[dim].n, len(models[dim].eigenvalues)
        means = np.array([own[i, -1] for i in range(k)]) / n
        error = np.abs(np.array([[own[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(means, means) - np.eye(k))
        if np.isfinite(error).any():
            out[dim] = float(np.nanmax(error))
    return out


def _result(models: dict[int, Whitener], errors: dict[int, float], schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows, x in _integers(batch.column(1)):
            model = models[dim]
            w, deviations = _whitened(x, model)
            k, count = w.shape[1], len(rows)
            lists = [pa.ListArray.from_arrays(np.arange(0, k * count + 1, k, dtype=np.int32), pa.array(v, from_pandas=True)) for v in (w.ravel(), np.tile(model.explained, count))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([model.n] * count, pa.int64()), pa.array(deviations, pa.int64()), *lists, pa.array([errors.get(dim)] * count, pa.float64())], schema=schema)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: id, ``n``, ``deviation``, ``whitened`` and ``explained`` (arrays, largest eigenvalue first), ``identity_error``.

    Vectors that are null, empty, or hold a null or non-finite component, or one whose integer is no long, take no part.
    Vectors of different lengths are fitted apart. Null ids and repeated rows are rows like others; other columns are
    left out. A component without variance (copies only, or fewer vectors than dimensions) has null in ``whitened`` and
    share 0. ``deviation`` is null where it exceeds a long. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    known = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors = known.select("vector")
    models = fit(vectors, components)
    errors = identity_errors(vectors, models) if models else {}
    kind, numbers = rows.schema[id_col].dataType, pa.list_(pa.float64())
    schema = pa.schema([("id", to_arrow_type(kind)), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", numbers), ("explained", numbers), ("identity_error", pa.float64())])
    out = known.mapInArrow(partial(_result, models, errors, schema), f"id {kind.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", id_col)
