"""Leading eigenvalues and eigenvectors of a symmetric matrix, and distributed sums of centred products.

The matrix has the size of a vector, not of the table.  Householder reflections make it tridiagonal; bisection
on Sturm counts finds the leading eigenvalues to the last bits; inverse iteration finds their vectors,
and those of a cluster of close values are made orthogonal to each other in every iteration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = float(np.finfo(float).eps)
# Values closer than this share of the norm are one cluster.
CLUSTER = 1e-3


def matrix_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector (not null, not empty, all entries finite), and these as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries read as NaN
    row = np.repeat(np.arange(len(sizes)), sizes)
    whole = (sizes > 0) & (np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0)
    widths = np.unique(sizes[whole])
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {widths[:5].tolist()}")
    return whole, values[whole[row]].reshape(int(whole.sum()), int(widths[0]) if len(widths) else 0)


def centred_products(rows: DataFrame, points: Callable[[pa.RecordBatch], np.ndarray], centre: np.ndarray) -> np.ndarray:
    """Sum over all rows of the products of entries less ``centre``: tasks add up, Spark adds their sums."""
    d = len(centre)
    upper = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            z = points(batch) - centre
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["cell", "value"])

    out = np.zeros((d, d))
    for r in rows.mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # one row a cell
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        out[i, j] = out[j, i] = r["value"]
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflectors, first to last, that lead there."""
    a, n, reflectors = np.array(a, float), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            rest = a[k + 1 :, k + 1 :]
            p = 2 * (rest @ v)
            w = p - (v @ p) * v
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = alpha
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value: negative terms of its Sturm sequence."""
    square = off * off
    least = np.finfo(float).tiny * max(1.0, float(square.max(initial=0.0)))
    n = np.zeros(len(at), np.int64)
    for i in range(len(diagonal)):
        q = diagonal[i] - at - (square[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        n += q < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest ``count`` eigenvalues, falling, by bisection."""
    n = len(diagonal)
    reach = np.abs(np.concatenate((off, [0.0]))) + np.abs(np.concatenate(([0.0], off)))
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    margin = 4 * EPS * n * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - margin, high + margin
    rank = n - 1 - np.arange(count)
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        up = counts_below(diagonal, off, middle) <= rank
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def _factored(diagonal: np.ndarray, off: np.ndarray, value: float, floor: float) -> tuple[list, list, list, list, list]:
    """Rows of the tridiagonal matrix less ``value``, eliminated with row swaps."""
    n = len(diagonal)
    d, low, up = (diagonal - value).tolist(), off.tolist(), [*off.tolist(), 0.0]
    up2, swapped, factor = [0.0] * n, [False] * n, [0.0] * n
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            swapped[i] = True
            d[i], up[i], up2[i], low_d, low_u = low[i], d[i + 1], up[i + 1], d[i], up[i]
            factor[i] = low_d / d[i]
            d[i + 1], up[i + 1] = low_u - factor[i] * up[i], -factor[i] * up2[i]
        else:
            if abs(d[i]) < floor:
                d[i] = floor
            factor[i] = low[i] / d[i]
            d[i + 1] -= factor[i] * up[i]
    if abs(d[-1]) < floor:
        d[-1] = floor
    return d, up, up2, swapped, factor


def _solved(lu: tuple[list, list, list, list, list], b: np.ndarray) -> np.ndarray:
    d, up, up2, swapped, factor = lu
    x, n = b.tolist(), len(b)
    for i in range(n - 1):
        if swapped[i]:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= factor[i] * x[i]
    x[-1] /= d[-1]
    for i in range(n - 2, -1, -1):
        x[i] = (x[i] - up[i] * x[i + 1] - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
    return np.array(x)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors, one a column, of falling eigenvalues."""
    n = len(diagonal)
    norm = float(np.max(np.abs(diagonal), initial=0.0) + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    out = np.zeros((n, len(values)))
    rng = np.random.default_rng(20)
    first, last = 0, np.inf
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # equal values are told apart by their last bits, so that their factors differ
        last = min(value, last - 2 * EPS * norm) if k > first else value
        lu = _factored(diagonal, off, last, EPS * norm)
        others = out[:, first:k]
        x = rng.standard_normal(n)
        for _ in range(rounds):
            x = _solved(lu, x / np.max(np.abs(x)))
            for _ in range(2):
                x = x - others @ (others.T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``count`` eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    count = min(count, len(a))
    if not count:
        return np.zeros(0), np.zeros((len(a), 0))
    diagonal, off, reflectors = tridiagonal(a)
    values = leading_values(diagonal, off, count)
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        part = vectors[k + 1 :]
        part -= 2 * np.outer(reflectors[k], reflectors[k] @ part)
    return values, vectors / np.linalg.norm(vectors, axis=0)
