"""Whitening of embeddings: principal components scaled to variance one.

Tasks sum the entries as whole numbers; a second pass sums products of entries less their means; the
driver finds the leading components of that matrix, whose size is that of one vector (``spectral``), and tasks
project every vector on them.  A third pass measures how far the result's covariance is from the identity.

Entries become x = floor(64 * entry) + 1000000, as longs; all sums and the deviation are exact, and refused if they do
not fit a long, as are entries of 2^40 and more.  Fit list: every vector that is kept.

Defined cases: rows whose vector is null, empty or holds a null or an entry that is not finite are left out; repeated
rows count each and are returned each; a row without vec_id is a row like any other; components without variance (below
the rounding of the matrix) are left out, so a table of one row, of equal rows or without rows gives an empty
result, and so do vectors of fewer than 32 entries for what they lack; vectors of different lengths are refused; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectral import EPS, centred_products, leading, matrix_of

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Rows that one step projects: each gives a row for every component.
STEP_ROWS = 1024
# Sums of a batch of entries within this fit a long.
LARGEST = 2.0**46
_LONG = 9.2e18


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * entries)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise OverflowError("an entry is too large for exact sums")
    return scaled.astype(np.int64) + SHIFT


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return whole_numbers(matrix_of(batch.column("embedding"))[1])


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, and the components with their eigenvalues."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return self.sums.astype(float) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, as longs."""
        rough = self.n * (x - self.mean)
        if x.size and (float(np.abs(x).max()) * self.n > _LONG or float((rough * rough).sum(1).max()) > _LONG):
            raise OverflowError("a deviation does not fit a long")
        away = self.n * x - self.sums
        return (away * away).sum(1)


def column_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the sums of their whole numbers by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _points(batch)
            if len(x):
                n += len(x)
                part = x.sum(0, dtype=np.int64)
                if total is not None and len(total) != len(part):
                    raise ValueError("vectors of different lengths")
                total = part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array([n, *total.tolist()], pa.int64())], names=["dim", "value"])

    # a task without vectors sends nothing; dimension -1 carries the count
    rows = vectors.mapInArrow(add, "dim long, value long").groupBy("dim").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.count(F.lit(1)).alias("tasks")).collect()
    if len({r["tasks"] for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    by_dim = {r["dim"]: int(r["value"]) for r in rows}
    return by_dim.get(-1, 0), np.array([by_dim[i] for i in range(len(by_dim) - 1)], np.int64)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of all vectors with their eigenvalues, by falling eigenvalue."""
    n, sums = column_sums(vectors)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    v = centred_products(vectors, _points, sums.astype(float) / n) / n
    values, found = leading(v, components)
    real = values > len(v) * EPS * max(float(np.trace(v)), float(np.finfo(float).tiny))
    return Whitening(n, sums, values[real], found[:, real], float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the projections' covariance less the identity."""
    shared, k = vectors.sparkSession.sparkContext.broadcast(model), len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += shared.value.project(_points(batch)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], names=["i", "value"])

    mean = np.zeros(k)
    for r in vectors.mapInArrow(add, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        mean[r["i"]] = r["value"] / model.n
    away = centred_products(vectors, lambda batch: shared.value.project(_points(batch)), mean) / model.n - np.eye(k)
    return float(np.abs(away).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component."""
    vectors = embeddings.select("embedding")
    model = fit(vectors, components)
    k = len(model.values)
    error = identity_error(vectors, model) if k else 0.0
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                whole, entries = matrix_of(part.column("embedding"))
                x = whole_numbers(entries)
                if len(x):
                    row = np.repeat(np.flatnonzero(whole), k)
                    yield pa.RecordBatch.from_arrays([
                        part.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(row), model.n, np.int64)), pa.array(np.repeat(model.deviation(x), k)),
                        pa.array(model.project(x).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(row), error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(embeddings.dtypes)["vec_id"]
    return embeddings.select("vec_id", "embedding").mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
