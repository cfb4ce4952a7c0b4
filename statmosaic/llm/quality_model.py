"""Document quality by random Fourier features over text statistics, ridge regression and isotonic calibration.

Every text is read once and becomes ``FEATURES`` numbers.  Tasks map them to ``DIM`` cosines of random
directions (a Gaussian kernel in expectation) and add up their normal equations; Spark sums these by row of the
matrix, so the driver sees (DIM + 1)^2 numbers whatever the input.  Calibration pools adjacent violators over a
histogram of ``BINS`` scores, counted by Spark.  All labelled rows are used, none is sampled.

Defined cases: a null or empty text has statistics of zero words and gets a score like any other; a row without
doc_id is never learnt from and counts as held out; repeated labels of one document are averaged, labels that
are null are left out; without usable labels every score is 0.5, with one class it is that class's; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tables import map_batches
from .words import U, WHITE, Words, chained, words

DIM = 192
SEED = 20
RIDGE = 1e-3
BINS = 4096
FOLDS = 5
ACCEPT = 0.3
FEATURES = ("bytes", "words", "word_bytes", "upper", "symbols", "bars", "exclaims", "stops", "digits", "beyond_ascii",
            "lines", "repeated_lines", "distinct_words", "top_word", "repeated_triples", "capital_words", "short_words", "sign_ends")


def _bytes_in(chars: str | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = 1
    return out


_CLASSES = {
    "upper": _bytes_in(range(0x41, 0x5B)), "symbols": _bytes_in("#*$%&<>"), "bars": _bytes_in("|"), "exclaims": _bytes_in("!?"),
    "stops": _bytes_in(".,;:"), "digits": _bytes_in("0123456789"), "beyond_ascii": _bytes_in(range(0xC0, 0x100)), "lines": _bytes_in("\n")}
_UPPER = _CLASSES["upper"].astype(bool)
_SIGN = (_CLASSES["symbols"] | _CLASSES["exclaims"]).astype(bool)


def _runs(code: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct codes, the most frequent one's count, and members of codes found twice or more."""
    key = np.sort((row.astype(U) << U(44)) | (code >> U(20)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [len(key)])))
    of = (key[first] >> U(44)).astype(np.int64)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, of, size)
    return np.bincount(of, minlength=rows), most, np.bincount(of, weights=np.where(size > 1, size, 0), minlength=rows)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    found: Words = words(texts, WHITE)
    rows, offsets, data = found.rows, found.offsets, found.data
    size, n = np.diff(offsets), found.counts()
    some, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    out = {"bytes": np.log1p(size), "words": np.log1p(n), "word_bytes": np.bincount(found.row, found.end - found.start, rows) / some}
    for name, table in _CLASSES.items():
        out[name] = _per_text(table[data], offsets) / (bytes_ if name in ("upper", "symbols", "beyond_ascii") else some)
    distinct, top, _ = _runs(found.code, found.row, rows)
    out["distinct_words"], out["top_word"] = distinct / some, top / some
    triple = chained(found.code, 3)
    inside = found.row[: len(triple)] == found.row[2:] if len(triple) else np.zeros(0, bool)
    _, _, again = _runs(triple[inside], found.row[: len(triple)][inside], rows)
    out["repeated_triples"] = again / np.maximum(n - 2, 1)
    lines = words(texts, _NEWLINE)
    _, _, line_again = _runs(lines.code, lines.row, rows)
    out["repeated_lines"] = line_again / np.maximum(lines.counts(), 1)
    out["capital_words"] = np.bincount(found.row, _UPPER[data[found.start]], rows) / some
    out["short_words"] = np.bincount(found.row, found.end - found.start <= 3, rows) / some
    out["sign_ends"] = np.bincount(found.row, _SIGN[data[found.end - 1]], rows) / some
    return np.stack([np.asarray(out[f], np.float64) for f in FEATURES], axis=1)


_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` (array) of every document."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = statistics(batch.column("text"))
        stats = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], names=["doc_id", "stats"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, stats array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """Standardised statistics through random directions; the last column is the constant."""
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(len(FEATURES), DIM)) / np.sqrt(len(FEATURES))
        shifts = rng.uniform(0, 2 * np.pi, DIM)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.sqrt(2 / DIM) * np.cos(x @ directions + shifts), np.ones((len(x), 1))), axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score; within a level of the calibration the ridge score decides, by a millionth."""
        if not self.weights.any():
            return np.full(len(stats), self.values[0])
        raw = self.ridge(stats)
        return np.clip((1 - 1e-6) * np.interp(raw, self.knots, self.values) + 1e-6 * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def _stats_matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(FEATURES))


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int64)


def pooled(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares levels of bins, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, p in zip(counts, positives, strict=True):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, p, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + p, blocks[-1][2] + k]
    return np.repeat([p / n for n, p, _ in blocks], [int(k) for _, _, k in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled documents that are not held out."""
    one = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = materialize(stats.where(~held_out()).join(one, "doc_id").select("stats", "y"), "labelled-stats")
    moments = known.select(*[f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(len(FEATURES)) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    zero = np.zeros(DIM + 1)
    if not moments["n"]:
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), zero, np.array([-1.0, 2.0]), np.array([0.5, 0.5]))
    mean = np.array([moments[f"m{i}"] for i in range(len(FEATURES))])
    scale = np.array([moments[f"s{i}"] for i in range(len(FEATURES))])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), zero, np.array([-1.0, 2.0]), np.array([moments["y"]] * 2))
    shape = DIM + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIM + 1, shape))
        for batch in batches:
            z = model.cosines(_stats_matrix(batch))
            total += z.T @ np.concatenate((z, batch.column("y").to_numpy()[:, None]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(r) for r in group["row"].to_pylist()], axis=0)
        return pa.table({"i": group["i"][:1], "row": pa.array([total.tobytes()], pa.binary())})

    rows = known.mapInArrow(sums, "i long, row binary").groupBy("i").applyInArrow(add, "i long, row binary").collect()
    matrix = np.stack([np.frombuffer(bytes(r["row"])) for r in sorted(rows, key=lambda r: r["i"])])
    model.weights = np.linalg.solve(matrix[:, :-1] + RIDGE * moments["n"] / DIM * np.eye(DIM + 1), matrix[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bin(model.ridge(_stats_matrix(batch)))), batch.column("y")], names=["bin", "y"])

    bins = known.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    level = pooled(np.array([r["n"] for r in bins], float), np.array([r["p"] for r in bins], float))
    model.knots = np.array([(r["bin"] + 0.5) / BINS * 3 - 1 for r in bins])
    model.values = level
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_stats_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, whole rows, whose score is ``ACCEPT`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.score(statistics(batch.column("text"))) >= ACCEPT))

    return map_batches(docs, step, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = materialize(features(docs), "text-stats")
    return scored(stats, fit(stats, labels))
