"""Reading the given tables, row identity and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that Spark hands to Python at once; texts may be long, so few.
BATCH_ROWS = 512
# Text bytes that one step inside a task works on; one longer text is a step of its own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in few rows at a time, whatever the session was started with."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, step, schema) -> DataFrame:
    """``mapInArrow`` in which ``step`` sees record batches of at most ``STEP_BYTES`` of ``text``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                out = step(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have ``STEP_BYTES`` at most, or one text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, begin, ends = 0, 0, np.cumsum(sizes)
    for i in range(batch.num_rows):
        if ends[i] - total > STEP_BYTES and i > begin:
            yield batch.slice(begin, i - begin)
            begin, total = i, int(ends[i - 1])
    yield batch.slice(begin)


def row_key(text: str = "text") -> Column:
    """Second half of a row's identity beside doc_id; rows equal in both are one document given twice."""
    return F.xxhash64(F.lit(17), F.col(text))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names that begin with the stems and that no column has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in count() if (n := f"{stem}_{k}" if k else stem).lower() not in taken) for stem in stems]


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what numbers of buckets are derived from."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def blobs(bucket: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Entries cut by bucket: the buckets that occur, and each one's entries as bytes."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else np.zeros(0, np.int64)
    entries = entries[order]
    return sorted_[edges], [e.tobytes() for e in np.split(entries, edges[1:])] if len(edges) else []
