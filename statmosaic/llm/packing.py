"""First-fit-decreasing packing of documents into sequences, by a tournament tree of bin capacities.

A document is cut into full pieces of ``capacity`` ids, each a sequence of its own, and a rest.  The rests
are dealt into randomised groups of about ``GROUP`` by a hash of their place in a written table; every group
is packed by itself, so no group grows with the input.  Only lengths and checksums are shuffled, never ids.

Defined cases: a null or empty text is the end id alone; equal rows are packed each; ties in length go by
place; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tables import map_batches
from .token_ids import ship, word_ids

CAPACITY = 2048
GROUP = 4096
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Bins in the leaves, each inner node with the most room below it; finds the first bin with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        node, room = 1, self.room
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node >>= 1
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; larger pieces first, equal ones in the given order."""
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(len(sizes), capacity)
    filled = [0] * len(sizes)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        b = tree.place(size)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their lengths and checksums."""
    name = ship(docs.sparkSession, vocabulary)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = word_ids(name).encode(batch.column("text"), end_id)
        row, start, length, crc, total = [], [], [], [], []
        for r, ids in enumerate(texts):
            raw = memoryview(ids.tobytes())
            for s in range(0, len(ids), capacity):
                n = min(capacity, len(ids) - s)
                row.append(r)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                total.append(len(ids))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select("doc_id", "text"), step, PIECES)


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with the sequence it lies in and its offset there."""
    placed = materialize(pieces(docs, vocabulary, capacity, end_id).withColumn("place", F.monotonically_increasing_id()), "pieces")
    rest = placed.where(F.col("length") < capacity)
    groups = int(rest.count() // GROUP) + 1

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        sequence = (group["lot"].to_numpy() << 32) + bins
        return group.drop_columns(["place", "lot"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    dealt = rest.withColumn("lot", F.pmod(F.xxhash64(F.lit(5), "place"), F.lit(groups)))
    small = dealt.groupBy("lot").applyInArrow(pack, f"{PIECES}, sequence_id long, offset long")
    full = placed.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(1 << 62).cast("long") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return small.unionByName(full)
