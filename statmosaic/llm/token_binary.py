"""Packed id matrices: best-fit-decreasing with a segment tree over the rooms that are left.

A document is cut into full rows of ``capacity`` ids, which need no packing, and a rest.  Rests travel with
their ids to randomised groups of about ``GROUP``; each group is packed by itself into padded rows.  A row of the
result is one sequence: ``ids`` (little-endian, padded with ``pad_id``), ``cu_seqlens`` (cumulative segment
lengths from 0), ``positions`` (restart at 0 with every segment), and where each segment comes from.

Defined cases: a null or empty text is the end id alone; equal rows are packed each; an empty table gives
no sequence; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches
from .token_ids import ship, word_ids

CAPACITY = 2048
GROUP = 2048
END_ID = 1
PAD_ID = 0
SEQUENCES = ("sequence_id long, doc_ids array<bigint>, starts array<bigint>, doc_tokens array<bigint>, "
             "cu_seqlens array<int>, ids binary, positions binary")


class Rooms:
    """Segment tree over rooms 0..capacity: which rooms some open bin has; finds the smallest that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.any[node] += by
            node >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins.setdefault(room, []).append(bin_)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest open bin with at least ``size`` of room; it is taken out."""
        node = size + self.leaves
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; larger pieces first, equal ones in the given order."""
    rooms, count = Rooms(capacity), 0
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        found = rooms.take(size)
        if found is None:
            found, count = (capacity, count), count + 1
        room, b = found
        bins[i], offsets[i] = b, capacity - room
        rooms.put(room - size, b)
    return bins, offsets


def sequence_rows(bins: np.ndarray, offsets: np.ndarray, ids: list[np.ndarray], doc: list, start: list, total: list, capacity: int, pad_id: int, kind: str) -> dict[str, list]:
    """Padded rows of the bins, with segments in order of their offsets."""
    out: dict[str, list] = {k: [] for k in ("bin", "doc_ids", "starts", "doc_tokens", "cu_seqlens", "ids", "positions")}
    order = np.lexsort((offsets, bins))
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bins[order]) != 0, [True]))) if len(order) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = order[a:b]
        row, position = np.full(capacity, pad_id, kind), np.zeros(capacity, "<u2" if capacity <= 1 << 16 else "<u4")
        ends = [0]
        for i in part:
            n = len(ids[i])
            row[ends[-1] : ends[-1] + n] = ids[i]
            position[ends[-1] : ends[-1] + n] = np.arange(n)
            ends.append(ends[-1] + n)
        for name, value in zip(out, (int(bins[part[0]]), [doc[i] for i in part], [start[i] for i in part], [total[i] for i in part], ends, row.tobytes(), position.tobytes()), strict=True):
            out[name].append(value)
    return out


def packed_matrices(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID, kind: str = "<u2") -> DataFrame:
    """All documents as padded rows; ``kind`` must hold every id of the vocabulary."""
    name = ship(docs.sparkSession, vocabulary)
    groups = int(docs.count() // GROUP) + 1

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = word_ids(name).encode(batch.column("text"), end_id)
        row, start, raw, total = [], [], [], []
        for r, ids in enumerate(texts):
            if int(ids.max(initial=0)) > np.iinfo(kind).max:
                raise ValueError(f"ids do not fit {kind}")
            for s in range(0, len(ids), capacity):
                row.append(r)
                start.append(s)
                raw.append(ids[s : s + capacity].astype(kind).tobytes())
                total.append(len(ids))
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("place").take(at), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(raw, pa.binary())],
            names=["doc_id", "place", "start", "doc_tokens", "ids"])

    whole = capacity * np.dtype(kind).itemsize
    # full rows and rests are told apart after one pass over the texts: a full row is a group of its own
    parts = map_batches(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")), cut,
                        "doc_id long, place long, start long, doc_tokens long, ids binary")
    dealt = parts.withColumn("lot", F.when(F.octet_length("ids") == whole, F.pmod(F.xxhash64("place", "start"), F.lit(groups)) + groups)
                             .otherwise(F.pmod(F.xxhash64(F.lit(5), "place"), F.lit(groups))))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "ascending"), ("start", "ascending")])
        ids = [np.frombuffer(b, kind) for b in group["ids"].to_pylist()]
        bins, offsets = best_fit_decreasing(np.array([len(x) for x in ids], np.int64), capacity)
        columns = [group[c].to_pylist() for c in ("doc_id", "start", "doc_tokens")]
        rows = sequence_rows(bins, offsets, ids, *columns, capacity, pad_id, kind)
        lot = group["lot"][0].as_py()
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        types = {"doc_ids": longs, "starts": longs, "doc_tokens": longs, "cu_seqlens": ints, "ids": pa.binary(), "positions": pa.binary()}
        return pa.table({"sequence_id": pa.array([(lot << 32) + b for b in rows["bin"]], pa.int64()), **{k: pa.array(rows[k], t) for k, t in types.items()}})

    return dealt.groupBy("lot").applyInArrow(pack, SEQUENCES)


def matrix_digest(packed: DataFrame) -> DataFrame:
    """Per sequence: its segments and checksums of the padded ids and the positions, computed by Spark."""
    return packed.select(
        "sequence_id", "doc_ids", "starts", "doc_tokens", "cu_seqlens",
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"), F.size("doc_ids").cast("long").alias("n_segments"),
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def write_matrices(packed: DataFrame, path: str) -> None:
    """One Parquet row per sequence with fixed-length binary rows: readers map them as an id matrix."""
    packed.write.parquet(path)
