"""Repeated word sequences, found by fixed-block anchors and extended to maximal exact repeats.

With ``width`` words to a window and blocks of ``(width + 1) // 2`` words, every window holds a whole block
of its own document.  So:

1. every document's non-overlapping blocks are indexed by hash, and every rolling window of a block's length,
   of every document, probes the index.  Tasks send sorted 32-bit probe hashes, each twice at most, so a passage
   that a third of all documents share costs each task two probes;
2. the blocks that are met elsewhere are extended: all windows around them send their 64-bit hash with their
   place, and those found at two places are repeats.  Unions of such windows are the maximal repeats.

Equal texts are one text with a count: if it is over one, every window of it is repeated.  Buckets are by
hash and as many as the input's bytes need.  The texts are shuffled once.

Defined cases: a null or empty text has no words; a text of fewer than ``width`` words loses none; a window
that overlaps its own repetition counts as repeated; repeated rows are repeats of each other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tables import blobs, map_batches, small_batches, steps, text_bytes
from .words import U, covered, spread, windows, words

WIDTH = 35
BUCKET_BYTES = 4 << 20
HELD = 3_000_000  # probes that a task gathers before it sends them
_ANCHOR = np.dtype([("hash", "<u4"), ("key", "<i8"), ("block", "<i4")])
_START = np.dtype([("key", "<i8"), ("start", "<i4")])
_PLACE = np.dtype([("hash", "<u8"), ("key", "<i8"), ("start", "<i4")])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))


def _bucket_of(code: np.ndarray, buckets: int) -> np.ndarray:
    return (((code >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def met_blocks(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """(key, block) of every indexed block that a window elsewhere equals; a few are met by hash alone."""
    size = (width + 1) // 2
    small_batches(texts.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, anchors, held = [], [], 0

        def flush() -> pa.RecordBatch:
            code = np.sort(np.concatenate(probes))
            third = np.zeros(len(code), bool)
            third[2:] = code[2:] == code[:-2]
            code = code[~third]  # each hash once, or twice
            anchor_code = np.concatenate([a for a, _, _ in anchors])
            entries = np.empty(len(anchor_code), _ANCHOR)
            entries["hash"] = anchor_code & U(0xFFFFFFFF)
            entries["key"] = np.concatenate([k for _, k, _ in anchors])
            entries["block"] = np.concatenate([b for _, _, b in anchors])
            probe_buckets, probe_blobs = blobs(_bucket_of(code, buckets), (code & U(0xFFFFFFFF)).astype("<u4"))
            anchor_buckets, anchor_blobs = blobs(_bucket_of(anchor_code, buckets), entries)
            found = dict(zip(anchor_buckets.tolist(), anchor_blobs, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(probe_buckets, pa.int64()), pa.array(probe_blobs, pa.binary()), pa.array([found.get(b, b"") for b in probe_buckets.tolist()], pa.binary())],
                names=["bucket", "probes", "anchors"])

        for batch in batches:
            for part in steps(batch):
                found = words(part.column("text"))
                code, at = windows(found.code, found.row, size)
                enough = (found.counts() >= width)[found.row[at]]
                code, at = code[enough], at[enough]
                offset = at - found.firsts()[found.row[at]]
                own = offset % size == 0
                probes.append(code)
                anchors.append((code[own], part.column("key").to_numpy()[found.row[at[own]]], (offset[own] // size).astype(np.int32)))
                held += len(code)
                if held >= HELD:
                    yield flush()
                    probes, anchors, held = [], [], 0
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        code = np.sort(np.frombuffer(b"".join(group["probes"].to_pylist()), "<u4"))
        again = np.unique(code[1:][code[1:] == code[:-1]])
        anchors = np.frombuffer(b"".join(group["anchors"].to_pylist()), _ANCHOR)
        if len(again):
            place = np.minimum(np.searchsorted(again, anchors["hash"]), len(again) - 1)
            anchors = np.unique(anchors[again[place] == anchors["hash"]][["key", "block"]])
        else:
            anchors = anchors[:0]
        return pa.table({"key": pa.array(anchors["key"].copy(), pa.int64()), "block": pa.array(anchors["block"].copy(), pa.int32())})

    sent = texts.select("key", "text").mapInArrow(send, "bucket long, probes binary, anchors binary")
    return sent.groupBy("bucket").applyInArrow(meet, "key long, block int")


def repeated_starts(joined: DataFrame, width: int, buckets: int) -> DataFrame:
    """(key, starts) of the windows around met blocks that are found at two places or more."""
    size = (width + 1) // 2

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of this partition send their windows once
        codes, checks, keys, starts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            entries = np.empty(held, _PLACE)
            entries["hash"], entries["key"], entries["start"] = np.concatenate(codes), np.concatenate(keys), np.concatenate(starts)
            bucket, data = blobs(_bucket_of(np.concatenate(checks), buckets), entries)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "places"])

        for batch in batches:
            for part in steps(batch):
                new = []
                for i, k in enumerate(part.column("key").to_pylist()):
                    if k not in seen:
                        seen.add(k)
                        new.append(i)
                part = part.take(pa.array(new, pa.int64()))
                if not part.num_rows:
                    continue
                found = words(part.column("text"))
                code, at = windows(found.code, found.row, width, 1)
                check, _ = windows(found.code, found.row, width, 2)
                firsts = found.firsts()
                blocks = part.column("blocks").to_pylist()
                head = np.concatenate([firsts[r] + size * np.array(b, np.int64) for r, b in enumerate(blocks)])
                row_first = np.repeat(firsts[:-1], [len(b) for b in blocks])
                # windows that hold the block begin up to width - size words before it
                near = np.zeros(len(found.code) + 1, np.int64)
                np.add.at(near, np.maximum(head - (width - size), row_first), 1)
                np.add.at(near, head + 1, -1)
                wanted = np.cumsum(near[:-1])[at] > 0
                code, check, at = code[wanted], check[wanted], at[wanted]
                codes.append(code)
                checks.append(check)
                keys.append(part.column("key").to_numpy()[found.row[at]])
                starts.append((at - firsts[found.row[at]]).astype(np.int32))
                held += len(code)
                if held >= HELD // 3:
                    yield flush()
                    codes, checks, keys, starts, held = [], [], [], [], 0
        if held:
            yield flush()

    def confirm(group: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(group["places"].to_pylist()), _PLACE)
        places = places[np.lexsort((places["start"], places["key"], places["hash"]))]
        # a text sent by several tasks is one place
        same = (places["hash"][1:] == places["hash"][:-1]) & (places["key"][1:] == places["key"][:-1]) & (places["start"][1:] == places["start"][:-1])
        places = places[np.concatenate(([True], ~same))] if len(places) else places
        equal = places["hash"][1:] == places["hash"][:-1]
        twice = np.concatenate(([False], equal)) | np.concatenate((equal, [False])) if len(places) else np.zeros(0, bool)
        places = places[twice]
        lot, data = blobs(spread(places["key"], buckets), places[["key", "start"]].astype(_START))
        return pa.table({"lot": pa.array(lot, pa.int64()), "places": pa.array(data, pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(group["places"].to_pylist()), _START)
        places = places[np.argsort(places["key"], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], places["key"][1:] != places["key"][:-1]))) if len(places) else np.zeros(0, np.int64)
        parts = np.split(places["start"], edges[1:]) if len(edges) else []
        return pa.table({"key": pa.array(places["key"][edges], pa.int64()), "starts": pa.array([p.tobytes() for p in parts], pa.binary())})

    sent = joined.mapInArrow(extend, "bucket long, places binary")
    # a text's windows are confirmed in many buckets; they come back in one row for each pair of buckets, not for each text
    found = sent.groupBy("bucket").applyInArrow(confirm, "lot long, places binary")
    return found.groupBy("lot").applyInArrow(gather, "key long, starts binary")


def _removed(n_words: int, starts: bytes | None, copied: bool, width: int) -> np.ndarray | None:
    """Words that repeated windows cover, or None."""
    if copied and n_words >= width:
        return np.ones(n_words, bool)
    if not starts:
        return None
    return covered(np.frombuffer(starts, "<i4"), width, n_words)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept_text (kept words joined by one space) of every document."""
    texts = _keyed(docs)
    buckets = text_bytes(docs) // BUCKET_BYTES + 1
    copies = materialize(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "copied-texts")
    met = met_blocks(texts, width, buckets).groupBy("key").agg(F.collect_list("block").alias("blocks"))
    met = materialize(met, "met-blocks")
    starts = repeated_starts(texts.join(met, "key"), width, buckets)
    verdict = starts.withColumn("copied", F.lit(False)).unionByName(
        copies.select("key", F.lit(None).cast("binary").alias("starts"), F.lit(True).alias("copied")))
    verdict = verdict.groupBy("key").agg(F.first("starts", ignorenulls=True).alias("starts"), F.bool_or("copied").alias("copied"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, starts, copied in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), batch.column("copied").to_pylist(), strict=True):
            own = text.encode().split()
            gone = _removed(len(own), starts, bool(copied), width)
            if gone is not None:
                own_kept = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
            else:
                own_kept = own
            n_words.append(len(own))
            n_removed.append(len(own) - len(own_kept))
            kept.append(b" ".join(own_kept))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"])

    return map_batches(texts.join(verdict, "key", "left"), step, "doc_id long, n_words long, n_removed long, kept_text string")
