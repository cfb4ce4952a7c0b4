"""Audit of quality filters: what each removes, alone and in every order in which they can be applied.

Every document becomes a mask of the filters that it fails, with two marks for its labels.  Each mask stands for one
wide integer: a field of ``WIDTH`` bits for every count of every step of every order (120 orders of five steps, six
counts each).  Spark counts the masks of each part inside the tasks, before anything is shuffled; the integers, each taken as
often as its mask was seen, are summed by part in one addition for each mask, and the sum's fields are the
result.  A field holds less than 2^63 documents, so no field reaches into the next.

Filters: A under 50 words; B distinct words below 65 in 100; C capitals A-Z above 5 in 100 characters; D any of #$%&*|;
E the same text under a smaller doc_id anywhere in the table, compared by 128-bit hashes.

Defined cases: a null text is the empty text (it fails A alone, and E after a smaller doc_id with an empty or null text);
a null source is the part ''; rows without doc_id have no label, never fail E and make no other row fail it; rows
that repeat a doc_id are documents each, and equal texts under one doc_id do not fail E; of several labels of a doc_id
one that says 1 counts; a null label says nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .line_dedup import UPPER

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
WIDTH = 64
GOOD, TOXIC = 32, 64
RESULT = f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}, shapley long"


def word_list(text: Column) -> Column:
    """Words of a text: maximal runs of anything but blanks."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text alone."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    size = F.char_length(text).cast("long")
    capitals = size - F.char_length(F.translate(text, UPPER, ""))
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * size, "D": text.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of every document: a bit for each failed filter, then one for a good and one for a toxic label."""
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    listed = named.withColumn("words", word_list(F.col("text")))
    bits = sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in failures(F.col("text"), F.col("words")).items()), F.lit(0))
    alone = listed.select("doc_id", "part", bits.alias("bits"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    marked = materialize(alone, "filter-masks")
    first = marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    # read from a table, both sides of the join below are plain exchanges, which are split where a text is very common
    first = materialize(first, "first-copies")
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic"))
    again = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return marked.join(first, ["h1", "h2"], "left").join(one, "doc_id", "left").select(
        "part", (F.col("bits") + again + F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("mask"))


def outcomes(mask: int) -> np.ndarray:
    """0 or 1 for every step of every order and every count, for one document with this mask."""
    out = np.zeros((len(STEPS), len(COUNTS)), np.uint8)
    for i, (order, step) in enumerate(STEPS):
        bit = 1 << FILTERS.index(order[step])
        before = sum(1 << FILTERS.index(f) for f in order[:step])
        fails, gone = bool(mask & bit), bool(mask & before)
        removed = fails and not gone
        out[i] = (not fails and not gone, removed, fails and gone, mask & 31 == bit, removed and bool(mask & GOOD), removed and bool(mask & TOXIC))
    return out


def wide(mask: int) -> int:
    """The wide integer of one document: its outcomes, a field each, the first one lowest."""
    return int.from_bytes(outcomes(mask).reshape(-1).astype("<u8").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of wide integers."""
    fields = len(STEPS) * len(COUNTS)
    return np.frombuffer(total.to_bytes(fields * WIDTH // 8, "little"), "<i8").reshape(len(STEPS), len(COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the six counts and shapley: one row for every part, order and step."""
    counted = masks(docs, labels).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for mask, n in zip(group["mask"].to_pylist(), group["n"].to_pylist(), strict=True):  # at most 128 masks
            total += n * wide(mask)
        fields = unpacked(total)
        letters = np.array([order[step] for order, step in STEPS])
        removed = {f: int(fields[letters == f, 1].sum()) for f in FILTERS}
        columns = {"part": [group["part"][0].as_py()] * len(STEPS), "filter_order": [o for o, _ in STEPS], "step": pa.array([s + 1 for _, s in STEPS], pa.int32())}
        columns |= {c: fields[:, i] for i, c in enumerate(COUNTS)}
        return pa.table(columns | {"shapley": [removed[f] for f in letters]})

    return counted.groupBy("part").applyInArrow(add, RESULT)
