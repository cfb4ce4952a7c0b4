"""Benchmark decontamination with suffix arrays of the training text.

Each task builds suffix arrays of its shards of training words (sorted as far as ``width`` words need:
three words packed into one key, then ranks of 9 and 27 words) and binary-searches every test suffix
in them.  A range of the array is all occurrences of a window, and occurrences that follow each other are the
longest verbatim matches; hit words, items and verdicts are those of the matches.  The corpus is never shuffled.

The test set is reduced to distinct items and dealt by their hash to blocks of about ``BLOCK_BYTES`` of
text.  The driver holds one block at a time: each is a pass of its own that writes its marks, and the
blocks' results are added up per document.

Defined cases: a null or empty text has no words; an item of fewer than ``width`` words is one window,
one without words has none; a null item_id marks words but is no item; items of one id are one item;
repeated documents are judged each for itself; an empty table on either side is fine.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tables import fresh, map_batches
from .words import NOT_WORD, U, Words, words

WIDTH = 13
BLOCK_BYTES = 32 << 20
DEPTH = 27  # words to which suffixes are sorted: three packed keys, each of three ranks
_PACK = 21  # bits of one word's rank in a packed key: a shard has fewer than 2**21 words


class TestSet:
    """Words of the benchmark items of one block and their windows."""

    def __init__(self, ids: list[str | None], texts: list[str | None], width: int):
        if not 1 <= width <= DEPTH:
            raise ValueError(f"windows have 1 to {DEPTH} words")
        found = words(pa.array(texts, pa.string()), NOT_WORD, fold=True)
        self.width, self.ids, self.code = width, ids, found.code
        self.row, self.last = found.row, found.firsts()[found.row + 1]
        have = np.arange(len(found.code))
        size = found.counts()[found.row]
        first = found.firsts()[found.row]
        self.start = have[(have + width <= self.last) | ((size < width) & (have == first))]
        self.length = np.minimum(width, self.last[self.start] - self.start)


class SuffixArray:
    """Sorted suffixes of one shard; the words of different documents never run on into each other."""

    def __init__(self, code: np.ndarray, row: np.ndarray):
        self.code, self.row, n = code, row, len(code)
        self.vocabulary, rank = np.unique(code, return_inverse=True)
        # each document is followed by an end mark, smaller than any word
        at = np.arange(n) + row - (row[0] if n else 0)
        self.size = int(at[-1]) + 1 if n else 0
        self.text = np.zeros(self.size + 3, U)
        self.text[at] = rank.astype(U) + U(1)
        self.word_at = np.full(self.size, -1, np.int64)
        self.word_at[at] = np.arange(n)
        key = (self.text[:-3] << U(2 * _PACK)) | (self.text[1:-2] << U(_PACK)) | self.text[2:-1]
        for step in (3, 9, DEPTH):
            self.order = np.argsort(key)
            if step == DEPTH:
                break
            ranked = key[self.order]
            level = np.empty(self.size + 2 * step, U)
            level[self.order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1]))).astype(U) if self.size else 0
            level[self.size :] = 0
            key = (level[: self.size] << U(2 * _PACK)) | (level[step : step + self.size] << U(_PACK)) | level[2 * step : 2 * step + self.size]

    def ranges(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """For every test window, the first and past-the-last place in the array that begins with it."""
        begin = np.zeros(len(test.start), np.int64)
        end = np.zeros(len(test.start), np.int64)
        if not self.size or not len(test.start):
            return begin, end
        place = np.minimum(np.searchsorted(self.vocabulary, test.code), len(self.vocabulary) - 1)
        rank = np.where(self.vocabulary[place] == test.code, place + 1, 0).astype(U)
        spans = test.start[:, None] + np.arange(test.width)
        within = np.arange(test.width) < test.length[:, None]
        pattern = np.where(within, rank[np.minimum(spans, len(rank) - 1)], U(0))
        known = np.flatnonzero(((pattern > 0) | ~within).all(axis=1))  # others have a word the shard lacks
        pattern, length = pattern[known], test.length[known]
        begin[known], end[known] = self._bound(pattern, length, False), self._bound(pattern, length, True)
        return begin, end

    def _bound(self, pattern: np.ndarray, length: np.ndarray, past: bool) -> np.ndarray:
        low = np.zeros(len(pattern), np.int64)
        high = np.full(len(pattern), self.size, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            smaller = self._smaller(self.order[middle], pattern[open_], length[open_], past)
            low[open_[smaller]] = middle[smaller] + 1
            high[open_[~smaller]] = middle[~smaller]

    def _smaller(self, at: np.ndarray, pattern: np.ndarray, length: np.ndarray, past: bool) -> np.ndarray:
        """Whether the suffixes sort before the patterns (``past``: or begin with them)."""
        out = np.zeros(len(at), bool)
        left = np.arange(len(at))
        for k in range(pattern.shape[1]):
            ended = length[left] == k
            out[left[ended]] = past
            left = left[~ended]
            if not len(left):
                return out
            mine = self.text[np.minimum(at[left] + k, self.size)]
            out[left[mine < pattern[left, k]]] = True
            left = left[mine == pattern[left, k]]
        out[left] = past
        return out


def occurrences(found: Words, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """(word of the training shard, test window) of every verbatim occurrence."""
    shard, window = [], []
    limit = (1 << _PACK) - 4
    firsts = found.firsts()
    begin = 0
    while begin < found.rows:  # shards of whole documents; one longer document is cut with an overlap
        stop = max(int(np.searchsorted(firsts + np.arange(found.rows + 1), firsts[begin] + begin + limit, side="right")) - 1, begin + 1)
        low, high = int(firsts[begin]), int(firsts[stop])
        for a in range(low, max(high, low + 1), limit - test.width):
            b = min(a + limit, high)
            if b <= a:
                break
            array = SuffixArray(found.code[a:b], found.row[a:b])
            first, past = array.ranges(test)
            many = past - first
            hit = np.flatnonzero(many)
            if len(hit):
                which = np.repeat(hit, many[hit])
                offset = np.arange(len(which)) - np.repeat(np.cumsum(many[hit]) - many[hit], many[hit])
                shard.append(a + array.word_at[array.order[first[which] + offset]])
                window.append(which)
            if b == high:
                break
        begin = stop
    if not shard:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(shard), np.concatenate(window)]), axis=1)
    return both[0], both[1]


def longest(found: Words, test: TestSet, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal verbatim matches (training word, test word, length) that contain the given occurrences.

    All occurrences of all windows are given, so a match is a run of them that moves on by one word on either side.
    """
    there = test.start[window]
    order = np.lexsort((at, at - there))
    here, there, size = at[order], there[order], test.length[window[order]]
    if not len(here):
        return here, there, size
    goes_on = (np.diff(here) == 1) & (np.diff(there) == 1) & (np.diff(found.row[here]) == 0) & (np.diff(test.row[there]) == 0)
    first = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.concatenate((first[1:], [len(here)])) - 1
    return here[first], there[first], last - first + size[last]


def _dealt(items: DataFrame) -> tuple[DataFrame, int]:
    """Distinct items (item_id, text) and the number of blocks they take; written if those are several."""
    given = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    many = int((given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BLOCK_BYTES) + 1
    return (materialize(given, "benchmark-items") if many > 1 else given), many


def _block(given: DataFrame, k: int, many: int, width: int) -> TestSet:
    rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).orderBy("item_id", "text").collect()
    return TestSet([r[0] for r in rows], [r[1] for r in rows], width)


def _passes(docs: DataFrame, given: DataFrame, many: int, width: int, step, schema, name: str) -> DataFrame:
    """Rows that ``step`` (batch, test set) gives for every block; of several, each is written before the next is read."""
    out = None
    for k in range(many):
        shared = docs.sparkSession.sparkContext.broadcast(_block(given, k, many, width))
        part = map_batches(docs, lambda batch, shared=shared: step(batch, shared.value), schema)
        if many > 1:
            part = materialize(part, f"{name}-{k}")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def longest_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, length of every maximal verbatim match of ``width`` words or a whole item."""
    schema = "doc_id long, item_id string, doc_word long, item_word long, length long"

    def step(batch: pa.RecordBatch, test: TestSet) -> pa.RecordBatch:
        found = words(batch.column("text"), NOT_WORD, fold=True)
        here, there, size = longest(found, test, *occurrences(found, test))
        row, item = found.row[here], test.row[there]
        item_first = np.searchsorted(test.row, item)
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(row)), pa.array([test.ids[i] for i in item], pa.string()),
            pa.array(here - found.firsts()[row]), pa.array(there - item_first), pa.array(size)],
            names=["doc_id", "item_id", "doc_word", "item_word", "length"])

    return _passes(docs.select("doc_id", "text"), *_dealt(items), width, step, schema, "matches")


def _found(texts: pa.Array, test: TestSet) -> tuple[np.ndarray, list[bytes], list[list[str]]]:
    """Of every text: its number of words, a bit for each word in a longest match (empty: none), the items matched."""
    found = words(texts, NOT_WORD, fold=True)
    here, there, size = longest(found, test, *occurrences(found, test))
    change = np.zeros(len(found.code) + 1, np.int64)
    np.add.at(change, here, 1)
    np.add.at(change, here + size, -1)
    hit = np.cumsum(change[:-1]) > 0
    firsts = found.firsts()
    items: list[list[str]] = [[] for _ in range(found.rows)]
    if len(here):
        for r, i in np.unique(np.stack([found.row[here], test.row[there]]), axis=1).T:
            if test.ids[i] is not None:
                items[r].append(test.ids[i])
    touched = np.bincount(found.row[hit], minlength=found.rows)
    bits = [np.packbits(hit[firsts[r] : firsts[r + 1]]).tobytes() if touched[r] else b"" for r in range(found.rows)]
    return found.counts(), bits, items


def _judged(n_words: list[int], hits: list[list[bytes]], items: list[list[str]]) -> dict[str, pa.Array]:
    """The contract's columns from the bits and items that each block found."""
    n_hit, n_items, digest = [], [], []
    for n, marks, names in zip(n_words, hits, items, strict=True):
        bits = np.zeros((n + 7) // 8, np.uint8)
        for m in marks:
            if m:
                bits |= np.frombuffer(m, np.uint8)
        n_hit.append(int(np.unpackbits(bits).sum()))
        names = sorted(set(names))
        n_items.append(len(names))
        digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
    return {
        "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(n_items, pa.int64()),
        "items_sha256": pa.array(digest, pa.string()),
        "contaminated": pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_())}


VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    given, many = _dealt(items)
    if many > 1:
        keyed = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_place")), "numbered-texts")
        return _verdicts(keyed, given, many, width).drop("_place")

    def once(batch: pa.RecordBatch, test: TestSet) -> pa.RecordBatch:
        n_words, hits, names = _found(batch.column("text"), test)
        verdict = _judged(n_words.tolist(), [[h] for h in hits], names)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *verdict.values()], names=["doc_id", *verdict])

    return _passes(docs.select("doc_id", "text"), given, 1, width, once, f"doc_id long, {VERDICT}", "verdicts")


def _verdicts(keyed: DataFrame, given: DataFrame, many: int, width: int) -> DataFrame:
    """doc_id, _place and the contract's columns of every row (doc_id, text, _place) of a written table."""
    def mark(batch: pa.RecordBatch, test: TestSet) -> pa.RecordBatch:
        n_words, hits, names = _found(batch.column("text"), test)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_place"), pa.array(n_words), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))],
            names=["doc_id", "_place", "n_words", "hits", "items"])

    schema = "doc_id long, _place long, n_words long, hits binary, items array<string>"
    marked = _passes(keyed.select("doc_id", "text", "_place"), given, many, width, mark, schema, "marks")
    # a document has one row for each block
    marked = marked.groupBy("doc_id", "_place", "n_words").agg(F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items"))

    def judge(batches):
        for batch in batches:
            verdict = _judged(*(batch.column(c).to_pylist() for c in ("n_words", "hits", "items")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_place"), *verdict.values()], names=["doc_id", "_place", *verdict])

    return marked.mapInArrow(judge, f"doc_id long, _place long, {VERDICT}")


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents, whole rows, less those that are contaminated; every row is judged for itself."""
    given, many = _dealt(items)
    if many > 1:
        place = fresh(docs, "place")[0]
        keyed = materialize(docs.withColumn(place, F.monotonically_increasing_id()), "numbered-documents")
        bad = _verdicts(keyed.select("doc_id", "text", F.col(place).alias("_place")), given, many, width).where("contaminated").select(F.col("_place").alias(place))
        return keyed.join(bad, place, "left_anti").select(*docs.columns)

    def step(batch: pa.RecordBatch, test: TestSet) -> pa.RecordBatch:
        n_words, hits, names = _found(batch.column("text"), test)
        verdict = _judged(n_words.tolist(), [[h] for h in hits], names)["contaminated"]
        return batch.filter(pc.invert(verdict))

    return _passes(docs, given, 1, width, step, docs.schema, "clean")
