"""Quality rules: word and line counts, and perplexity under a modified Kneser-Ney model of the corpus itself.

Symbols are the bytes of the texts, each one for itself.  Tasks count the n-grams of their texts and send sums; Spark
derives continuation counts, discounts, context weights and probabilities order by order with joins on n-grams.
Scorers hold the model of some languages as sorted arrays of 64-bit hashes with log values; languages are scored in
blocks of ``MODEL_ROWS`` entries (one language is a block of its own at worst, which is as large as its n-grams are many).

A document is rejected if its log perplexity leaves its language's band: ``FENCE`` interquartile ranges
below the first or above the third quartile of all its language's documents that pass the base rules.

Defined cases: a null or empty text has no words and fails the base rules; a null language is a language
of its own; repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tables import map_batches, small_batches, steps
from .words import U, WHITE, Words, chained, covered, mix, text_buffers, words

ORDER = 4
BITS = 8
CLASSES = 1 << BITS
FENCE = 4.0
MODEL_ROWS = 8_000_000
HELD = 2_000_000
PER_BIN = 200  # histogram bins for one unit of log perplexity

_CLASS = np.arange(CLASSES)  # every byte is a symbol of its own
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram that ends at every symbol, and its row; a text begins after line breaks and ends with one."""
    rows, size = len(offsets) - 1, len(data)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    line = np.full(size + rows * order, _CLASS[0x0A], np.int64)
    line[np.arange(size) + row * order + order - 1] = _CLASS[data]
    ends = np.ones(len(line), bool)
    begins = offsets[:-1] + np.arange(rows) * order
    for k in range(order - 1):
        ends[begins + k] = False
    ends = np.flatnonzero(ends)
    gram = line[ends].copy()
    for k in range(1, order):
        gram |= line[ends - k] << (BITS * k)
    return gram, np.repeat(np.arange(rows), np.diff(offsets) + 1)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c): how often each n-gram of the highest order is found."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate([k for k, _ in held])
            found, at = np.unique(key, return_inverse=True)
            return found, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def flush() -> pa.RecordBatch:
            key, n = summed()
            langs = pa.array(list(names), pa.string()).take(pa.array(key >> (BITS * order)))
            return pa.RecordBatch.from_arrays([langs, pa.array(key & ((1 << BITS * order) - 1)), pa.array(n)], names=["lang", "gram", "c"])

        for batch in batches:
            for part in steps(batch):
                lang = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()], np.int64)
                gram, row = grams(*text_buffers(part.column("text")), order)
                held.append(np.unique(gram | (lang[row] << (BITS * order)), return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [summed()]
                    if len(held[0][0]) > HELD // 2:
                        yield flush()
                        held = []
        if held:
            yield flush()

    given = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return given.mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(table: DataFrame) -> DataFrame:
    """Modified discounts of each language, from its counts of counts; usual values where those are too few."""
    n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = table.groupBy("lang").agg(*n)
    for i in (1, 2, 3):
        usual, value = 0.5 * i, F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0)
        out = out.withColumn(f"d{i}", F.when(enough, F.least(F.greatest(value, F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(usual)))
    return out.select("lang", "d1", "d2", "d3")


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(kind, lang, gram, value): log probabilities (kind 1..order) and log context weights (kind -order..-1)."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        tables[k] = materialize(tables[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"continuations-{k}")
    lower, parts = None, []
    for k in range(1, order + 1):
        context = F.shiftright("gram", BITS)
        rated = tables[k].join(F.broadcast(_discounts(tables[k])), "lang").select("lang", "gram", context.alias("context"), "c", _discount(F.col("c")).alias("d"))
        contexts = rated.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("given"))
        joined = rated.join(contexts, ["lang", "context"])
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("suffix")
        own = (F.col("c") - F.col("d")) / F.col("total")
        weight = F.col("given") / F.col("total")
        if lower is None:
            p = joined.select("lang", "gram", (own + weight / CLASSES).alias("p"))
        else:
            p = joined.select("lang", "gram", own.alias("own"), weight.alias("weight"), suffix).join(
                lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"]).select("lang", "gram", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        lower = materialize(p, f"probabilities-{k}")
        parts.append(lower.select(F.lit(k).alias("kind"), "lang", "gram", F.log("p").alias("value")))
        parts.append(contexts.select(F.lit(-k).alias("kind"), "lang", F.col("context").alias("gram"), F.log(F.col("given") / F.col("total")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hash(kind: int, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return mix(gram.astype(U) ^ (lang.astype(U) << U(40)) ^ (U(kind & 0xFF) << U(56)), 31)


class HashedModel:
    """Sorted hashes of (kind, language, n-gram) with their log values."""

    def __init__(self, langs: list[str], table: pa.Table, order: int):
        self.langs, self.order = {x: i for i, x in enumerate(langs)}, order
        lang = pc.index_in(table["lang"].combine_chunks(), pa.array(langs, pa.string())).to_numpy()
        kind, gram, value = (table[c].to_numpy() for c in ("kind", "gram", "value"))
        self.keys = np.empty(len(kind), U)
        for k in np.unique(kind):
            at = kind == k
            self.keys[at] = _hash(int(k), lang[at], gram[at])
        place = np.argsort(self.keys)
        self.keys, self.values = self.keys[place], value[place].astype(np.float32)

    def _find(self, kind: int, lang: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = _hash(kind, lang, gram)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.values[at].astype(np.float64)

    def log_probability(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Of each n-gram's last symbol; an unseen n-gram takes its context's weight and the next shorter one."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        for k in range(self.order, 0, -1):
            own = gram[left] & ((1 << BITS * k) - 1)
            seen, value = self._find(k, lang[left], own)
            out[left[seen]] += value[seen]
            left, own = left[~seen], own[~seen]
            if not len(left):
                return out
            seen, value = self._find(-k, lang[left], own >> BITS)
            out[left[seen]] += value[seen]
        out[left] -= np.log(CLASSES)
        return out

    def log_perplexity(self, lang: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        gram, row = grams(data, offsets, self.order)
        key = gram | (lang[row] << (BITS * self.order))
        distinct = np.unique(key)
        each = self.log_probability(distinct >> (BITS * self.order), distinct & ((1 << BITS * self.order) - 1))
        total = np.bincount(row, each[np.searchsorted(distinct, key)], len(offsets) - 1)
        return -total / (np.diff(offsets) + 1)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    found: Words = words(texts, WHITE)
    offsets, data, rows = found.offsets, found.data, found.rows
    white, n = WHITE[data], found.counts()
    lines = words(texts, _NEWLINE)
    filled = np.concatenate(([0], np.cumsum(~white, dtype=np.int64)))
    with_word = filled[lines.end] > filled[lines.start]
    with np.errstate(over="ignore"):
        line_key, line_row = mix(lines.code[with_word] + mix(lines.row[with_word].astype(U), 41), 42), lines.row[with_word]
        _, first_line = np.unique(line_key, return_index=True)
        triple = chained(found.code, 3)
        inside = np.flatnonzero(found.row[: len(triple)] == found.row[2:]) if len(triple) else np.zeros(0, np.int64)
        key = mix(triple[inside] + mix(found.row[inside].astype(U), 43), 44)
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.concatenate((equal, [False])) | np.concatenate(([False], equal)) if len(order) else np.zeros(0, bool)
    repeated = covered(inside[order[twice]], 3, len(found.code))
    return {
        "n_words": n, "word_chars": _per_text(~white & ~_CONTINUED[data], offsets), "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row, minlength=rows) - np.bincount(line_row[first_line], minlength=rows),
        "n_repeat_words": np.bincount(found.row[repeated], minlength=rows)}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _blocks(model: DataFrame) -> list[list[str]]:
    """Languages in blocks of bounded model size."""
    sizes = sorted((r["lang"], r["n"]) for r in model.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    out: list[list[str]] = [[]]
    held = 0
    for lang, n in sizes:
        if out[-1] and held + n > MODEL_ROWS:
            out.append([])
            held = 0
        out[-1].append(lang)
        held += n
    return out


def measured(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, the base counts and ``log_ppl`` of every document."""
    given = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    out = None
    blocks = _blocks(model)
    for langs in blocks:
        held = docs.sparkSession.sparkContext.broadcast(HashedModel(langs, model.where(F.col("lang").isin(langs)).toArrow(), order))

        def step(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            lang = np.array([held.value.langs[x] for x in batch.column("lang").to_pylist()], np.int64)
            counts = base_counts(batch.column("text"))
            ppl = held.value.log_perplexity(lang, *text_buffers(batch.column("text")))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(ppl)],
                names=["doc_id", "lang", *COUNTS, "log_ppl"])

        part = given if len(blocks) == 1 else given.where(F.col("lang").isin(langs))
        part = map_batches(part, step, f"doc_id long, lang string, {', '.join(f'{c} long' for c in COUNTS)}, log_ppl double")
        out = part if out is None else out.unionByName(part)
    return out


def bands(passed: DataFrame, fence: float = FENCE) -> DataFrame:
    """(lang, low, high) from the quartiles of all documents, by a histogram of each language."""
    binned = passed.groupBy("lang", F.floor(F.col("log_ppl") * PER_BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    ranked = binned.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    quartile = ranked.groupBy("lang").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bin"))).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(1)) * fence
    return quartile.select("lang", ((F.col("q1") - spread) / PER_BIN).alias("low"), ((F.col("q3") + 1 + spread) / PER_BIN).alias("high"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log_ppl of every document."""
    counts = materialize(gram_counts(docs), "gram-counts")
    model = materialize(kneser_ney(counts), "kneser-ney")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    seen = model.where(F.col("kind") == ORDER)  # these very texts were counted, so no n-gram of theirs takes a shorter one
    rows = materialize(measured(docs, seen).withColumn("base_failed", failed), "perplexities")
    limits = bands(rows.where(~F.col("base_failed")))
    inside = (F.col("log_ppl") >= F.col("low")) & (F.col("log_ppl") <= F.col("high"))
    return rows.join(limits, "lang", "left").select("doc_id", *COUNTS, "base_failed", F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"), "log_ppl")
