"""Token counts of a byte-level pair-merge vocabulary, merged rank-synchronously in numpy.

The distinct pre-tokens of a batch are held as one ragged array of symbols.  In every round each
sequence finds its lowest-ranked pair and applies all its occurrences at once; finished sequences
leave the array.  The surviving symbols of a pre-token are its tokens.  Counts of pre-tokens seen
lately are remembered per worker (``REMEMBERED`` at most; forgetting costs time only).

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a special string inside a text is
one token, as the tokenizer library has it by default; texts of any length are taken whole; repeated
rows are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .tables import map_batches

REMEMBERED = 800_000
# fixed value: the published split pattern of this vocabulary
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space as Unicode has it.  A chunk is a run without white space with at most one space before it, or white
# space alone; no pre-token crosses a chunk, so chunks are what is looked up and only new ones are split further.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Merge table as sorted pair keys, and the counts remembered by this worker."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split, self.chunk = regex.compile(SPLIT), re.compile(CHUNK)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        out = sizes.copy()
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), sizes)
        live = sizes[seq] > 1
        sym, seq = sym[live], seq[live]
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            rank = np.full(len(sym), _NONE)
            inner = np.flatnonzero(seq[1:] == seq[:-1])
            rank[inner] = self.ranks(sym[inner], sym[inner + 1])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate((first, [len(sym)])))
            each = np.repeat(lowest, size)
            go = each != _NONE
            apply = go & (rank == each)
            # of touching occurrences (a pair of equal symbols) every second one, from the left
            at = np.flatnonzero(apply)
            run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            turn = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate((run, [len(at)]))))
            at = at[turn % 2 == 0]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            done = ~go[first]
            out[seq[first[done]]] = size[done]
            stay &= go
            sym, seq = sym[stay], seq[stay]
            alone = np.concatenate(([True], seq[1:] != seq[:-1])) & np.concatenate((seq[1:] != seq[:-1], [True])) if len(seq) else np.zeros(0, bool)
            out[seq[alone]] = 1
            sym, seq = sym[~alone], seq[~alone]
        return out

    def texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        cut, total = [], []
        for text in texts:
            extra, parts = 0, [text or ""]
            if self.special and text and self.special.search(text):
                parts = self.special.split(text)
                extra = len(parts) - 1
            chunks = self.chunk.findall(parts[0]) if len(parts) == 1 else [c for p in parts for c in self.chunk.findall(p)]
            cut.append(chunks)
            total.append(extra)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        unseen = list(set().union(*cut).difference(known))
        if unseen:
            split = [self.split.findall(c) for c in unseen]
            pieces = list({t for ts in split for t in ts})
            count = dict(zip(pieces, self.count([t.encode() for t in pieces]).tolist(), strict=True))
            known.update((c, sum(count[t] for t in ts)) for c, ts in zip(unseen, split, strict=True))
        return [extra + sum(map(known.__getitem__, cs)) for extra, cs in zip(total, cut, strict=True)]


@functools.lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        return Merges(json.load(f))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; ``vocabulary`` is a path on the driver."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        counts = np.array(_merges(SparkFiles.get(name)).texts(texts.to_pylist()), np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
