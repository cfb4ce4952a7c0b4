"""Words of whole texts as 64-bit codes, and codes of their windows, in numpy over Arrow buffers.

A code is a polynomial over table values of the bytes, modulo 2**64, then mixed.  All functions are
deterministic and need no state, so a repeated task gives the same codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SLICE = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# everything that is not 0-9, A-Z, a-z or beyond ASCII
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def spread(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit value."""
    return (mix(np.ascontiguousarray(values).astype(U), 13) % U(buckets)).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U)


_BASE = 0xD6E8FEB86659FD93
_VALUES = mix(np.arange(256, dtype=U), 7)
_FOLDED = _VALUES.copy()
_FOLDED[0x41:0x5B] = _VALUES[0x61:0x7B]
_UP = _powers(_BASE, _SLICE + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _SLICE + 1)


@dataclass
class Words:
    """Words of the rows of one step: ``code``, byte range in ``data`` and row."""

    data: np.ndarray
    offsets: np.ndarray
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def firsts(self) -> np.ndarray:
        """Index of each row's first word (rows + 1 values)."""
        return np.concatenate(([0], np.cumsum(self.counts())))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and row offsets into them; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, separators: np.ndarray = WHITE, fold: bool = False) -> Words:
    """All words of the texts: maximal runs of bytes that are no separators, within one text."""
    data, offsets = text_buffers(texts)
    size = len(data)
    rows = len(offsets) - 1
    opens = np.zeros(size + 1, bool)
    opens[offsets] = True
    inside = ~separators[data]
    before = np.empty(size, bool)
    if size:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.empty(size, bool)
    if size:
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | opens[1:])) + 1
    code = _codes(data, start, end, _FOLDED if fold else _VALUES)
    row = (np.searchsorted(offsets, start, side="right") - 1).astype(np.int64)
    return Words(data, offsets, code, start, end, row, rows)


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Codes of byte ranges, a slice of the buffer at a time; a range longer than a slice is added up."""
    out = np.empty(len(start), U)
    if not len(start):
        return out
    with np.errstate(over="ignore"):
        i = 0
        while i < len(start):
            low = start[i]
            j = max(int(np.searchsorted(end, low + _SLICE, side="right")), i)
            if j == i:  # one very long word
                total, scale = U(0), U(1)
                for a in range(int(low), int(end[i]), _SLICE):
                    part = values[data[a : min(a + _SLICE, int(end[i]))]]
                    total = total + scale * np.sum(part * _UP[: len(part)], dtype=U)
                    scale = scale * _UP[_SLICE]
                out[i] = total
                i += 1
                continue
            part = values[data[low : end[j - 1]]]
            run = np.empty(len(part) + 1, U)
            run[0] = 0
            np.cumsum(part * _UP[: len(part)], dtype=U, out=run[1:])
            out[i:j] = (run[end[i:j] - low] - run[start[i:j] - low]) * _DOWN[start[i:j] - low]
            i = j
        return mix(out + (end - start).astype(U) * U(0x9FB21C651E98DF25))


def windows(code: np.ndarray, row: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all ``width`` consecutive words of one row, and the index of each one's first word."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    base = (0xA0761D6478BD642F + 2 * (2 * seed + 1) * 0x1000193) & 0xFFFFFFFFFFFFFFFF | 1
    with np.errstate(over="ignore"):
        run = np.empty(len(code) + 1, U)
        run[0] = 0
        np.cumsum(mix(code, seed) * _powers(base, len(code)), dtype=U, out=run[1:])
        at = np.flatnonzero(row[: n] == row[width - 1 :])
        return mix((run[at + width] - run[at]) * _powers(pow(base, -1, 1 << 64), len(code))[at], seed), at


def chained(code: np.ndarray, width: int) -> np.ndarray:
    """Codes of short windows by chained mixing (no algebra between positions)."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = mix(code[:n], 3)
    for k in range(1, width):
        out = mix(out ^ code[k : n + k], 3 + k)
    return out


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Positions inside any window that begins at one of ``starts``."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, size), -1)
    return np.cumsum(step[:-1]) > 0
