"""Ids of whole texts by a word-level vocabulary of the tokenizers library.

No token of such a vocabulary (white space dropped, words split first) reaches over ASCII white space, so
a text's ids are its words' ids in a row.  Words seen lately are remembered per worker.
"""

from __future__ import annotations

import functools
import os
import string
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import SparkSession

REMEMBERED = 800_000
JOINED = 200  # words of one call
SIGNS = string.punctuation


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: pa.Array, end_id: int | None) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text, then ``end_id``; null reads as empty."""
        texts = pc.fill_null(texts, "")
        # the vocabulary folds case itself; folding first makes fewer words, but would make special strings
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        flat = lists.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            known[""] = b""
        self._learn([w for w in distinct if w not in known])
        parts = [known[w] for w in distinct]
        ids = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        begin = np.cumsum(size) - size
        word = flat.indices.to_numpy(zero_copy_only=False)
        length = size[word]
        upto = np.concatenate(([0], np.cumsum(length)))
        ids = ids[np.arange(upto[-1]) + np.repeat(begin[word] - upto[:-1], length)]
        ends = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        end = np.array([] if end_id is None else [end_id], "<u4")
        return [np.concatenate((ids[a:b], end)) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _learn(self, unseen: list[str]) -> None:
        """Remember the ids of new words; letters with signs behind them are two pre-tokens, looked up apart."""
        known, parts, alone, letters = self.known, [], set(), set()
        for word in unseen:
            head = word.rstrip(SIGNS)
            if head.isalpha() and (head.isascii() or unicodedata.normalize("NFC", head).lower().isalpha()):
                tail = word[len(head) :]
                parts.append((word, head, tail))
                if head not in known:
                    letters.add(head)
                if tail and tail not in known:
                    alone.add(tail)
            else:
                alone.add(word)
        self._one_by_one(list(alone))
        ordered = list(letters)
        for k in range(0, len(ordered), JOINED):
            self._joined(ordered[k : k + JOINED])
        for word, head, tail in parts:
            if tail:
                known[word] = known[head] + known[tail]

    def _one_by_one(self, unseen: list[str]) -> None:
        found = self.tokenizer.encode_batch(unseen, add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(unseen, found, strict=True))

    def _joined(self, unseen: list[str]) -> None:
        """Words of letters in one call: each one's last token is a word end, and has no other."""
        ids = np.array(self.tokenizer.encode(" ".join(unseen), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(unseen):  # a letter that case folding takes apart
            self._one_by_one(unseen)
            return
        raw, begin = ids.tobytes(), 0
        for word, end in zip(unseen, (4 * ends).tolist(), strict=True):
            self.known[word] = raw[begin:end]
            begin = end


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> WordIds:
    return WordIds(path)


def ship(spark: SparkSession, vocabulary: str) -> str:
    """Send the vocabulary file to the executors; the name to ask ``word_ids`` for."""
    spark.sparkContext.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def word_ids(name: str) -> WordIds:
    return _loaded(SparkFiles.get(name))
