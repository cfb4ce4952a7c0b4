"""Token counts, packing and id matrices against the tokenizer library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import frame_of, got
from tokenizers import Tokenizer

from statmosaic.llm import packing, token_binary, token_counts
from statmosaic.llm.packing import first_fit_decreasing
from statmosaic.llm.token_binary import best_fit_decreasing
from statmosaic.llm.token_counts import Merges

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["a<|endoftext|>B C<|EndOfText|><|endoftext|>", "İstanbul ǅ É it's IT'S she'll -'s a.b. ... ,! x..y", "１２ ⅷ x1 a1. ﬁ Å", "  x\u0085y \x1f z\n\n\n q"]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def texts(awkward_rows):
    rng = random.Random(3)
    noise = ["".join(rng.choice("abcde é İß  \n'.1<|>S,*\t") for _ in range(200)) for _ in range(60)]
    return [(d, t) for d, t, _ in awkward_rows] + [(1000 + i, t) for i, t in enumerate(SPECIAL + noise)]


def test_counts_equal_the_library(spark, texts):
    docs = frame_of(spark, [(d, t, "en") for d, t in texts])
    want = [(d, len((t or "").encode()), len(ids), len(ids) > 512) for (d, t), ids in zip(texts, library(BYTES, [t for _, t in texts]))]
    assert got(token_counts.token_counts(docs, BYTES)) == sorted(want, key=repr)


def test_counts_of_given_documents(given):
    rows = given.select("doc_id", "text").collect()
    want = {r.doc_id: len(ids) for r, ids in zip(rows, library(BYTES, [r.text for r in rows]))}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(given, BYTES).collect()} == want


def test_overlapping_equal_pairs_merge_from_the_left():
    import json

    merges = Merges(json.load(open(BYTES, encoding="utf-8")))
    runs = ["a" * n for n in range(1, 70)] + ["abab" * n for n in range(1, 20)]
    assert merges.texts(runs) == [len(i) for i in library(BYTES, runs)]


def pieces_of(frame):
    return [r.asDict() for r in frame.collect()]


def check_pieces(rows, want, capacity):
    """Each id in one piece, sequences gapless and full enough; want: sorted ids of all documents."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    return by_sequence


@pytest.mark.parametrize("capacity", [2048, 256])
def test_packing_holds_every_id_once(spark, texts, capacity):
    docs = frame_of(spark, [(d, t, "en") for d, t in texts])
    want = []
    for (d, _), ids in zip(texts, library(WORDS, [t for _, t in texts])):
        ids = np.array([*ids, 1], "<u4")
        for s in range(0, len(ids), capacity):
            part = ids[s : s + capacity]
            want.append((str(d), s, len(part), zlib.crc32(part.tobytes()), len(ids)))
    rows = pieces_of(packing.packed(docs, WORDS, capacity))
    by_sequence = check_pieces(rows, sorted(want), capacity)
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= tokens / capacity * 1.05 + 1


def test_matrices_round_trip(spark, texts):
    docs = frame_of(spark, [(d, t, "en") for d, t in texts])
    capacity, found = 256, defaultdict(list)
    for r in token_binary.packed_matrices(docs, WORDS, capacity).collect():
        ids, positions = np.frombuffer(bytes(r.ids), "<u2"), np.frombuffer(bytes(r.positions), "<u2")
        assert len(ids) == len(positions) == capacity and r.cu_seqlens[0] == 0
        assert not ids[r.cu_seqlens[-1] :].any()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            found[str(d)].append((s, ids[a:b].tolist()))
    want = defaultdict(list)
    for (d, _), ids in zip(texts, library(WORDS, [t for _, t in texts])):
        ids = [*ids, 1]
        want[str(d)] += [(s, ids[s : s + capacity]) for s in range(0, len(ids), capacity)]
    assert {d: sorted(p) for d, p in found.items()} == {d: sorted(p) for d, p in want.items()}


def test_written_matrices_read_back_as_rows_of_one_length(spark, tmp_path, texts):
    packed = token_binary.packed_matrices(frame_of(spark, [(d, t, "en") for d, t in texts]), WORDS, 512)
    token_binary.write_matrices(packed, f"{tmp_path}/ids")
    back = spark.read.parquet(f"{tmp_path}/ids")
    assert {len(r.ids) for r in back.collect()} == {1024}
    assert got(token_binary.matrix_digest(back)) == got(token_binary.matrix_digest(packed))


def test_empty_tables(nothing):
    assert token_counts.token_counts(nothing, BYTES).count() == 0
    assert packing.packed(nothing, WORDS).count() == 0
    assert token_binary.matrix_digest(token_binary.packed_matrices(nothing, WORDS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_fits_follow_their_rules(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 300)
    order = np.argsort(-sizes, kind="stable")
    first, best = [], []
    want_first, want_best = np.empty(300, int), np.empty(300, int)
    for i in order:
        b = next((k for k, used in enumerate(first) if used + sizes[i] <= 100), len(first))
        if b == len(first):
            first.append(0)
        first[b] += sizes[i]
        want_first[i] = b
        fits = [(100 - used, k) for k, used in enumerate(best) if used + sizes[i] <= 100]
        room = min(fits)[0] if fits else None
        want_best[i] = -1 if room is None else room
        k = len(best) if room is None else next(k for r, k in fits if r == room)
        if k == len(best):
            best.append(0)
        best[k] += sizes[i]
    assert first_fit_decreasing(sizes, 100)[0].tolist() == want_first.tolist()
    bins, offsets = best_fit_decreasing(sizes, 100)
    used = defaultdict(int)
    for i in order:
        rooms = [100 - u for u in used.values() if u + sizes[i] <= 100]
        if bins[i] in used:
            assert 100 - used[bins[i]] == min(rooms) and offsets[i] == used[bins[i]]
        else:
            assert not rooms
        used[bins[i]] += sizes[i]
    assert len(used) == len(best)
