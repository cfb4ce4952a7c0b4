"""Lines, repeats, similar groups and benchmark windows against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import FOLD, frame_of, got, words

from statmosaic.llm import components, decontaminate, jaccard_join, line_dedup, substring_dedup
from statmosaic.llm.words import U, WHITE, words as coded_words

BLANKS = " \t\n\x0b\x0c\r"


def plain_lines(rows, min_docs, min_chars, keep_first=False):
    """Kept text of every row; rows equal in id and text are one document."""
    where = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(FOLD)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add((d, t))
    bad = {k for k, docs in where.items() if len(docs) >= min_docs}
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (2, 20)])
def test_shared_lines_leave(awkward, awkward_rows, min_docs, min_chars):
    frame = line_dedup.drop_shared_lines(awkward, min_docs, min_chars)
    assert frame.columns == [*awkward.columns, "kept_text", "n_lines", "n_dropped"]
    assert got(frame.select("doc_id", "kept_text", "n_lines", "n_dropped")) == plain_lines(awkward_rows, min_docs, min_chars)


def test_first_occurrence_can_stay(spark):
    rows = [(i, f"own {i}\nshared\n shared \nshared", "en") for i in range(80)]
    kept = {r.doc_id: r.kept_text for r in line_dedup.drop_shared_lines(frame_of(spark, rows), 10, 1, keep_first=True).collect()}
    assert kept[0] == "own 0\nshared" and all(kept[i] == f"own {i}" for i in range(1, 80))


def test_bitmaps_hold_dropped_lines_only(spark):
    rows = [(i, "\n".join(["x"] * (70 if i == 0 else 1) + [f"own {i}"]), "en") for i in range(3)]
    maps = {r.doc_id: r.drops for r in line_dedup.drop_bitmaps(frame_of(spark, rows), 2).collect()}
    assert maps == {0: {0: -1, 1: 63}, 1: {0: 1}, 2: {0: 1}}


def test_line_plan_is_native(awkward):
    plan = line_dedup.drop_shared_lines(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_repeats(rows, width):
    starts = Counter(tuple(w[i : i + width]) for _, t, _ in rows for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for d, t, _ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if starts[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [35, 6, 2])
def test_repeats_leave(awkward, awkward_rows, width):
    assert got(substring_dedup.remove_repeats(awkward, width)) == plain_repeats(awkward_rows, width)


def test_repeats_across_buckets(spark, awkward_rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(substring_dedup, "HELD", 900)
    assert got(substring_dedup.remove_repeats(frame_of(spark, awkward_rows, 7), 10)) == plain_repeats(awkward_rows, 10)


def plain_sets(text, width):
    w = [x.translate(FOLD) for x in words(text)]
    if len(w) < width:
        return frozenset({tuple(w)} if w else ())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def plain_groups(rows, width, percent):
    sets = [plain_sets(t, width) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_similar_groups(awkward, awkward_rows, percent):
    assert got(jaccard_join.similar_groups(awkward, 3, percent)) == plain_groups(awkward_rows, 3, percent)


def test_similar_groups_in_tiles(spark, awkward_rows, monkeypatch):
    """Clusters cut into tiles and many buckets give what one task gives."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = list(awkward_rows)
    for i in range(120):
        own = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            own[k] = f"c{rng.integers(3)}"
        rows.append((500 + i, " ".join(own[: int(rng.integers(100, 121))]), "en"))
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 50_000)
    monkeypatch.setattr(jaccard_join, "HELD", 500)
    assert got(jaccard_join.similar_groups(frame_of(spark, rows, 6))) == plain_groups(rows, 3, 90)


SHORT = [(1, None, "en"), (2, "", "en"), (3, " \n", "en"), (4, "one", "en"), (5, "One", "en"), (6, "a b c d e f g h i j", "en"), (7, "a b c d e f g h i J", "en"), (8, "a b c", "en"), (None, None, "en"), (None, "one", "en")]


@pytest.mark.parametrize("percent", [90, 80])
@pytest.mark.parametrize("parts", [1, 5])
def test_tasks_of_short_texts_only(spark, percent, parts):
    """No set has parts: a whole table of such texts, and one such row in a task of its own."""
    assert got(jaccard_join.similar_groups(frame_of(spark, SHORT, parts), 3, percent)) == plain_groups(SHORT, 3, percent)
    assert got(jaccard_join.similar_groups(frame_of(spark, SHORT[:1], 1), 3, percent)) == plain_groups(SHORT[:1], 3, percent)


def test_tail_of_short_texts_after_a_flush(spark, awkward_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", 1)
    monkeypatch.setattr("statmosaic.llm.tables.BATCH_ROWS", 1)
    rows = [r for r in awkward_rows if r[0] in (8, 9, 15)] + [(d and d + 900, t, g) for d, t, g in SHORT]
    in_order = frame_of(spark, rows, 1).sortWithinPartitions("doc_id")
    assert got(jaccard_join.similar_groups(in_order)) == plain_groups(rows, 3, 90)


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_a_part(percent):
    """Sets at and above the threshold always meet, whatever lies in one of them only."""
    rng = np.random.default_rng(percent)
    lows = jaccard_join.size_bands(percent)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(U))
        most = (100 - percent) * 2 * len(a) // (100 + percent)
        drop, add = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[min(drop, len(a) - 1) :], rng.integers(0, 1 << 63, add).astype(U))))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or (len(a) == len(b) == both):
            continue
        owner, digest = jaccard_join.part_digests([a, b], percent, lows)
        assert set(digest[owner == 0].tolist()) & set(digest[owner == 1].tolist())


def test_components_follow_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)] + [(300, 300 + k) for k in range(1, 40)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100, **{300 + k: 300 for k in range(40)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(rows, items, width):
    cut = lambda t: ITEM_WORD.findall((t or "").translate(FOLD))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(i)
    out = []
    for d, t, _ in rows:
        w, hit, names = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(awkward_rows):
    by_id = {d: t for d, t, _ in awkward_rows}
    passage = by_id[14].split("\n")[0]
    return [(1, passage), (10, passage.upper()), (2, "one"), (3, None), (4, "  !! "), (5, " ".join(by_id[8].split()[500:540])), (5, by_id[15][:90]), (None, by_id[16] or "a b c"), (7, "a b c a b c a b c a b c a")]


@pytest.mark.parametrize("width", [13, 3, 27])
def test_contamination(spark, awkward, awkward_rows, items, width):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(awkward, bench, width)) == plain_contamination(awkward_rows, items, width)
    clean = decontaminate.clean_documents(awkward, bench, width)
    bad = Counter((r[0], r[1]) for r in plain_contamination(awkward_rows, items, width) if not r[5])
    assert clean.columns == awkward.columns
    assert Counter((r.doc_id, len(ITEM_WORD.findall((r.text or "").translate(FOLD)))) for r in clean.collect()) == bad


def test_windows_longer_than_the_sorted_depth_are_refused():
    with pytest.raises(ValueError, match="1 to 27"):
        decontaminate.TestSet(["1"], ["a b c"], 28)


def test_contamination_in_blocks(spark, awkward, awkward_rows, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.contamination(awkward, bench)) == plain_contamination(awkward_rows, items, 13)
    kept = decontaminate.clean_documents(awkward, bench).count()
    assert kept == sum(not r[5] for r in plain_contamination(awkward_rows, items, 13))


@pytest.mark.parametrize("block_bytes", [32 << 20, 20])
def test_rows_are_judged_for_themselves_whatever_the_blocks(spark, items, monkeypatch, block_bytes):
    """Rows without doc_id, or with the doc_id of a contaminated row, stay when they are clean."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    passage = items[0][1]
    rows = [(None, passage, "en"), (None, "nothing of it", "en"), (None, None, "en"), (1, passage, "en"), (1, "clean row of one id", "en"), (1, "clean row of one id", "en"), (2, "two more", "fr"), (3, passage, "en")]
    frame = frame_of(spark, rows)
    bench = spark.createDataFrame([(i, t) for i, t in items if i in (1, 10, 7)], "item_id long, text string")
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert got(clean.select("doc_id", "text", "lang")) == sorted((r for r in rows if r[1] != passage), key=repr)


def test_blocks_are_read_one_at_a_time(spark, items, awkward, awkward_rows, monkeypatch):
    """A text repeated very often is one item for each id, dealt over blocks; the first pass is written before the next block is read."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    order, whole = [], decontaminate.materialize
    monkeypatch.setattr(decontaminate, "materialize", lambda df, name: order.append(name) or whole(df, name))
    seen = decontaminate.TestSet.__init__

    def init(self, ids, texts, width):
        order.append(sum(len((t or "").encode()) for t in texts))
        seen(self, ids, texts, width)

    monkeypatch.setattr(decontaminate.TestSet, "__init__", init)
    text = items[0][1]
    many = [(1000 + i % 10, text) for i in range(100)]
    bench = spark.createDataFrame(many, "item_id long, text string")
    assert got(decontaminate.contamination(awkward, bench)) == plain_contamination(awkward_rows, many, 13)
    sizes = [x for x in order if isinstance(x, int)]
    assert sum(sizes) == 10 * len(text.encode()) and len(sizes) == sum(sizes) // 2000 + 1 and max(sizes) < sum(sizes)
    at = [i for i, x in enumerate(order) if isinstance(x, int)]
    assert all(order[i + 1].startswith("marks-") for i in at)


def test_long_documents_are_cut_with_an_overlap(spark, items, awkward_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "_PACK", 10)
    rows = [r for r in awkward_rows if r[0] in (8, 9, 10, 13, 14)]
    from statmosaic.llm.decontaminate import TestSet, _found, _judged
    import pyarrow as pa

    test = TestSet([None if i is None else str(i) for i, _ in items], [t for _, t in items], 13)
    n, hits, names = _found(pa.array([t for _, t, _ in rows]), test)
    verdict = _judged(n.tolist(), [[h] for h in hits], names)
    assert sorted(zip([d for d, _, _ in rows], *(c.to_pylist() for c in verdict.values())), key=repr) == plain_contamination(rows, items, 13)


def test_longest_matches_are_maximal(spark):
    docs = frame_of(spark, [(1, "zero " + " ".join(f"w{k}" for k in range(40)) + " end", "en"), (2, "nothing here", "en")])
    bench = spark.createDataFrame([(9, " ".join(f"w{k}" for k in range(5, 30)))], "item_id long, text string")
    assert got(decontaminate.longest_matches(docs, bench)) == [(1, "9", 6, 0, 25)]


def test_empty_tables(spark, nothing, awkward):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.drop_shared_lines(nothing).count() == 0
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert jaccard_join.similar_groups(nothing).count() == 0
    assert decontaminate.contamination(nothing, no_items).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(awkward, no_items).collect()} == {0}
    assert decontaminate.clean_documents(awkward, no_items).count() == awkward.count()


def test_word_codes_tell_words_apart(awkward_rows):
    import pyarrow as pa

    texts = [t for _, t, _ in awkward_rows]
    found = coded_words(pa.array(texts), WHITE)
    plain = [w for t in texts for w in words(t)]
    assert len(plain) == len(found.code)
    by_code = defaultdict(set)
    for c, w in zip(found.code.tolist(), plain):
        by_code[c].add(w)
    assert all(len(v) == 1 for v in by_code.values()) and len(by_code) == len(set(plain))


def plain_matches(text, item, width):
    """Maximal verbatim matches (document word, item word, length) by comparing every pair of places."""
    w, v = (ITEM_WORD.findall(t.translate(FOLD)) for t in (text, item))
    out = set()
    for i in range(len(w)):
        for j in range(len(v)):
            if w[i] == v[j] and (i == 0 or j == 0 or w[i - 1] != v[j - 1]):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n >= min(width, len(v)):
                    out.add((i, j, n))
    return out


@pytest.mark.parametrize("width", [1, 3, 13])
@pytest.mark.parametrize("block_bytes", [32 << 20, 40])
def test_longest_matches_by_brute_force(spark, monkeypatch, width, block_bytes):
    """Repeats within a text and an item, matches at both ends, neighbours that match across the border of two texts."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(width)
    texts = [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(4)] + ["x a b", "a b a", "", "q " * 30]
    tests = [" ".join(rng.choice("ab") for _ in range(40)), "a b", texts[0][10:70], "q " * 20, "none of it"]
    docs, bench = frame_of(spark, [(i, t, "en") for i, t in enumerate(texts)], 1), spark.createDataFrame(list(enumerate(tests)), "item_id long, text string")
    found = Counter((r.doc_id, int(r.item_id), r.doc_word, r.item_word, r.length) for r in decontaminate.longest_matches(docs, bench, width).collect())
    assert found == Counter((d, i, *m) for d, t in enumerate(texts) for i, v in enumerate(tests) for m in plain_matches(t, v, width))
