"""Whitening, near copies of vectors and the audit of filters against plain Python."""

import math
import re
from itertools import permutations

import numpy as np
import pytest
from conftest import WHITE, frame_of, got

from statmosaic.llm import filter_audit, grid_join, spectral, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, cls int, tile long, mask int, links long"


def vectors(spark, rows, parts=3, schema=SCHEMA):
    """Embeddings with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, e, g, 1, "c", 2, 3, 4, 5) for i, e, g in rows], schema).repartition(parts)


def f32(a):
    return [float(x) for x in np.asarray(a, np.float32)]


@pytest.mark.parametrize("name", ["random", "identity", "zero", "one", "pair", "rank one", "blocks", "close pairs", "small"])
def test_leading_eigenpairs(name):
    rng = np.random.default_rng(1)
    m, r = rng.normal(size=(40, 40)), rng.normal(size=(30, 30))
    a = {"random": m @ m.T, "identity": np.eye(9), "zero": np.zeros((5, 5)), "one": np.array([[3.0]]), "pair": np.array([[2.0, 1], [1, 2]]),
         "rank one": np.ones((20, 20)), "blocks": np.kron(np.eye(6), np.array([[2.0, 1, 0], [1, 2, 1], [0, 1, 2]])),
         "close pairs": np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1), "small": 1e-30 * r @ r.T}[name]
    k = min(32, len(a))
    values, found = spectral.leading(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    size = max(np.abs(want).max(), 1e-7)
    assert np.abs(values - want).max() <= 1e-14 * size
    assert np.abs(a @ found - found * values).max() <= 1e-13 * size
    assert np.abs(found.T @ found - np.eye(k)).max() < 1e-12
    diagonal, off, _ = spectral.tridiagonal(a)
    middle = (want[:-1] + want[1:]) / 2
    clear = np.diff(-want) > 1e-9 * size
    below = spectral.counts_below(diagonal, off, middle)
    assert all(below[i] == len(a) - 1 - i for i in np.flatnonzero(clear))


def plain_whitening(rows, count):
    """Whole numbers, exact deviations and numpy's own eigenvectors."""
    kept = [(i, e) for i, e, _ in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in e] for _, e in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    away = np.array(x, float) - np.array(sums) / n
    values, found = np.linalg.eigh(away.T @ away / n)
    values, found = values[::-1][:count], found[:, ::-1][:, :count]
    real = values > 1e-9 * values[0]
    return kept, deviation, away @ found[:, real] / np.sqrt(values[real]), values[real] / np.trace(away.T @ away / n)


@pytest.fixture(scope="module")
def some_rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 40))
    rows = [(i, f32(rng.normal(size=40) + 4 * base[i % 3]), i % 4) for i in range(300)]
    rows += [(7, rows[7][1], 1)] * 2 + [(None, f32(rng.normal(size=40)), None)]
    return [*rows, (901, None, 1), (902, [], 1), (903, [None] * 40, 1), (904, f32([math.nan] * 40), 1), (905, [math.inf] + [0.0] * 39, 2)]


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening(spark, some_rows, parts):
    frame = vectors(spark, some_rows, parts)
    out = whitening.whitened(frame).collect()
    kept, deviation, white, explained = plain_whitening(some_rows, 32)
    assert len(out) == len(kept) * 32 and {r.n for r in out} == {len(kept)}
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    for k in range(32):
        rows = sorted(((r.vec_id, r.deviation, r.whitened, r.explained) for r in out if r.component == k + 1), key=lambda r: (str(r[0]), r[1]))
        want = sorted(zip((i for i, _ in kept), deviation, white[:, k], strict=True), key=lambda r: (str(r[0]), r[1]))
        assert [r[:2] for r in rows] == [r[:2] for r in want]
        sign = 1 if rows[0][2] * want[0][2] > 0 else -1
        assert max(abs(r[2] - sign * w[2]) for r, w in zip(rows, want, strict=True)) < 1e-8
        assert all(abs(r[3] - explained[k]) < 1e-12 for r in rows)


def test_whitening_of_few_or_equal_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(none).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1), (3, None, 1)])).count() == 0
    line = [(i, [float(i), 2.0 * i, 1.0], 1) for i in range(6)]
    out = whitening.whitened(vectors(spark, line)).collect()
    assert {r.component for r in out} == {1} and abs(sum(r.whitened**2 for r in out) / 6 - 1) < 1e-12 and abs(out[0].explained - 1) < 1e-12
    two = whitening.whitened(vectors(spark, [(i, [float(i % 3), float(i % 2), 0.25], 1) for i in range(12)])).collect()
    assert {r.component for r in two} == {1, 2} and len(two) == 24
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(vectors(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]))
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(vectors(spark, [(1, [1e30, 1.0], 1)]))


def plain_near(rows, threshold):
    """Every pair of one label compared; groups by search."""
    ok = [g is not None and bool(e) and all(c is not None and math.isfinite(c) for c in e) and any(e) for _, e, g in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2]:
                v, w = np.array(rows[a][1], float), np.array(rows[b][1], float)
                v, w = v / np.abs(v).max(), w / np.abs(w).max()
                if v @ w / math.sqrt(v @ v) / math.sqrt(w @ w) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        smallest = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), smallest, rows[a][0] == smallest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def near_rows():
    """Chains, tight and loose clusters, copies, multiples, opposite vectors, cells' edges and unusable rows."""
    rng = np.random.default_rng(5)
    rows = [(i, f32(rng.normal(size=8)), i % 2) for i in range(120)]
    centre = rng.normal(size=8)
    rows += [(200 + i, f32(centre + 0.01 * rng.normal(size=8)), 1) for i in range(90)]
    rows += [(300 + i, f32(centre + 0.35 * rng.normal(size=8)), 1) for i in range(60)]
    chain = [[math.cos(0.3 * i), math.sin(0.3 * i)] + [0.0] * 6 for i in range(12)]
    rows += [(499 - i, f32(c), 3) for i, c in enumerate(chain)]
    rows += [(500 + i, rows[3][1], 1) for i in range(20)] + [(540, rows[3][1], 0), (541, f32(3 * np.array(rows[3][1])), 1), (542, f32(-np.array(rows[3][1])), 1)]
    rows += [(None, rows[3][1], 1), (None, [9.0, -9.0, 9.0] + [0.0] * 5, 1), (550, [-0.0] * 8, 1), (551, [0.0] * 8, 1), (552, None, 1), (553, [], 1)]
    rows += [(554, [math.nan] + [1.0] * 7, 1), (555, rows[3][1], None), (556, [None] + [1.0] * 7, 1), (3, rows[3][1], 1), (557, [1e-30] * 8, 1), (558, [1e30] * 8, 1), (558, [1e30] * 8, 1)]
    return rows


@pytest.mark.parametrize("tile,leaf,parts", [(8192, 256, 1), (16, 4, 6)])
def test_near_copies(spark, near_rows, tile, leaf, parts, monkeypatch):
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    for threshold in (0.93, 0.6):
        assert got(grid_join.near_copies(vectors(spark, near_rows, parts), threshold, tile)) == plain_near(near_rows, threshold)


def test_near_copies_of_doubles_and_of_nothing(spark, near_rows):
    doubles = vectors(spark, near_rows, schema=SCHEMA.replace("float", "double"))
    assert got(grid_join.near_copies(doubles)) == plain_near(near_rows, 0.93)
    assert got(grid_join.near_copies(spark.createDataFrame([], SCHEMA))) == []
    assert got(grid_join.near_copies(vectors(spark, [(1, None, 1), (2, [1.0], None), (None, [0.0], 1)]))) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    with pytest.raises(ValueError, match="different lengths"):
        grid_join.near_copies(vectors(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]))


def test_tiles_too_far_apart_do_not_meet(spark, monkeypatch):
    """Tiles of clusters in opposite directions form no pair, and parts within one ball are counted without comparing."""
    rng = np.random.default_rng(9)
    rows = [(k * 1000 + i, f32(np.eye(6)[k] + 0.01 * rng.normal(size=6)), 1) for k in range(6) for i in range(64)]
    seen, whole = [], grid_join.near_tiles
    monkeypatch.setattr(grid_join, "LEAF", 32)
    monkeypatch.setattr(grid_join, "near_tiles", lambda tiles, eps: seen.append((tiles.select("tile").distinct().count(), whole(tiles, eps))) or seen[-1][1])
    assert {r.n_links for r in grid_join.near_copies(vectors(spark, rows, 1), tile=32).collect()} == {63}
    tiles, pairs = seen[0]
    assert pairs.count() < tiles * (tiles + 1) / 2
    unit = np.array([r[1] for r in rows[:64]])
    monkeypatch.setattr(grid_join.TileJoin, "compared", None)  # never called: the whole cluster is one ball
    joined = grid_join.TileJoin(unit, unit, np.ones(64, np.int64), 64, 0.93)
    assert set(joined.links.tolist()) == {63} and set(joined.root.tolist()) == {0}


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, s in rows:
        t = t or ""
        w = WHITE.findall(t)
        fails.append((s or "", d, {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                   "D": re.search(r"[#$%&*|]", t) is not None, "E": d is not None and first[t] < d}))
    out = []
    for part in {p for p, _, _ in fails}:
        mine, own = [(d, f) for p, d, f in fails if p == part], []
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                alive = [(d, f) for d, f in mine if not any(f[x] for x in order[:step])]
                gone = [d for d, f in alive if f[name]]
                own.append(("".join(order), step + 1, len(alive) - len(gone), len(gone), sum(f[name] for _, f in mine) - len(gone),
                            sum(f[name] and sum(f.values()) == 1 for _, f in mine), sum(d in good for d in gone), sum(d in toxic for d in gone)))
        total = {x: sum(r[3] for r in own if r[0][r[1] - 1] == x) for x in "ABCDE"}
        out += [(part, *r, total[r[0][r[1] - 1]]) for r in own]
    return sorted(out, key=repr)


def test_filter_audit(spark, awkward_rows, nothing):
    shared = "Price $5 " * 30
    rows = [(d, t, g) for d, t, g in awkward_rows] + [(800, shared, "en"), (801, shared, None), (801, shared, ""), (None, shared, "en"), (802, "PLAIN " * 60, "x|y")]
    frame = frame_of(spark, rows).drop("source").withColumnRenamed("lang", "source").withColumnsRenamed({"bucket": "mask", "key": "part", "hits": "first", "label": "good"})
    labels = [(1, 1, 0), (8, 1, 1), (9, 0, 1), (15, None, 1), (15, 1, None), (801, 1, 1), (801, 0, 0), (None, 1, 1), (4, 1, 1), (999, 1, 1)]
    marks = spark.createDataFrame([(*x, "part", 1) for x in labels], "doc_id long, quality int, toxic int, part string, mask int")
    assert got(filter_audit.filter_audit(frame, marks)) == plain_audit(rows, labels)
    assert filter_audit.filter_audit(nothing, marks).count() == 0
    assert len(got(filter_audit.filter_audit(frame, marks.limit(0)))) == 600 * len({g or "" for _, _, g in rows})


def test_wide_counters_do_not_overflow():
    many = (1 << 62) - 1
    total = many * filter_audit.wide(31 | 96) + 5 * filter_audit.wide(0)
    fields = filter_audit.unpacked(total)
    assert np.array_equal(fields, many * filter_audit.outcomes(127).astype(np.int64) + 5 * filter_audit.outcomes(0).astype(np.int64))
    assert len(filter_audit.STEPS) == 600
