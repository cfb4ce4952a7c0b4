"""Near copies among embeddings of one label: an epsilon grid order join.

Unit vectors u, w have a cosine of at least t when |u - w|^2 <= 2 - 2t = eps^2, and no projection makes a distance longer.
Vectors are sorted by label and by the cells, eps wide, of their leading principal coordinates; the sorted
sequence is cut into tiles.  Intervals of tiles are joined level by level, each pair of intervals by its
children, and a pair whose boxes are further apart than eps goes no further.  What is left, pairs of tiles, is joined inside
tasks by halving both tiles: parts whose boxes or balls are too far apart are skipped, parts that lie in one ball of
diameter eps are counted whole, and only the rest is compared, by cosine in double precision.

Equal vectors of one label are one class, so copies never meet as pairs.  A task sends one row for each class that
it linked: how many vectors it linked, and one link to the representative of what it joined; pairs are never sent.

Defined cases: a null, empty or zero vector, one with a null or an entry that is not finite, and one without a label link with
nothing; rows without vec_id are compared like others but name no component unless it has no named row, and
``kept`` compares null-safely; rows that repeat a vec_id are rows each; an empty table gives an empty result; vectors of
different lengths are refused; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .spectral import centred_products, leading, matrix_of

THRESHOLD = 0.93
LEADING = 6
# A tile is TILE vectors, or fewer if they have more than TILE_BYTES as doubles.
TILE, TILE_BYTES = 8192, 32 << 20
LEAF = 256
FAN = 3  # each interval has 2^FAN children
# Bounds on distances leave this much for rounding; cosines this close to the threshold are computed again.
SLACK, CLOSE = 1e-9, 1e-12
_AXES = [f"p{k}" for k in range(LEADING)]


def unit_rows(entries: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by way of their largest entry."""
    top = np.abs(entries).max(1, keepdims=True, initial=0.0)
    scaled = entries / np.where(top > 0, top, 1.0)
    size = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return scaled / np.where(size > 0, size, 1.0)


def _decoded(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), d)


def readable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vec (doubles as bytes; null where the row can link with nothing)."""
    kinds = dict(embeddings.dtypes)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, entries = matrix_of(batch.column("embedding"))
            entries = entries + 0.0  # no negative zeros
            used = whole & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
            vec = np.full(batch.num_rows, None, object)
            for row, entry in zip(np.flatnonzero(whole).tolist(), entries, strict=True):
                if used[row] and entry.any():
                    vec[row] = entry.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vec, pa.binary())], names=["vec_id", "label", "vec"])

    rows = embeddings.select("vec_id", "label", "embedding").mapInArrow(step, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary")
    return rows.withColumns({"h1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "h2": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(1), "vec"))})


def principal_axes(classes: DataFrame, d: int) -> np.ndarray:
    """The leading principal directions of the unit vectors, as columns."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1)
        for batch in batches:
            total += np.append(unit_rows(_decoded(batch.column("vec"), d)).sum(0), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(total)], names=["i", "value"])

    total = np.zeros(d + 1)
    for r in classes.select("vec").mapInArrow(sums, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():
        total[r["i"]] = r["value"]
    n = max(total[-1], 1.0)
    products = centred_products(classes.select("vec"), lambda batch: unit_rows(_decoded(batch.column("vec"), d)), total[:-1] / n)
    return leading(products / n, LEADING)[1]


def grid_cells(p: np.ndarray, eps: float) -> np.ndarray:
    """Cells of leading coordinates, ``eps`` wide, and after them finer ones that order what shares a cell."""
    return np.floor(np.concatenate((p / eps, p * 8 / eps), axis=1)).astype(np.int64)


def grid_order(classes: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """Classes with their leading coordinates and ``cells``: bytes that sort like the grid cells, finer cells last."""
    d, used = axes.shape
    kind = dict(classes.dtypes)["label"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, LEADING))
            p[:, :used] = unit_rows(_decoded(batch.column("vec"), d)) @ axes
            cells = (grid_cells(p, eps) + (1 << 31)).astype(">u4")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "cls", "copies", "vec")), *(pa.array(p[:, k]) for k in range(LEADING)), pa.array([c.tobytes() for c in cells], pa.binary())],
                names=["label", "cls", "copies", "vec", *_AXES, "cells"])

    return classes.select("label", "cls", "copies", "vec").mapInArrow(
        step, f"label {kind}, cls long, copies long, vec binary, {', '.join(f'{a} double' for a in _AXES)}, cells binary")


def tiled(ordered: DataFrame, parts: int, size: int) -> DataFrame:
    """The sequence cut into tiles of one label; tile numbers rise along it."""
    placed = ordered.repartitionByRange(parts, "label", "cells", "cls").sortWithinPartitions("label", "cells", "cls")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, filled, current = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for batch in batches:
            numbers = np.empty(batch.num_rows, np.int64)
            for i, label in enumerate(batch.column("label").to_pylist()):
                if label != current or filled == size:
                    tile, filled, current = tile + 1, 0, label
                filled += 1
                numbers[i] = tile
            yield batch.drop_columns(["cells"]).append_column("tile", pa.array(numbers))

    schema = ", ".join(f"{c} {k}" for c, k in placed.dtypes if c != "cells") + ", tile long"
    return placed.mapInArrow(step, schema)


def near_tiles(tiles: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles of one label that may hold vectors within ``eps``, by recursion over intervals."""
    box = [f(a).alias(f"{n}{a}") for a in _AXES for n, f in (("low_", F.min), ("high_", F.max))]
    leaves = materialize(tiles.groupBy("label", "tile").agg(*box).withColumn(
        "at", F.row_number().over(Window.partitionBy("label").orderBy("tile")).cast("long") - 1), "tiles")
    last = leaves.agg(F.max("at")).first()[0] or 0
    level = max(-(-int(last).bit_length() // FAN), 0)
    pairs = leaves.select("label").distinct().withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})

    def boxes(lv: int, side: str) -> DataFrame:
        own = [f(f"{n}{x}").alias(f"{side}_{n}{x}") for x in _AXES for n, f in (("low_", F.min), ("high_", F.max))]
        return leaves.withColumn(side, F.shiftright("at", FAN * lv)).groupBy("label", side).agg(*own)

    def children(side: str) -> Column:
        return F.sequence(F.col(side) * (1 << FAN), F.col(side) * (1 << FAN) + (1 << FAN) - 1)

    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_low_{x}") - F.col(f"b_high_{x}"), F.col(f"b_low_{x}") - F.col(f"a_high_{x}")), F.lit(2)) for x in _AXES), F.lit(0.0))
    for lv in range(level - 1, -1, -1):
        below = pairs.select("label", F.explode(children("a")).alias("a"), "b")
        below = below.select("label", "a", F.explode(children("b")).alias("b")).where("a <= b")
        near = below.join(boxes(lv, "a"), ["label", "a"]).join(boxes(lv, "b"), ["label", "b"]).where(gap <= (eps + SLACK) ** 2)
        pairs = materialize(near.select("label", "a", "b"), "near-intervals")
    names = leaves.select("label", "at", "tile")
    return pairs.join(names.toDF("label", "a", "tile_a"), ["label", "a"]).join(names.toDF("label", "b", "tile_b"), ["label", "b"]).select("tile_a", "tile_b")


class Interval:
    """A part of a tile's sequence: its box on the leading axes and the ball around its mean."""

    def __init__(self, unit: np.ndarray, axes: np.ndarray, low: int, high: int) -> None:
        self.low, self.high = low, high
        part, p = unit[low:high], axes[low:high]
        self.box = p.min(0), p.max(0)
        self.centre = part.mean(0)
        self.radius = float(np.sqrt(((part - self.centre) ** 2).sum(1).max()))
        middle = (low + high) // 2
        self.halves = (Interval(unit, axes, low, middle), Interval(unit, axes, middle, high)) if high - low > LEAF else ()

    def apart(self, other: Interval) -> tuple[float, float]:
        """The least and the largest distance that vectors of the two parts can have."""
        between = float(np.linalg.norm(self.centre - other.centre))
        gap = np.maximum(0.0, np.maximum(self.box[0] - other.box[1], other.box[0] - self.box[1]))
        both = self.radius + other.radius
        return max(float(np.linalg.norm(gap)), between - both), between + both


class TileJoin:
    """Links between the classes of one tile, or of two: linked vectors counted for each class, and what they connect."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray, copies: np.ndarray, first: int, threshold: float) -> None:
        """The first ``first`` classes are one tile and the others the second, if there are others."""
        self.vectors, self.unit, self.copies, self.threshold = vectors, unit_rows(vectors), copies, threshold
        self.eps = float(np.sqrt(2 - 2 * threshold))
        self.links, self.root = np.zeros(len(copies), np.int64), np.arange(len(copies))
        one = Interval(self.unit, axes, 0, first)
        self.join(one, Interval(self.unit, axes, first, len(copies)) if first < len(copies) else one)

    def join(self, a: Interval, b: Interval) -> None:
        least, most = a.apart(b)
        if least > self.eps + SLACK:
            return
        if most < self.eps - SLACK:
            self.linked_whole(a, b)
        elif a is b and a.halves:
            self.join(a.halves[0], a.halves[0])
            self.join(a.halves[0], a.halves[1])
            self.join(a.halves[1], a.halves[1])
        elif a.halves and a.high - a.low >= b.high - b.low:
            for half in a.halves:
                self.join(half, b)
        elif b.halves:
            for half in b.halves:
                self.join(a, half)
        else:
            self.compared(a, b)

    def linked_whole(self, a: Interval, b: Interval) -> None:
        """Every vector of one part is linked to every one of the other."""
        for x, y in ((a, b),) if a is b else ((a, b), (b, a)):
            self.links[x.low : x.high] += self.copies[y.low : y.high].sum()
        if a is b:
            self.links[a.low : a.high] -= self.copies[a.low : a.high]
        members = np.concatenate((np.arange(a.low, a.high), np.arange(b.low, b.high)))
        self.connect(members[:-1], members[1:])

    def compared(self, a: Interval, b: Interval) -> None:
        cosine = self.unit[a.low : a.high] @ self.unit[b.low : b.high].T
        for i, j in np.argwhere(np.abs(cosine - self.threshold) < CLOSE).tolist():
            v, w = self.vectors[a.low + i], self.vectors[b.low + j]
            cosine[i, j] = (v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w))
        hit = cosine >= self.threshold
        if a is b:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.links[a.low : a.high] += hit @ self.copies[b.low : b.high]
        if a is not b:
            self.links[b.low : b.high] += hit.T @ self.copies[a.low : a.high]
        i, j = np.nonzero(hit)
        self.connect(i + a.low, j + b.low)

    def connect(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the components of linked classes; ``root`` is flat before and after."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            parent = np.arange(len(self.root))
            np.minimum.at(parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
            self.root = parent[self.root]


def tile_links(tiles: DataFrame, pairs: DataFrame, d: int, threshold: float) -> DataFrame:
    """cls, links, root: what every pair of tiles links."""
    eps = float(np.sqrt(2 - 2 * threshold))
    sides = pairs.select(F.col("tile_a").alias("tile"), "tile_a", "tile_b").union(pairs.where("tile_a < tile_b").select("tile_b", "tile_a", "tile_b"))
    dealt = tiles.drop("label").join(sides, "tile")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("tile", "ascending"), ("cls", "ascending")])
        first = int((group["tile"].to_numpy() == group["tile_a"].to_numpy()).sum())
        cls = group["cls"].to_numpy()
        axes = np.stack([group[a].to_numpy() for a in _AXES], axis=1)
        # the order of the sequence, which the shuffle has lost
        order = np.lexsort((*grid_cells(axes, eps).T[::-1], np.arange(len(cls)) >= first))
        joined = TileJoin(_decoded(group["vec"], d)[order], axes[order], group["copies"].to_numpy()[order], first, threshold)
        some = np.flatnonzero(joined.links)
        return pa.table({"cls": cls[order][some], "links": joined.links[some], "root": cls[order][joined.root[some]]})

    return dealt.groupBy("tile_a", "tile_b").applyInArrow(run, "cls long, links long, root long")


def near_copies(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold is a cosine between 0 and 1")
    rows = materialize(readable(embeddings), "vectors")
    grouped = rows.where("vec IS NOT NULL").groupBy("label", "vec", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    classes = materialize(grouped.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    seen = classes.agg(F.count(F.lit(1)).alias("n"), F.min(F.octet_length("vec")).alias("least"), F.max(F.octet_length("vec")).alias("most")).first()
    if seen["least"] != seen["most"]:
        raise ValueError("vectors of different lengths")
    unlinked = F.lit(0).cast("long")
    if not seen["n"]:
        return rows.select("vec_id", unlinked.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    d, eps = seen["most"] // 8, float(np.sqrt(2 - 2 * threshold))
    size = max(min(tile, TILE_BYTES // seen["most"]), LEAF)
    ordered = grid_order(classes, principal_axes(classes, d), eps)
    tiles = materialize(tiled(ordered, seen["n"] // size + 1, size), "tiled-vectors")
    found = materialize(tile_links(tiles, near_tiles(tiles, eps), d, threshold), "tile-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "near-vectors").toDF("cls", "of")
    named = classes.drop("vec").join(links, "cls", "left").join(labels, "cls", "left").withColumn("of", F.coalesce("of", "cls"))
    smallest = named.groupBy("of").agg(F.min("first").alias("component_id"))
    result = named.join(smallest, "of").select("label", "h1", "h2", (F.coalesce("links", unlinked) + F.col("copies") - 1).alias("n_links"), "component_id")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.drop("vec").join(result, ["label", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", unlinked).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
