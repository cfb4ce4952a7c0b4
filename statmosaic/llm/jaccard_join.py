"""Documents whose sets of word shingles overlap by a Jaccard similarity, and the groups they form.

Sets that are equal are one class (a 64-bit digest of the set).  For classes of similar size the
similarity bounds the number of shingles that lie in one set only; with one part more than that bound, two
linked sets agree wholly on some part of the hash range.  So every class sends the digests of its parts,
per size band, and classes that share one form a cluster: no link leads out of a cluster.  A task first
chains classes that meet inside it and sends one of them per part, so common parts cost a row per task.

A cluster is compared in tiles: at most ``TILE`` classes of one size band (and of bounded bytes), and pairs of tiles
whose bands can hold a link.  Within a tile pair hashed bitmaps come first: each bit set on one side alone is
a shingle that the other lacks, which bounds the overlap from above.  What passes, and is not yet
joined, is decided by exact intersection of the sorted arrays.  Only the joining links leave the task.

Defined cases: a text without words, or null, has no shingle and is alone; one or two words are one
shingle; equal texts and repeated rows are one class; a row without doc_id takes part but names no component
(alone it gets a null one); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, salted_join
from .components import components
from .tables import blobs, map_batches, small_batches, steps, text_bytes
from .words import U, WHITE, chained, mix, spread, words

WIDTH = 3
PERCENT = 90
TILE = 1024
TILE_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
HELD = 1_500_000
BLOOM_BITS = 1 << 26
_PART = np.dtype([("part", "<u8"), ("cls", "<i8")])


def size_bands(percent: int) -> np.ndarray:
    """Least size of each band; a link leads to the same band or the next."""
    ratio = max(1.25, 100 / percent)
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * ratio))))
    return np.array(lows)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = words(texts, WHITE, fold=True)
    firsts, code = found.firsts(), chained(found.code, width)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(code[a : b - width + 1]))
        elif b > a:
            out.append(chained(found.code[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def set_digest(values: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.array([np.sum(mix(values, 11), dtype=U) + U(len(values)) * U(0xC2B2AE3D27D4EB4F)])
    return int(mix(total, 12).astype(np.int64)[0])


def part_digests(sets: list[np.ndarray], percent: int, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, digest) of the parts that sets of the same or the next size band compare."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, U)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    with np.errstate(over="ignore"):
        run = np.concatenate((np.zeros(1, U), np.cumsum(mix(values, 5), dtype=U)))
    band = np.searchsorted(lows, sizes, side="right") - 1
    top = np.searchsorted(lows, sizes * 100 // percent, side="right") - 1
    out_set, out_digest = [], []
    for shift in (0, 1):
        use = np.flatnonzero((sizes > 0) & (top >= band + shift))
        largest = lows[band[use] + shift + 1] - 1
        apart = 2 * largest * (100 - percent) // (100 + percent)  # shingles that may lie in one set only
        use, largest, apart = use[apart > 0], largest[apart > 0], apart[apart > 0]  # else linked sets are equal
        if not len(use):
            continue
        slack = apart // 6
        parts = apart + 1 + slack
        first_part = np.concatenate(([0], np.cumsum(parts)))
        rank = np.full(len(sets), -1)
        rank[use] = np.arange(len(use))
        mine = rank[owner] >= 0
        r = rank[owner[mine]]
        part = first_part[r] + (((values[mine] >> U(32)) * parts[r].astype(U)) >> U(32)).astype(np.int64)
        counts = np.bincount(part, minlength=first_part[-1])
        # a set's values are in order, so each part is a run of them
        size_use = sizes[use]
        value_first = np.concatenate(([0], np.cumsum(sizes)))[use]
        inside = np.cumsum(counts)
        ends = np.repeat(value_first - np.concatenate(([0], np.cumsum(size_use)))[:-1], parts) + inside
        digest = run[ends] - run[ends - counts]
        set_of = np.repeat(np.arange(len(use)), parts)
        number = np.arange(first_part[-1]) - first_part[set_of]
        digest = mix(digest ^ mix(number.astype(U) + ((band[use] + shift)[set_of].astype(U) << U(32)), 6), 7)
        # linked sets agree on slack + 1 parts at least, so a set with few small parts may leave those out
        small = counts <= 1
        spare = np.bincount(set_of[small], minlength=len(use)) <= slack
        keep = ~small | ~spare[set_of]
        out_set.append(use[set_of[keep]])
        out_digest.append(digest[keep])
    if not out_set:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(out_set), np.concatenate(out_digest)


def classes_and_chains(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """Rows of two kinds: documents (doc_id, n, cls) and chains (a, b) between classes that share a part."""
    lows = size_bands(percent)
    small_batches(docs.sparkSession)
    names = ["bucket", "doc_id", "n", "cls", "other", "parts"]

    def rows(many: int, **given) -> pa.RecordBatch:
        kinds = {"bucket": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "cls": pa.int64(), "other": pa.int64(), "parts": pa.binary()}
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(many, kinds[c]) for c in names], names=names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            entries = np.concatenate(held)
            if not len(entries):  # null, empty and short texts only: equal sets are one class, and no others link
                return
            entries = entries[np.lexsort((entries["cls"], entries["part"]))]
            first = np.concatenate(([True], entries["part"][1:] != entries["part"][:-1]))
            lead = entries["cls"][np.flatnonzero(first)][np.cumsum(first) - 1]
            chain = np.flatnonzero(entries["cls"] != lead)
            if len(chain):
                pairs = np.unique(np.stack([entries["cls"][chain], lead[chain]]), axis=1)
                yield rows(pairs.shape[1], bucket=pa.array(spread(pairs[0], buckets)), cls=pa.array(pairs[0]), other=pa.array(pairs[1]))
            entries = entries[first]
            bucket, data = blobs(spread(entries["part"], buckets), entries)
            yield rows(len(bucket), bucket=pa.array(bucket, pa.int64()), parts=pa.array(data, pa.binary()))

        for batch in batches:
            for part in steps(batch):
                sets = shingle_sets(part.column("text"), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                digests = [set_digest(s) if len(s) else None for s in sets]
                # rows of documents pass through any bucket; those without a doc_id go by their class and place
                ids, classes = pc.fill_null(part.column("doc_id"), 0).to_numpy(), np.array([d or 0 for d in digests], np.int64)
                nameless = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                deal = np.where(nameless, classes ^ (np.arange(len(sets)) % 64), ids ^ classes)
                yield rows(len(sets), bucket=pa.array(spread(deal, buckets)),
                           doc_id=part.column("doc_id"), n=pa.array(sizes), cls=pa.array(digests, pa.int64()))
                new = []
                for i, d in enumerate(digests):
                    if d is not None and d not in seen:
                        seen.add(d)
                        new.append(i)
                owner, digest = part_digests([sets[i] for i in new], percent, lows)
                entries = np.empty(len(owner), _PART)
                entries["part"], entries["cls"] = digest, np.array([digests[i] for i in new], np.int64)[owner]
                held.append(entries)
                if sum(map(len, held)) >= HELD:
                    yield from flush()
                    held, seen = [], set()
        if held:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(p for p in group["parts"].to_pylist() if p), _PART)
        entries = entries[np.lexsort((entries["cls"], entries["part"]))]
        first = np.concatenate(([True], entries["part"][1:] != entries["part"][:-1])) if len(entries) else np.zeros(0, bool)
        lead = entries["cls"][np.flatnonzero(first)][np.cumsum(first) - 1]
        chain = np.flatnonzero(entries["cls"] != lead)
        pairs = np.unique(np.stack([entries["cls"][chain], lead[chain]]), axis=1)
        passed = group.filter(pc.is_null(group["parts"])).select(["doc_id", "n", "cls", "other"])
        met = pa.table({"doc_id": pa.nulls(pairs.shape[1], pa.int64()), "n": pa.nulls(pairs.shape[1], pa.int64()), "cls": pa.array(pairs[0]), "other": pa.array(pairs[1])})
        return pa.concat_tables([passed, met])

    sent = docs.select("doc_id", "text").mapInArrow(send, "bucket long, doc_id long, n long, cls long, other long, parts binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_id long, n long, cls long, other long")


def _bloom(keys: DataFrame) -> np.ndarray:
    """Bitmap of ``BLOOM_BITS`` bits over hashed doc_ids: of fixed size, and it only ever lets too much pass."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)))
    rows = keys.groupBy(F.floor(slot / 32).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def class_sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(doc_id, cls, shingles) of the documents whose doc_id may be among the keys; the texts are read again."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(keys))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = batch.column("slot").to_numpy()
        may = (bloom.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)
        batch = batch.filter(pa.array(may.astype(bool)))
        sets = shingle_sets(batch.column("text"), width)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["doc_id", "cls", "shingles"])

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)).cast("int").alias("slot")
    return map_batches(docs.select("doc_id", "text", slot), step, "doc_id long, cls long, shingles binary")


def tiles(members: DataFrame, percent: int) -> DataFrame:
    """Members (cls, doc_id, n, cluster) at every tile pair (unit) they are compared in.

    side 2: all pairs of the unit; sides 0 and 1: pairs between the two.
    """
    lows = [int(x) for x in size_bands(percent)]
    per_cluster = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * 8).alias("bytes"))
    fits = (F.col("m") <= TILE) & (F.col("bytes") <= TILE_BYTES)
    sized = members.join(per_cluster, "cluster")
    columns = ["cls", "doc_id", "n", "unit", "side"]
    small = sized.where(fits).select("cls", "doc_id", "n", F.xxhash64("cluster").alias("unit"), F.lit(2).alias("side"))
    band = (F.size(F.filter(F.array(*[F.lit(x) for x in lows]), lambda x: x <= F.col("n"))) - 1).alias("band")
    large = sized.where(~fits).select("cls", "doc_id", "n", "cluster", band)
    per_band = large.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("top"))
    cuts = per_band.select("cluster", "band", F.greatest(F.ceil(F.col("m") * 2 / TILE), F.ceil(F.col("m") * F.col("top") * 16 / TILE_BYTES)).cast("int").alias("cuts"))
    below = cuts.select("cluster", (F.col("band") + 1).alias("band"), F.col("cuts").alias("cuts_below"))
    above = cuts.select("cluster", (F.col("band") - 1).alias("band"), F.col("cuts").alias("cuts_above"))
    placed = large.join(cuts.join(below, ["cluster", "band"], "left").join(above, ["cluster", "band"], "left"), ["cluster", "band"]) \
        .withColumn("cut", F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int"))
    low_here = F.element_at(F.array(*[F.lit(x) for x in lows]), F.col("band") + 1)
    low_next = F.element_at(F.array(*[F.lit(x) for x in lows]), F.col("band") + 2)
    other = F.col("other")
    own = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "cls", "doc_id", "n", F.xxhash64("cluster", F.col("band"), F.col("band"), F.least("cut", other), F.greatest("cut", other)).alias("unit"),
        F.when(F.col("cut") == other, 2).when(F.col("cut") < other, 0).otherwise(1).alias("side"))
    up = placed.where(F.col("cuts_above").isNotNull() & (F.col("n") * 100 >= low_next * percent)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts_above") - 1))).select(
        "cls", "doc_id", "n", F.xxhash64("cluster", F.col("band"), F.col("band") + 1, "cut", "other").alias("unit"), F.lit(0).alias("side"))
    down = placed.where(F.col("cuts_below").isNotNull() & (F.col("n") * percent <= (low_here - 1) * 100)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts_below") - 1))).select(
        "cls", "doc_id", "n", F.xxhash64("cluster", F.col("band") - 1, F.col("band"), "other", "cut").alias("unit"), F.lit(1).alias("side"))
    return small.select(columns).unionByName(own).unionByName(up).unionByName(down)


def joining_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of one unit that join what was apart; sets need not be in order."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sets, side, sizes = [sets[i] for i in order], side[order], sizes[order]
    width = max(8, 1 << int(4 * int(sizes[-1]) - 1).bit_length() >> 6)  # words: four bits for each shingle
    bits = np.zeros((len(sets), width), U)
    for i, s in enumerate(sets):
        slot = mix(s, 21) % U(width * 64)
        np.bitwise_or.at(bits[i], (slot >> U(6)).astype(np.int64), U(1) << (slot & U(63)))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, int(sizes[i]) * 100 // percent, side="right"))
        if end <= i + 1:
            continue
        rest = bits[i + 1 : end]
        lacks_i = np.bitwise_count(rest & ~bits[i]).sum(axis=1, dtype=np.int64)
        lacks_j = np.bitwise_count(bits[i] & ~rest).sum(axis=1, dtype=np.int64)
        most = np.minimum(sizes[i] - lacks_j, sizes[i + 1 : end] - lacks_i)
        may = 100 * most >= percent * (sizes[i] + sizes[i + 1 : end] - most)
        may &= (side[i + 1 : end] != side[i]) | (side[i] == 2)
        for j in (np.flatnonzero(may) + i + 1).tolist():
            a, b = root(i), root(j)
            if a == b:
                continue
            both = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[a] = b
                links.append((int(order[i]), int(order[j])))
    return links


def links(placed: DataFrame, sets: DataFrame, percent: int, lots: int) -> DataFrame:
    """(a, b) classes that are linked: for every unit a forest that joins all that its links join."""
    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("unit", "ascending"), ("cls", "ascending")])
        unit, cls, side = (group[c].to_numpy() for c in ("unit", "cls", "side"))
        keep = np.concatenate(([True], (unit[1:] != unit[:-1]) | (cls[1:] != cls[:-1])))  # a repeated row comes twice
        group, unit, cls, side = group.filter(pa.array(keep)), unit[keep], cls[keep], side[keep]
        edges = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
        data, found = group["shingles"], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                own = [np.frombuffer(x, U) for x in data.slice(a, b - a).to_pylist()]
                found += [(cls[a + i], cls[a + j]) for i, j in joining_links(own, side[a:b], percent)]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    here = placed.alias("p").join(sets.alias("s"), F.col("p.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("p.cls") == F.col("s.cls")))
    dealt = here.select(F.pmod(F.xxhash64("p.unit"), F.lit(lots)).alias("lot"), "p.unit", "p.side", "p.cls", "s.shingles")
    return dealt.groupBy("lot").applyInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    buckets = text_bytes(docs) // BUCKET_BYTES + 1
    rows = materialize(classes_and_chains(docs, width, percent, buckets), "classes-and-chains")
    own = rows.where("other IS NULL").select("doc_id", "n", "cls")
    classes = materialize(own.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "classes")
    clusters = components(rows.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")), "clusters")
    members = materialize(clusters.select(F.col("node").alias("cls"), F.col("label").alias("cluster")).join(classes, "cls"), "cluster-members")
    placed = materialize(tiles(members, percent), "tiles")
    lots = int((placed.agg(F.sum(F.col("n") * 8)).first()[0] or 0) // TILE_BYTES) + 1
    found = links(placed, class_sets(docs, members.select("doc_id"), width), percent, lots)
    joined = components(found, "links")
    nodes = joined.select(F.col("node").alias("cls"), "label")
    named = nodes.join(classes, "cls").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    # a label may hold a third of all classes: its rows are spread by a salt
    nodes = salted_join(nodes, named, ["label"]).select(F.col("cls").alias("node"), F.lit(True).alias("linked"), "component_id")
    per_class = classes.join(nodes, classes["cls"] == nodes["node"], "left").select(
        F.col("cls").alias("of"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return own.join(materialize(per_class, "class-components"), own["cls"] == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
