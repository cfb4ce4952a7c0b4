"""Spatial operators on tables.

Shapes are unfolded to grid cells and points carry their cell, so a spatial join is an
equi-join on the cell followed by the exact test.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import materialize, salted_join
from .ranking import smallest_k


def cell_of(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).cast("bigint").alias("cx"), F.floor(y / size).cast("bigint").alias("cy"))


def _ring_edges(keyed: DataFrame, geometry: str, size: float) -> DataFrame:
    """Every edge of every ring as a row, with the first and last column of cells it touches and the next edge's first.

    A ring that is left open is closed.  ``_uid, _p, _r`` name shape, polygon and ring (0 is the outer one).
    """
    slack = size * 1e-9  # an edge this close to a cell is tested there
    column = lambda v: F.floor(v / size).cast("bigint")
    rings = keyed.select("_uid", F.posexplode(geometry).alias("_p", "_polygon")).select("_uid", "_p", F.posexplode("_polygon").alias("_r", "_open"))
    ring = F.when(F.element_at("_open", -1) == F.col("_open")[0], F.col("_open")).otherwise(F.concat("_open", F.slice("_open", 1, 1)))
    closed = rings.filter(F.size("_open") > 1).select("_uid", "_p", "_r", ring.alias("_ring"))
    at = lambda i: F.get("_ring", i)
    last = F.size("_ring") - 1

    def edge(i: Column) -> Column:
        return F.struct(at(i).alias("a"), at(i + 1).alias("b"), F.when(i + 2 > last, at(F.lit(1))).otherwise(at(i + 2)).alias("c"))

    rows = closed.select("_uid", "_p", "_r", F.explode(F.transform(F.sequence(F.lit(0), last - 1), edge)).alias("v"))
    xs = {k: F.col(f"v.{k}")[0] for k in "abc"}
    return rows.select(
        "_uid", "_p", "_r", F.struct(xs["a"].alias("ax"), F.col("v.a")[1].alias("ay"), xs["b"].alias("bx"), F.col("v.b")[1].alias("by")).alias("_e"),
        column(F.least(xs["a"], xs["b"]) - slack).alias("_first"), column(F.greatest(xs["a"], xs["b"]) + slack).alias("_last"),
        column(F.least(xs["b"], xs["c"]) - slack).alias("_next"))


def _ring_cells(edges: DataFrame, size: float) -> DataFrame:
    """Cells that a ring's line touches, with the edges that touch them, and cells that lie wholly inside the ring.

    Whether a point is inside depends on the edges of its own cell, tested one by one, and on how many edges further right
    are level with it.  Of those only three things are kept: along the chain of edges each inner corner counts twice and
    so not at all; corners where the chain passes from the cell's own edges to those further right count if they
    are above the point (``ys``); ends above the row of cells always count (``odd``).
    Cells between two touched ones of a row share one answer and are filled in.
    """
    slack = size * 1e-9
    row = lambda v: F.floor(v / size).cast("bigint")
    ay, by = F.col("_e.ay"), F.col("_e.by")
    strips = edges.withColumn("_cy", F.explode(F.sequence(row(F.least(ay, by) - slack), row(F.greatest(ay, by) + slack))))
    above = (row(ay) > F.col("_cy")).cast("long") + (row(by) > F.col("_cy")).cast("long")
    keys = ["_uid", "_p", "_r", "_cy", "_cx"]
    none = F.lit(None)
    own = strips.withColumn("_cx", F.explode(F.sequence("_first", "_last"))).select(
        *keys, "_e", F.when(F.col("_cx") == F.col("_first"), above).otherwise(0).alias("_up"), none.cast("double").alias("_y"))
    turns = edges.filter("_first <> _next").withColumns({"_cy": row(by), "_cx": F.explode(F.sequence(
        F.least("_first", "_next"), F.greatest("_first", "_next") - 1))}).select(*keys, F.lit(None).cast(edges.schema["_e"].dataType).alias("_e"), F.lit(0).cast("long").alias("_up"), by.alias("_y"))
    touched = own.unionByName(turns).groupBy(*keys).agg(F.collect_list("_e").alias("edges"), F.collect_list("_y").alias("ys"), F.sum("_up").alias("_up"))
    leftward = Window.partitionBy("_uid", "_p", "_r", "_cy").orderBy(F.desc("_cx"))
    placed = touched.withColumns({
        "_from": F.sum("_up").over(leftward.rowsBetween(Window.unboundedPreceding, 0)), "_left": F.lead("_cx").over(leftward)})
    part = lambda whole, edges_, ys, odd: F.struct(
        F.col("_p").alias("p"), F.col("_r").alias("r"), F.lit(whole).alias("whole"), edges_.alias("edges"), ys.alias("ys"), odd.alias("odd"))
    line = placed.select("_uid", "_cx", "_cy", part(False, F.col("edges"), F.col("ys"), (F.col("_from") - F.col("_up")) % 2).alias("_ring"))
    nothing = {c: F.array().cast(touched.schema[c].dataType) for c in ("edges", "ys")}
    filled = placed.filter((F.col("_from") % 2 == 1) & (F.col("_left") < F.col("_cx") - 1)).select(
        "_uid", F.explode(F.sequence(F.col("_left") + 1, F.col("_cx") - 1)).alias("_cx"), "_cy", part(True, nothing["edges"], nothing["ys"], F.lit(1).cast("long")).alias("_ring"))
    return line.unionByName(filled)


def _in_part(x: Column, y: Column, part: Column) -> Column:
    crossed = F.size(F.filter(part["edges"], lambda e: geo.straddles(e, y) & (x < geo.crossing_x(e, y))))
    return part["whole"] | ((crossed + F.size(F.filter(part["ys"], lambda v: v > y)) + part["odd"]) % 2 == 1)


def _judged_cells(shapes: DataFrame, geometry: str, size: float) -> DataFrame:
    """Cells of shapes with the shapes' other columns: ``_whole`` when inside, else ``_rings``, the parts of rings that decide.

    Edges, rows of cells and cells are rows of their own, so a shape of very many edges is shared out, and a cell
    holds the edges that touch it and no others.
    """
    keyed = materialize(shapes.withColumn("_uid", F.monotonically_increasing_id()), "shapes")
    cells = _ring_cells(_ring_edges(keyed, geometry, size), size).groupBy("_uid", "_cx", "_cy").agg(F.collect_list("_ring").alias("_rings"))
    hole = lambda o: lambda h: (h["p"] == o["p"]) & (h["r"] > 0)
    whole = F.exists("_rings", lambda o: (o["r"] == 0) & o["whole"] & ~F.exists("_rings", hole(o)))
    judged = cells.select("_uid", F.struct(F.col("_cx").alias("cx"), F.col("_cy").alias("cy")).alias("cell"), whole.alias("_whole"), "_rings").filter(
        F.col("_whole") | F.exists("_rings", lambda g: ~g["whole"]))
    return judged.withColumn("_rings", F.when(~F.col("_whole"), F.col("_rings"))).join(keyed.drop(geometry), "_uid").drop("_uid")


def points_in_shapes(
    points: DataFrame, shapes: DataFrame, x: str, y: str, geometry: str, size: float, inclusive: bool = False, salts: int = 16,
    on: Sequence[str] = (),
) -> DataFrame:
    """Every (point, shape) pair with the point inside; ``inclusive`` also counts the boundary line.

    Points in cells wholly inside a shape need no further test.  ``on`` names columns that
    must agree as well, such as the point's own territory.
    """
    located = points.withColumn("cell", cell_of(F.col(x), F.col(y), size))
    candidates = salted_join(located, _judged_cells(shapes, geometry, size), [*on, "cell"], "inner", salts)
    px, py = F.col(x), F.col(y)

    def inside(o: Column) -> Column:
        return (o["r"] == 0) & _in_part(px, py, o) & ~F.exists("_rings", lambda h: (h["p"] == o["p"]) & (h["r"] > 0) & _in_part(px, py, h))

    hit = F.exists("_rings", inside)
    if inclusive:
        hit = hit | geo.on_edges(px, py, F.array(F.transform("_rings", lambda g: g["edges"])))
    return candidates.filter(F.col("_whole") | hit).drop("cell", "_whole", "_rings")


def within_radius(
    points: DataFrame, centers: DataFrame, lat: str, lon: str, center_lat: str, center_lon: str, radius_km: float, salts: int = 16
) -> DataFrame:
    """Points within a radius of each centre, with their distance, anywhere on the globe.

    Centres unfold to the cells their radius can reach, so only near pairs are ever formed.  Cells
    are bands of latitude cut by meridians; they close at 180 degrees and are fewer near the poles.
    """
    reach = math.degrees(radius_km / geo.EARTH_KM) * (1 + 1e-9)
    size = max(reach, 0.05)
    lat0, lon0 = F.col(center_lat), F.col(center_lon)
    # a circle that holds a pole meets every meridian
    ratio = F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(lat0))
    wide = F.when((F.abs(lat0) + reach >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    first, last = F.greatest(lat0 - reach, F.lit(-90.0)), F.least(lat0 + reach, F.lit(90.0))
    bands = centers.withColumns({"_wide": wide, "_cy": F.explode(F.sequence(F.floor(first / size).cast("bigint"), F.floor(last / size).cast("bigint")))})
    many = _cells_around(F.col("_cy"), size)
    turn = lambda lon: F.floor((lon + 180) / 360 * many).cast("bigint")
    low, high = turn(lon0 - F.col("_wide")), turn(lon0 + F.col("_wide"))
    by_cell = (
        bands.withColumn("_cx", F.explode(F.sequence(low, F.least(high, low + many - 1))))
        .withColumn("cell", F.struct(F.pmod(F.col("_cx"), many).alias("cx"), F.col("_cy").alias("cy"))).drop("_wide", "_cx", "_cy")
    )
    band = F.floor(F.col(lat) / size).cast("bigint")
    around = _cells_around(band, size)
    cell = F.struct(F.pmod(F.floor((F.col(lon) + 180) / 360 * around).cast("bigint"), around).alias("cx"), band.alias("cy"))
    pairs = salted_join(points.withColumn("cell", cell), by_cell, ["cell"], "inner", salts).drop("cell")
    far = geo.haversine_km(F.col(lat), F.col(lon), F.col(center_lat), F.col(center_lon))
    return pairs.withColumn("distance_km", far).filter(F.col("distance_km") <= radius_km)


def _cells_around(band: Column, size: float) -> Column:
    """Number of cells around the globe in a band of latitudes: fewer towards the poles, each at least ``size`` wide."""
    highest = F.least(F.greatest(F.abs(band * size), F.abs((band + 1) * size)), F.lit(90.0))
    return F.greatest(F.floor(F.cos(F.radians(highest)) * 360 / size).cast("bigint"), F.lit(1).cast("bigint"))


def nearest_within(
    points: DataFrame, centers: DataFrame, keys: Sequence[str], point_id: str, lat: str, lon: str,
    center_lat: str, center_lon: str, radius_km: float, k: int, salts: int = 16,
) -> DataFrame:
    """The ``k`` nearest points within a radius of each centre, by distance then id.

    The top-k is cut inside each task before the shuffle.
    """
    close = within_radius(points, centers, lat, lon, center_lat, center_lon, radius_km, salts)
    return smallest_k(close, keys, [F.asc("distance_km"), F.asc(point_id)], k)


def inside_then_nearest(inside: DataFrame, nearby: DataFrame, keys: Sequence[str], point_id: str) -> DataFrame:
    """Points inside first, then the nearby ones that are not already inside."""
    a = inside.select(*keys, point_id).withColumns({"location": F.lit("inside"), "distance_km": F.lit(None).cast("double")})
    b = nearby.join(inside.select(*keys, point_id), [*keys, point_id], "left_anti").select(*keys, point_id, "distance_km").withColumn(
        "location", F.lit("regional"))
    return a.unionByName(b)


def covered_cells(shapes: DataFrame, geometry: str, size: float) -> DataFrame:
    """Equal-area grid cells whose centre a (valid) shape covers.

    Every edge is a row and gives one row for each row of cells it cuts; the cuts of a shape's row of cells meet in a
    window, wherever the shape's other rows are.  Between the first and second cut,
    the third and fourth and so on, every centre is inside.  A cell counts wholly or not at
    all: the area error per shape is at most its perimeter times the cell's diagonal.
    Coordinates must be in a projected, equal-area unit.
    """
    rest = [c for c in shapes.columns if c != geometry]
    edges = shapes.withColumn("_uid", F.monotonically_increasing_id()).select(
        *rest, "_uid", F.explode(F.flatten(F.flatten(geo.edges(F.col(geometry))))).alias("_e"))
    level = lambda v: F.floor(v / size - 0.5).cast("bigint")
    low, high = F.least("_e.ay", "_e.by"), F.greatest("_e.ay", "_e.by")
    cuts = (
        edges.withColumn("_cy", F.explode(F.sequence(level(low), level(high) + 1)))
        .withColumn("_y", (F.col("_cy") + 0.5) * size).filter(geo.straddles(F.col("_e"), F.col("_y")))
        .withColumn("_from", geo.crossing_x(F.col("_e"), F.col("_y"))).drop("_e", "_y")
    )
    # one row of cells of one shape: its cuts from left to right, two by two
    along = Window.partitionBy("_uid", "_cy").orderBy("_from")
    spans = (
        cuts.withColumns({"_to": F.lead("_from").over(along), "_i": F.row_number().over(along)})
        .filter((F.col("_i") % 2 == 1) & F.col("_to").isNotNull()).drop("_i", "_uid")
    )
    centre = (F.col("_cx") + 0.5) * size
    return (
        spans.withColumn("_cx", F.explode(F.sequence(
            F.floor(F.col("_from") / size).cast("bigint"), F.floor(F.col("_to") / size).cast("bigint"))))
        .filter((centre >= F.col("_from")) & (centre < F.col("_to")))
        .withColumn("cell", F.struct(F.col("_cx").alias("cx"), F.col("_cy").alias("cy")))
        .drop("_cx", "_cy", "_from", "_to")
    )


def clip_area(shape_cells: DataFrame, boundary_cells: DataFrame, shape: Sequence[str], boundary: Sequence[str], cell_area: float) -> DataFrame:
    """Area of each shape inside each boundary; pairs without area (tangents) do not appear.

    Many shapes may cover one cell, so their side is spread by a salt.
    """
    j = salted_join(shape_cells.select(*shape, "cell"), boundary_cells.select(*boundary, "cell"), ["cell"])
    return j.groupBy(*boundary, *shape).agg((F.count(F.lit(1)) * cell_area).alias("area"))


def union_area(shape_cells: DataFrame, boundary_cells: DataFrame, boundary: Sequence[str], cell_area: float) -> DataFrame:
    """Area covered by any shape, once however many overlap, with the sum of parts and the share."""
    hits = shape_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    j = boundary_cells.select(*boundary, "cell").join(hits, "cell", "left")
    whole = F.count(F.lit(1)) * cell_area
    union = F.count("_n") * cell_area
    return j.groupBy(*boundary).agg(
        whole.alias("territory_area"), union.alias("union_area"),
        (F.coalesce(F.sum("_n"), F.lit(0)) * cell_area).alias("sum_of_parts"), (union / whole * 100).alias("share"),
    )


def layers_present(shape_cells: DataFrame, boundary_cells: DataFrame, boundary: Sequence[str], layer: str) -> DataFrame:
    """Which layers touch a boundary at all."""
    return boundary_cells.select(*boundary, "cell").join(shape_cells.select(layer, "cell").distinct(), "cell", "inner").select(*boundary, layer).distinct()
