"""K: geometry on tables.  Territories are shapes on a plane, customers and suppliers are points or squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial
from .base import dbl, table, territories
from .orders import STATION_SQL, _stations
from .registry import query


def _closed(cx, cy, corners):
    return F.array(*[F.array(cx + float(a), cy + float(b)) for a, b in [*corners, corners[0]]])


def _own_shapes(spark, d):
    """A diamond with a square hole around (nation, nation/2)."""
    cx, cy = dbl("n_nationkey"), dbl("n_nationkey") / 2
    outer, hole = _closed(cx, cy, [(-6, 0), (0, -6), (6, 0), (0, 6)]), _closed(cx, cy, [(-1, -1), (1, -1), (1, 1), (-1, 1)])
    return territories(spark, d).select("n_nationkey", "territory", F.array(F.array(outer, hole)).alias("geometry"))


def _own_points(spark, d, shift):
    """Customers around their nation's centre, on a lattice of whole units moved by ``shift``."""
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey", "c_nationkey", (F.col("c_nationkey") + F.floor(F.col("c_custkey") % 15) - 7 + shift).alias("x"),
        (dbl("c_nationkey") / 2 + F.floor(F.abs("c_acctbal")) % 15 - 7 + shift / 2).alias("y"))


def _own_sql(shift):
    return f"""own AS (SELECT n_name AS territory, c_custkey % 15 - 7 + CAST({shift} AS DOUBLE) AS dx, floor(abs(c_acctbal)) % 15 - 7 + CAST({shift / 2} AS DOUBLE) AS dy
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("k01_point_in_polygon", f"""
WITH {_own_sql(0.25)} SELECT territory, CAST(count(CASE WHEN abs(dx) + abs(dy) < 6 AND NOT (abs(dx) < 1 AND abs(dy) < 1) THEN 1 END) AS BIGINT) AS inside, count(*) AS n FROM own GROUP BY 1""")
def k01(spark, d):
    return _inside_own(spark, d, 0.25, False, "inside")


def _inside_own(spark, d, shift, inclusive, name):
    """Points inside their own territory's shape, by cells of the shape; no geometry travels with a point."""
    points = _own_points(spark, d, shift).withColumnRenamed("c_nationkey", "n_nationkey")
    shapes = _own_shapes(spark, d)
    hit = spatial.points_in_shapes(points, shapes.select("n_nationkey", "geometry"), "x", "y", "geometry", 1.0, inclusive=inclusive, on=["n_nationkey"])
    inside = hit.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("_in"))
    everyone = points.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return everyone.join(shapes.select("n_nationkey", "territory"), "n_nationkey").join(inside, "n_nationkey", "left").select(
        "territory", F.coalesce("_in", F.lit(0)).alias(name), "n")


@query("k02_cover_test", f"""
WITH {_own_sql(0)} SELECT territory, CAST(count(CASE WHEN abs(dx) + abs(dy) <= 6 AND NOT (abs(dx) < 1 AND abs(dy) < 1) THEN 1 END) AS BIGINT) AS covered, count(*) AS n FROM own GROUP BY 1""")
def k02(spark, d):
    return _inside_own(spark, d, 0.0, True, "covered")


@query("k03_centroid_radius", f"""
WITH {STATION_SQL} SELECT territory, count(*) AS stations, CAST(round(min(km) * 1000) AS BIGINT) AS nearest_m FROM dist WHERE km <= 60 GROUP BY 1""")
def k03(spark, d):
    n = F.col("n_nationkey")
    cx, cy = F.lit(-52.0) + F.floor(n / 5) * 0.25, F.lit(-26.0) + n % 5 * 0.25
    corners = [(-0.5, -0.25), (0.5, -0.25), (0.5, 0.25), (-0.5, 0.25)]
    shapes = territories(spark, d).select("territory", F.array(F.array(_closed(cx, cy, corners))).alias("geometry"))
    c = shapes.withColumn("c", geo.centroid(F.col("geometry"))).select("territory", F.col("c.y").alias("clat"), F.col("c.x").alias("clon"))
    near = spatial.within_radius(_stations(spark, d), c, "lat", "lon", "clat", "clon", 60.0)
    return near.groupBy("territory").agg(F.count(F.lit(1)).alias("stations"), F.round(F.min("distance_km") * 1000).cast("bigint").alias("nearest_m"))


@query("k03_radius_anywhere", """
WITH st AS (SELECT s_suppkey AS id, CAST(-90 + s_suppkey * 37 % 181 AS DOUBLE) AS lat, CAST(-180 + s_suppkey * 53 % 361 AS DOUBLE) AS lon FROM supplier),
ce AS (SELECT n_name AS territory, CAST(-90 + n_nationkey * 7.5 AS DOUBLE) AS clat, CAST(CASE n_nationkey % 3 WHEN 0 THEN 179.9 WHEN 1 THEN -179.5 ELSE n_nationkey * 14 - 170 END AS DOUBLE) AS clon FROM nation),
dist AS (SELECT territory, id, 2 * CAST(6371 AS DOUBLE) * asin(least(1.0, sqrt(power(sin(radians(lat - clat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * power(sin(radians(lon - clon) / 2), 2)))) AS km FROM st, ce)
SELECT territory, id, CAST(round(km) AS BIGINT) AS km FROM dist WHERE km <= 1500""")
def k03_anywhere(spark, d):
    """Stations and centres all over the globe, both poles and both sides of the date line included."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    stations = table(spark, d, "supplier").select(k.alias("id"), (F.lit(-90.0) + k * 37 % 181).alias("lat"), (F.lit(-180.0) + k * 53 % 361).alias("lon"))
    lon = F.when(n % 3 == 0, F.lit(179.9)).when(n % 3 == 1, F.lit(-179.5)).otherwise(n * 14.0 - 170.0)
    centers = territories(spark, d).select("territory", (F.lit(-90.0) + n * 7.5).alias("clat"), lon.alias("clon"))
    near = spatial.within_radius(stations, centers, "lat", "lon", "clat", "clon", 1500.0)
    return near.select("territory", "id", F.round("distance_km").cast("bigint").alias("km"))


@query("k04_envelope_prefilter", f"""
WITH {_own_sql(0)} SELECT territory, count(*) AS candidates FROM own WHERE abs(dx) <= 6.5 AND abs(dy) <= 6.5 GROUP BY 1""")
def k04(spark, d):
    boxes = _own_shapes(spark, d).select("n_nationkey", "territory", geo.pad_bbox(geo.bbox(F.col("geometry")), 0.5).alias("box"))
    j = _own_points(spark, d, 0.0).join(boxes, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.filter(geo.in_box(F.col("x"), F.col("y"), F.col("box"))).groupBy("territory").agg(F.count(F.lit(1)).alias("candidates"))


def _boundaries(spark, d):
    """Territories as 8 by 8 squares tiling a 40 by 40 plane."""
    n = F.col("n_nationkey")
    x, y = n % 5 * 8.0, F.floor(n / 5) * 8.0
    return territories(spark, d).select("territory", F.array(F.array(_closed(x, y, [(0, 0), (8, 0), (8, 8), (0, 8)]))).alias("geometry"))


def _areas(spark, d):
    """Suppliers as overlapping 5 by 3 rectangles; some cross a territory line, some touch it."""
    k = F.col("s_suppkey")
    x, y = dbl(k * 7 % 35), dbl(k * 3 % 37)
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("L"), F.floor(F.col("s_nationkey") / 5)).alias("layer"),
                                              F.array(F.array(_closed(x, y, [(0, 0), (5, 0), (5, 3), (0, 3)]))).alias("geometry"))


RECT_SQL = """b AS (SELECT n_name AS territory, (n_nationkey % 5) * 8 AS bx, (n_nationkey // 5) * 8 AS by_ FROM nation),
s AS (SELECT s_suppkey, 'L' || (s_nationkey // 5) AS layer, s_suppkey * 7 % 35 AS sx, s_suppkey * 3 % 37 AS sy FROM supplier),
clip AS (SELECT territory, s_suppkey, layer, greatest(0, least(bx + 8, sx + 5) - greatest(bx, sx)) * greatest(0, least(by_ + 8, sy + 3) - greatest(by_, sy)) AS area FROM b, s)"""


def _cells(spark, d):
    return spatial.covered_cells(_areas(spark, d), "geometry", 1.0), spatial.covered_cells(_boundaries(spark, d), "geometry", 1.0)


@query("k05_clip_area", f"WITH {RECT_SQL} SELECT territory, count(*) AS units, CAST(sum(area) AS DOUBLE) AS area, CAST(max(area) AS DOUBLE) AS largest FROM clip WHERE area > 0 GROUP BY 1")
def k05(spark, d):
    shapes, bounds = _cells(spark, d)
    return spatial.clip_area(shapes, bounds, ["s_suppkey"], ["territory"], 1.0).groupBy("territory").agg(
        F.count(F.lit(1)).alias("units"), F.sum("area").alias("area"), F.max("area").alias("largest"))


@query("k06_union_area", f"""
WITH {RECT_SQL}, g AS (SELECT x, y FROM (SELECT unnest(range(0, 40)) AS x), (SELECT unnest(range(0, 40)) AS y)),
cov AS (SELECT DISTINCT x, y FROM g JOIN s ON x >= sx AND x < sx + 5 AND y >= sy AND y < sy + 3),
u AS (SELECT territory, count(*) AS k FROM cov JOIN b ON x >= bx AND x < bx + 8 AND y >= by_ AND y < by_ + 8 GROUP BY 1), p AS (SELECT territory, sum(area) AS parts FROM clip GROUP BY 1)
SELECT territory, CAST(64 AS DOUBLE) AS territory_area, CAST(coalesce(k, 0) AS DOUBLE) AS union_area, CAST(parts AS DOUBLE) AS sum_of_parts, CAST(coalesce(k, 0) AS DOUBLE) / 64 * 100 AS share FROM p LEFT JOIN u USING (territory)""")
def k06(spark, d):
    shapes, bounds = _cells(spark, d)
    return spatial.union_area(shapes, bounds, ["territory"], 1.0)


@query("k07_layers_present", f"WITH {RECT_SQL} SELECT DISTINCT territory, layer FROM clip WHERE area > 0")
def k07(spark, d):
    shapes, bounds = _cells(spark, d)
    return spatial.layers_present(shapes, bounds, ["territory"], "layer")


@query("k08_geometry_validity", """
WITH k AS (SELECT CASE WHEN s_acctbal < 0 THEN 'open ring' WHEN s_acctbal < 1000 THEN 'short ring' WHEN s_acctbal < 1500 THEN 'non-finite vertex' WHEN s_acctbal > 9000 THEN 'outside extent' END AS problem FROM supplier)
SELECT problem, count(*) AS n FROM k GROUP BY 1""")
def k08(spark, d):
    b, x = F.col("s_acctbal"), dbl(F.col("s_suppkey") % 30)
    good = [(0, 0), (5, 0), (5, 3), (0, 3)]
    ring = (
        F.when(b < 0, F.array(*[F.array(x + float(p), F.lit(float(q))) for p, q in good]))
        .when(b < 1000, _closed(x, F.lit(0.0), good[:2]))
        .when(b < 1500, F.array(F.array(x, F.lit(float("nan"))), *[F.array(x + float(p), F.lit(float(q))) for p, q in good[1:]], F.array(x, F.lit(float("nan")))))
        .when(b > 9000, _closed(x + 500, F.lit(0.0), good)).otherwise(_closed(x, F.lit(0.0), good))
    )
    problem = geo.geometry_error(F.array(F.array(ring)), -50.0, -50.0, 50.0, 50.0)
    return table(spark, d, "supplier").groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("k09_coordinate_agreement", """
SELECT s_nationkey, CAST(count(CASE WHEN s_acctbal <= 9000 THEN 1 END) AS BIGINT) AS agree, CAST(count(CASE WHEN s_acctbal > 9000 THEN 1 END) AS BIGINT) AS differ FROM supplier GROUP BY 1""")
def k09(spark, d):
    attr = F.col("lat") + F.when(F.col("s_acctbal") > 9000, 0.001).otherwise(0.00005)
    s = _stations(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal"), "id")
    ok = geo.coordinates_agree(F.col("lon"), F.col("lat"), F.col("lon"), attr)
    return s.groupBy("s_nationkey").agg(F.count_if(ok).alias("agree"), F.count_if(~ok).alias("differ"))
