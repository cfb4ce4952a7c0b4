import math
import random

import pytest
from pyspark.sql import functions as F

from statmosaic.functions import geo
from statmosaic.operators import spatial

SQUARE = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
HOLE = [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0], [4.0, 4.0]]
FAR = [[20.0, 0.0], [22.0, 0.0], [20.0, 4.0], [20.0, 0.0]]
MULTI = [[SQUARE, HOLE], [FAR]]
GEOM = "array<array<array<array<double>>>>"


def brute(x, y, multi):
    def ring(r):
        inside = False
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
        return inside
    return any(ring(p[0]) and not any(ring(h) for h in p[1:]) for p in multi)


def test_point_in_multi_polygon_with_holes(spark):
    r = random.Random(3)
    pts = [(i, r.uniform(-2, 24), r.uniform(-2, 12)) for i in range(500)]
    df = spark.createDataFrame(pts, "i int, x double, y double").join(spark.createDataFrame([(1, MULTI)], f"one int, g {GEOM}"), F.lit(1) == F.col("one"))
    got = {r_["i"]: r_["h"] for r_ in df.select("i", geo.in_geometry(F.col("x"), F.col("y"), F.col("g")).alias("h")).collect()}
    assert got == {i: brute(x, y, MULTI) for i, x, y in pts}


@pytest.mark.parametrize("x,y,covered", [(0.0, 5.0, True), (10.0, 10.0, True), (4.0, 5.0, True), (5.0, 5.0, False), (21.0, 2.0, True), (10.1, 5.0, False), (5.0, 0.0, True)])
def test_cover_includes_boundaries(spark, x, y, covered):
    df = spark.createDataFrame([(x, y, MULTI)], f"x double, y double, g {GEOM}")
    assert df.select(geo.covers(F.col("x"), F.col("y"), F.col("g"))).first()[0] is covered


def test_area_centroid_and_box(spark):
    df = spark.createDataFrame([([[SQUARE, HOLE]], [[SQUARE, [[0.0, 0.0], [5.0, 0.0], [5.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]])], f"a {GEOM}, b {GEOM}")
    a = df.select(geo.polygon_area(F.col("a")[0]).alias("area"), geo.centroid(F.col("a")).alias("c"), geo.centroid(F.col("b")).alias("d"), geo.bbox(F.col("a")).alias("box")).first()
    assert a["area"] == 96.0
    assert (a["c"]["x"], a["c"]["y"]) == (5.0, 5.0)
    assert (a["d"]["x"], a["d"]["y"]) == (7.5, 5.0)
    assert tuple(a["box"]) == (0.0, 0.0, 10.0, 10.0)


@pytest.mark.parametrize("multi,why", [
    ([[SQUARE]], None), ([], "empty"), (None, "empty"), ([[SQUARE[:3]]], "short ring"), ([[SQUARE[:4]]], "open ring"),
    ([[[[math.nan, 0.0], [1.0, 0.0], [1.0, 1.0], [math.nan, 0.0]]]], "non-finite vertex"), ([[[[99.0, 0.0], [1.0, 0.0], [1.0, 1.0], [99.0, 0.0]]]], "outside extent")])
def test_geometry_errors(spark, multi, why):
    df = spark.createDataFrame([(multi,)], f"g {GEOM}")
    assert df.select(geo.geometry_error(F.col("g"), -50.0, -50.0, 50.0, 50.0)).first()[0] == why


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert abs(d - math.pi * 6371) < 1e-6


def test_grid_join_equals_all_pairs(spark, rows):
    r = random.Random(5)
    pts = [(i, r.uniform(-3, 25), r.uniform(-3, 13)) for i in range(400)] + [(1000 + i, 5.0 + i / 1000, 2.0) for i in range(300)]
    shapes = [("a", [[SQUARE, HOLE]]), ("b", [[FAR]]), ("c", [[[[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]]])]
    got = spatial.points_in_shapes(spark.createDataFrame(pts, "i int, x double, y double"), spark.createDataFrame(shapes, f"s string, g {GEOM}"), "x", "y", "g", 2.5)
    assert rows(got, "i", "s") == sorted([(i, s) for i, x, y in pts for s, g in shapes if brute(x, y, g)], key=repr)


def hav(a, b, c, d):
    p = math.radians
    h = math.sin(p(a - c) / 2) ** 2 + math.cos(p(a)) * math.cos(p(c)) * math.sin(p(b - d) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat0", [-25.0, 62.0])
def test_nearest_equals_all_pairs(spark, rows, lat0):
    r = random.Random(7)
    pts = [(i, lat0 + r.uniform(-1, 1), -51 + r.uniform(-2, 2)) for i in range(300)]
    centers = [("a", lat0, -51.0), ("b", lat0 + 0.4, -50.2)]
    got = spatial.nearest_within(spark.createDataFrame(pts, "i int, lat double, lon double"), spark.createDataFrame(centers, "c string, clat double, clon double"),
                                 ["c"], "i", "lat", "lon", "clat", "clon", 50.0, 10)
    want = []
    for c, la, lo in centers:
        near = sorted((hav(y, x, la, lo), i) for i, y, x in pts)
        want += [(c, i, n + 1) for n, (km, i) in enumerate(k for k in near if k[0] <= 50) if n < 10]
    assert rows(got, "c", "i", "position") == sorted(want, key=repr)


def test_inside_come_first_and_only_once(spark, rows):
    inside = spark.createDataFrame([("t", 1)], "t string, i int")
    near = spark.createDataFrame([("t", 1, 0.5), ("t", 2, 3.0)], "t string, i int, distance_km double")
    assert rows(spatial.inside_then_nearest(inside, near, ["t"], "i"), "i", "location") == [(1, "inside"), (2, "regional")]


def box(x0, y0, x1, y1):
    return [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]


def test_overlay_areas_count_overlap_once(spark, rows):
    bounds = spatial.covered_cells(spark.createDataFrame([("t", box(0.0, 0.0, 10.0, 10.0))], f"t string, g {GEOM}"), "g", 0.5)
    units = [("u1", box(0.0, 0.0, 4.0, 4.0)), ("u2", box(2.0, 2.0, 6.0, 6.0)), ("out", box(10.0, 0.0, 12.0, 2.0)), ("half", box(9.0, 9.0, 12.0, 12.0))]
    shapes = spatial.covered_cells(spark.createDataFrame(units, f"u string, g {GEOM}"), "g", 0.5)
    assert rows(spatial.clip_area(shapes, bounds, ["u"], ["t"], 0.25), "u", "area") == [("half", 1.0), ("u1", 16.0), ("u2", 16.0)]
    u = spatial.union_area(shapes, bounds, ["t"], 0.25).first()
    assert (u["territory_area"], u["union_area"], u["sum_of_parts"]) == (100.0, 29.0, 33.0)
    assert abs(u["share"] - 29.0) < 1e-9
    assert rows(spatial.layers_present(shapes, bounds, ["t"], "u"), "u") == [("half",), ("u1",), ("u2",)]


def test_overlay_stays_within_its_stated_error(spark):
    n, size = 64, 0.05
    ring = [[3 * math.cos(2 * math.pi * i / n), 3 * math.sin(2 * math.pi * i / n)] for i in range(n)]
    ring.append(list(ring[0]))
    df = spark.createDataFrame([("c", [[ring]])], f"u string, g {GEOM}")
    exact = df.select(geo.polygon_area(F.col("g")[0])).first()[0]
    got = spatial.covered_cells(df, "g", size).count() * size * size
    perimeter = sum(math.dist(a, b) for a, b in zip(ring, ring[1:], strict=False))
    assert abs(got - exact) <= perimeter * size * math.sqrt(2)
    assert abs(got - exact) / exact < 0.005


def star(r, cx, cy, n=12):
    pts = []
    for i in range(n):
        d, a = r.uniform(0.5, 4.0), 2 * math.pi * i / n
        pts.append([cx + d * math.cos(a), cy + d * math.sin(a)])
    return [*pts, list(pts[0])]


def test_random_shapes_equal_the_plain_test(spark, rows):
    r = random.Random(11)
    shapes = [(f"s{i}", [[star(r, r.uniform(0, 20), r.uniform(0, 20))]]) for i in range(15)] + [("m", MULTI)]
    pts = [(i, r.uniform(-3, 24), r.uniform(-3, 24)) for i in range(600)] + [(1000 + i, float(i % 21), float(i // 21)) for i in range(441)]
    sf = spark.createDataFrame(shapes, f"s string, g {GEOM}")
    pf = spark.createDataFrame(pts, "i int, x double, y double")
    for size in (0.7, 3.0, 50.0):
        got = spatial.points_in_shapes(pf, sf, "x", "y", "g", size, salts=3)
        assert rows(got, "i", "s") == sorted([(i, s) for i, x, y in pts for s, g in shapes if brute(x, y, g)], key=repr)
    size = 0.35
    got = spatial.covered_cells(sf, "g", size).select("s", "cell.cx", "cell.cy")
    want = [(s, cx, cy) for s, g in shapes for cx in range(-15, 75) for cy in range(-15, 75) if brute((cx + 0.5) * size, (cy + 0.5) * size, g)]
    assert rows(got) == sorted(want, key=repr)


def test_inclusive_grid_join_keeps_boundary_points(spark, rows):
    sf = spark.createDataFrame([("a", [[SQUARE, HOLE]])], f"s string, g {GEOM}")
    pts = [(1, 0.0, 0.0), (2, 10.0, 5.0), (3, 4.0, 5.0), (4, 5.0, 5.0), (5, 5.0, 10.0), (6, 10.5, 5.0)]
    got = spatial.points_in_shapes(spark.createDataFrame(pts, "i int, x double, y double"), sf, "x", "y", "g", 2.0, inclusive=True)
    assert rows(got, "i") == [(1,), (2,), (3,), (5,)]


def test_polygons_holes_and_lattice_points_equal_the_plain_test(spark, rows):
    """Polygons of one shape that overlap, holes that touch, corners on cell borders, an open ring and repeated shapes."""
    r = random.Random(4)
    big = [[0.0, 0.0], [12.0, 0.0], [12.0, 12.0], [6.0, 6.0], [0.0, 12.0], [0.0, 0.0]]
    holes = [[[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]], [[4.0, 2.0], [6.0, 1.0], [6.0, 3.0], [4.0, 2.0]]]
    zigzag = [[float(i), 8.0 + (i % 2) * 3 + r.random()] for i in range(-3, 15)] + [[14.0, -2.0], [-3.0, -2.0], [-3.0, 8.5]]
    shapes = [("a", [[big, *holes], [SQUARE]]), ("b", [[zigzag + [zigzag[0]], holes[0]]]), ("open", [[zigzag]]), ("a", [[big, *holes], [SQUARE]]), ("none", None), ("empty", [])]
    closed = {"open": [[zigzag + [zigzag[0]]]]}
    pts = [(i, (i % 37) / 2 - 3, (i // 37) / 2 - 3) for i in range(37 * 37)] + [(5000 + i, r.uniform(-4, 16), r.uniform(-4, 16)) for i in range(500)]
    sf, pf = spark.createDataFrame(shapes, f"s string, g {GEOM}"), spark.createDataFrame(pts, "i int, x double, y double")
    for size in (0.5, 1.7):
        got = spatial.points_in_shapes(pf, sf, "x", "y", "g", size)
        assert rows(got, "i", "s") == sorted([(i, s) for i, x, y in pts for s, g in shapes if g and brute(x, y, closed.get(s, g))], key=repr)


def test_a_shape_of_very_many_edges_is_shared_out(spark):
    """The cells of one ring of 100,000 edges come from many tasks, and no cell holds more than the edges that touch it."""
    n = 100_000
    ring = [[100 * math.cos(2 * math.pi * i / n) * (1 + 0.01 * (i % 2)), 100 * math.sin(2 * math.pi * i / n) * (1 + 0.01 * (i % 2))] for i in range(n)]
    df = spark.createDataFrame([(1, [[[*ring, ring[0]]]])], f"u int, g {GEOM}")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = spatial._judged_cells(df, "g", 2.0).withColumn("task", F.spark_partition_id()).cache()
        most = cells.agg(F.max(F.aggregate("_rings", F.lit(0), lambda a, x: a + F.size(x["edges"]))).alias("n"), F.countDistinct("task").alias("tasks"), F.count_if("_whole").alias("whole")).first()
        assert most["n"] < n / 20 and most["tasks"] == 4 and most["whole"] > 7000
        area = spatial.covered_cells(df, "g", 0.5)
        tasks = area.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
        assert len(tasks) == 4 and abs(sum(r["count"] for r in tasks) * 0.25 - math.pi * 1e4 * 1.01) < 100
        plan = area._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Window") < plan.index("Generate explode(flatten")  # edges leave their shape before they are paired
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_radius_search_is_whole_anywhere_on_the_globe(spark):
    """Poles, the date line and wide circles against every pair."""
    rng = random.Random(11)
    spots = [(90.0, 0.0), (-90.0, 10.0), (89.95, 170.0), (89.95, -10.0), (0.0, 180.0), (0.0, -180.0), (45.0, 179.99), (45.0, -179.99), (-60.0, -180.0), (0.0, 0.0)]
    points = [(i, *p) for i, p in enumerate(spots + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(rng.choice([-1, 1]) * rng.uniform(85, 90), rng.uniform(-180, 180)) for _ in range(60)])]
    centers = [(i, *p) for i, p in enumerate(spots + [(rng.uniform(-90, 90), rng.choice([-1, 1]) * rng.uniform(170, 180)) for _ in range(20)])]
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    c = spark.createDataFrame(centers, "c long, clat double, clon double")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    pairs = p.crossJoin(c).withColumn("km", km).collect()
    for radius in (5.0, 50.0, 700.0, 5000.0, 12000.0):
        want = sorted((r.c, r.id) for r in pairs if r.km <= radius)
        got = sorted((r.c, r.id) for r in spatial.within_radius(p, c, "lat", "lon", "clat", "clon", radius).collect())
        assert got == want, radius
