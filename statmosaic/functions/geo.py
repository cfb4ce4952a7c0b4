"""Geometry as arrays: a ring is ``array<array<double>>`` of [lon, lat], a polygon an array
of rings (outer first, then holes), a multi-polygon an array of polygons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = (
        F.pow(F.sin(F.radians(lat1 - lat2) / 2), 2)
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring."""
    n = F.size(ring)
    heads = F.slice(ring, F.lit(1), n - 1)
    tails = F.slice(ring, F.lit(2), n - 1)
    return F.zip_with(heads, tails, lambda a, b: F.struct(
        a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))


def edges(multi: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """The same nesting with edges in place of vertices; prepare it once per shape, not per point."""
    ring = lambda r: F.filter(_edges(r), keep) if keep else _edges(r)
    return F.transform(multi, lambda p: F.transform(p, ring))


def crossing_x(e: Column, y: Column) -> Column:
    """Where an edge meets the horizontal line at ``y``."""
    return F.coalesce(F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]), F.lit(0.0)) + e["ax"]


def straddles(e: Column, y: Column) -> Column:
    return (e["ay"] > y) != (e["by"] > y)


def _odd(x: Column, y: Column, ring_edges: Column) -> Column:
    """Ray casting: an odd number of crossings is inside."""
    return F.aggregate(
        ring_edges, F.lit(False), lambda inside, e: inside != (straddles(e, y) & (x < crossing_x(e, y)))
    )


def _touches(x: Column, y: Column, ring_edges: Column, eps: float) -> Column:
    """Does the point lie on one of the edges?"""
    return F.exists(
        ring_edges,
        lambda e: (
            F.abs((e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])) <= F.lit(eps)
        )
        & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )


def _holes(polygon: Column) -> Column:
    return F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0)))


def in_edges(x: Column, y: Column, edged: Column) -> Column:
    """Inside one polygon's outer ring and outside its holes, on prepared :func:`edges`."""
    return F.exists(edged, lambda p: _odd(x, y, p[0]) & ~F.exists(_holes(p), lambda h: _odd(x, y, h)))


def on_edges(x: Column, y: Column, edged: Column, eps: float = 1e-12) -> Column:
    return F.exists(edged, lambda p: F.exists(p, lambda r: _touches(x, y, r, eps)))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    return _odd(x, y, _edges(ring))


def in_geometry(x: Column, y: Column, multi: Column) -> Column:
    return in_edges(x, y, edges(multi))


def covers(x: Column, y: Column, multi: Column) -> Column:
    """Inside or on any boundary line."""
    return in_geometry(x, y, multi) | on_edges(x, y, edges(multi))


def vertices(multi: Column) -> Column:
    return F.flatten(F.flatten(multi))


def bbox(multi: Column) -> Column:
    v = vertices(multi)
    xs, ys = F.transform(v, lambda p: p[0]), F.transform(v, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def pad_bbox(box: Column, pad: float) -> Column:
    return F.struct(
        (box["min_x"] - pad).alias("min_x"), (box["min_y"] - pad).alias("min_y"),
        (box["max_x"] + pad).alias("max_x"), (box["max_y"] + pad).alias("max_y"),
    )


def in_box(x: Column, y: Column, box: Column) -> Column:
    return x.between(box["min_x"], box["max_x"]) & y.between(box["min_y"], box["max_y"])


def _ring_moments(ring: Column) -> Column:
    """Twice the signed area, and six times the first moments, about the ring's first vertex."""
    ox, oy = ring[0][0], ring[0][1]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"] - ox, e["ay"] - oy, e["bx"] - ox, e["by"] - oy
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (ax + bx) * cross).alias("mx"),
            (acc["my"] + (ay + by) * cross).alias("my"),
        )

    return F.aggregate(_edges(ring), zero, add)


def ring_area(ring: Column) -> Column:
    return F.abs(_ring_moments(ring)["a"]) / 2


def polygon_area(polygon: Column) -> Column:
    return ring_area(polygon[0]) - F.aggregate(_holes(polygon), F.lit(0.0), lambda acc, h: acc + ring_area(h))


def centroid(multi: Column) -> Column:
    """Area-weighted centroid, holes subtracted; ``struct(x, y)``."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"))

    def add_ring(acc: Column, ring: Column, sign: Column) -> Column:
        m = _ring_moments(ring)
        w = F.abs(m["a"]) * sign
        cx = ring[0][0] + F.coalesce(F.try_divide(m["mx"], m["a"] * 3), F.lit(0.0))
        cy = ring[0][1] + F.coalesce(F.try_divide(m["my"], m["a"] * 3), F.lit(0.0))
        return F.struct(
            (acc["w"] + w).alias("w"), (acc["sx"] + w * cx).alias("sx"), (acc["sy"] + w * cy).alias("sy")
        )

    signed = F.flatten(F.transform(multi, lambda p: F.transform(
        p, lambda r, i: F.struct(r.alias("ring"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")))))
    total = F.aggregate(signed, zero, lambda acc, s: add_ring(acc, s["ring"], s["sign"]))
    return F.struct(
        F.try_divide(total["sx"], total["w"]).alias("x"), F.try_divide(total["sy"], total["w"]).alias("y")
    )


def geometry_error(multi: Column, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """Why a geometry is invalid: open or short ring, non-finite vertex, outside the extent."""
    rings = F.flatten(multi)
    bad_number = F.exists(vertices(multi), lambda p: F.exists(
        p, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))
    outside = F.exists(vertices(multi), lambda p: ~(p[0].between(min_x, max_x) & p[1].between(min_y, max_y)))
    return (
        F.when(multi.isNull() | (F.size(multi) == 0), "empty")
        .when(F.exists(rings, lambda r: F.size(r) < 4), "short ring")
        .when(bad_number, "non-finite vertex")
        .when(F.exists(rings, lambda r: r[0] != F.element_at(r, -1)), "open ring")
        .when(outside, "outside extent")
    )


def coordinates_agree(x: Column, y: Column, attr_x: Column, attr_y: Column, eps: float = 1e-4) -> Column:
    return (F.abs(x - attr_x) <= eps) & (F.abs(y - attr_y) <= eps)
