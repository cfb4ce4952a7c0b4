"""Land cover, fire detections, gauge stations and protected areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import km2_to_ha, per_1000_km2
from ..functions.text import mentions, pad_code
from ..operators import aggregates, joins, quality, ranking, sets, spatial, windows
from ..sources.delimited import family_to_rows

# fixed values: classes counted as native vegetation, and the single-class groups
NATIVE_CLASSES = (3, 4, 5, 6, 7, 49, 11, 12, 77, 84, 50)
GROUP_PREFIX = {"forest": "1.", "farming": "3.", "agriculture": "3.2."}
GROUP_CODES = {"native": NATIVE_CLASSES, "plantation": (9,), "urban": (24,), "water": (33,), "pasture": (15,)}


def land_cover(wide: DataFrame, legend: DataFrame, area: DataFrame) -> DataFrame:
    """Wide yearly columns to hectares per class, with path and share of the territory (``territory, km2``)."""
    long = family_to_rows(wide, ["territory", "biome", "class"], r"y(\d{4})", ["year"], "ha").join(legend, "class", "left")
    panel = aggregates.class_panel(long, ["territory"], "class", "path", "year", "ha")
    return panel.join(area, "territory", "left").withColumn("share", F.col("ha") / km2_to_ha(F.col("km2")) * 100)


def land_history(panel: DataFrame) -> DataFrame:
    """Overlapping groups per year; ``farming_without_plantation`` leaves planted forest out."""
    unplanted = F.col("path").startswith(GROUP_PREFIX["farming"]) & ~F.col("class").isin(*GROUP_CODES["plantation"])
    return aggregates.semantic_groups(
        panel, ["territory", "year"], "class", "path", "ha", GROUP_PREFIX, GROUP_CODES, {"farming_without_plantation": unplanted})


def land_violations(panel: DataFrame) -> DataFrame:
    """Every class in the legend; mapped area within 2 % of the territory in every year."""
    total = panel.groupBy("territory", "year").agg(F.sum("ha").alias("mapped"), F.max("km2").alias("km2"))
    return quality.rules(panel, ["territory", "class"], {"legend": F.col("path").isNotNull()}).unionByName(
        quality.identity(total, ["territory", "year"], F.col("mapped"), km2_to_ha(F.col("km2")), relative=0.02, gate="mapped area"))


def land_change(history: DataFrame, group: str, start: str, end: str) -> DataFrame:
    return windows.between_periods(history, ["territory"], "year", group, start, end)


def detections(observations: DataFrame) -> DataFrame:
    """One row per detection id (``id, territory, observed_at, reference``).

    A complete annual archive replaces all monthly extracts of its year; ``conflict`` marks ids
    that differ between the remaining files.
    """
    year = F.substring("reference", 1, 4)
    rows = observations.withColumn("year", year)
    annual, monthly = rows.filter(F.length("reference") == 4), rows.filter(F.length("reference") != 4)
    kept = annual.unionByName(joins.superseded(monthly, annual.select("year")).select(*annual.columns))
    return sets.dedup(kept.drop("reference", "year"), ["id"]).withColumn(
        "month", F.concat(F.substring("observed_at", 1, 4), F.substring("observed_at", 6, 2)))


def coverage(references: DataFrame) -> DataFrame:
    """Months covered by the files that were read (``reference`` is a year or a month)."""
    whole = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.concat(F.col("reference"), F.lpad(m.cast("string"), 2, "0")))
    return references.select(F.explode(F.when(F.length("reference") == 4, whole).otherwise(F.array("reference"))).alias("month")).distinct()


def fire_months(found: DataFrame, covered: DataFrame, territories: DataFrame, start: str, end: str) -> DataFrame:
    spine = windows.month_spine(territories.select("territory"), start, end)
    return aggregates.covered_counts(found, spine, covered, ["territory"], "month")


def fire_years(months: DataFrame, area: DataFrame, current_year: str) -> DataFrame:
    """Yearly counts per 1,000 km2; the running year is never complete."""
    y = aggregates.annual_coverage(months, ["territory"], F.substring("month", 1, 4))
    return y.join(area, "territory", "left").withColumns({
        "complete": F.col("complete") & (F.col("year") != current_year), "per_1000_km2": per_1000_km2(F.col("count"), F.col("km2")),
    }).drop("km2")


def stations(points: DataFrame, boundaries: DataFrame, centers: DataFrame, radius_km: float = 50.0, k: int = 10, cell: float = 0.25) -> DataFrame:
    """Stations inside (boundary included), then the ``k`` nearest within the radius of the centroid.

    ``points(code, lat, lon)``, ``boundaries(territory, geometry)``, ``centers(territory, clat, clon)``.
    """
    p = points.withColumn("code", pad_code(F.col("code"), 8))
    inside = spatial.points_in_shapes(p, boundaries, "lon", "lat", "geometry", cell, inclusive=True)
    # those inside do not use up places among the nearest
    near = spatial.within_radius(p, centers, "lat", "lon", "clat", "clon", radius_km).join(inside.select("territory", "code"), ["territory", "code"], "left_anti")
    nearest = ranking.smallest_k(near, ["territory"], [F.asc("distance_km"), F.asc("code")], k)
    return spatial.inside_then_nearest(inside, nearest, ["territory"], "code")


def protected_areas(units: DataFrame, boundaries: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(area per unit and territory, union per territory) on an equal-area grid of side ``cell``.

    ``units(unit, geometry)`` and ``boundaries(territory, geometry)`` in one projected plane.
    """
    u, b = spatial.covered_cells(units, "geometry", cell), spatial.covered_cells(boundaries, "geometry", cell)
    side = cell * cell
    return spatial.clip_area(u, b, ["unit"], ["territory"], side), spatial.union_area(u, b, ["territory"], side)


def listed_in(units: DataFrame, column: str, name: str, state: str) -> DataFrame:
    return units.withColumn("listed", mentions(F.col(column), name, state))
