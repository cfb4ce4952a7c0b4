"""Nested publications: statistical cubes, keyed indicators, paged documents, GeoJSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import decode_symbol
from ..operators.quality import violations

CUBE_SCHEMA = (
    "array<struct<id string, variavel string, unidade string, resultados array<struct<"
    "classificacoes array<struct<id string, nome string, categoria map<string,string>>>,"
    "series array<struct<localidade struct<id string, nivel struct<id string, nome string>, nome string>,"
    "serie map<string,string>>>>>>>"
)
KEYED_SCHEMA = "array<struct<id bigint, res array<struct<localidade string, res map<string,string>>>>>"
HIERARCHY_SCHEMA = (
    "array<struct<id bigint, indicador string, unidade struct<id string, multiplicador double>,"
    " children array<struct<id bigint, indicador string, unidade struct<id string, multiplicador double>>>>>"
)


def _one_category(result: Column) -> Column:
    """Every classification of a result names exactly one category."""
    return F.forall(result["classificacoes"], lambda k: F.coalesce(F.size(k["categoria"]) == 1, F.lit(False)))


def cube_violations(docs: DataFrame, keys: Sequence[str], body: str = "body", gate: str = "cube") -> DataFrame:
    """What :func:`cube_cells` leaves out: unreadable responses, and results that mix categories."""
    parsed = docs.withColumn("_v", F.from_json(body, CUBE_SCHEMA))
    mixed = F.size(F.filter(F.flatten(F.transform("_v", lambda v: v["resultados"])), lambda r: ~F.coalesce(_one_category(r), F.lit(False))))
    problem = F.when(F.col("_v").isNull() | F.exists("_v", lambda v: v["id"].isNull() | v["resultados"].isNull()), "unreadable response").when(
        mixed > 0, F.concat(mixed.cast("string"), F.lit(" results of several categories")))
    return violations(parsed.withColumn("_p", problem).filter(F.col("_p").isNotNull()), gate, keys, F.col("_p"))


def cube_cells(docs: DataFrame, body: str = "body", dash: str = "zero") -> DataFrame:
    """Flatten cube responses: one row per published cell, dimensions as a map.

    A result that names several categories has no cell of its own; :func:`cube_violations` lists it.
    """
    v = docs.select("*", F.explode(F.from_json(body, CUBE_SCHEMA)).alias("_v")).drop(body)
    r = v.select("*", F.explode("_v.resultados").alias("_r")).filter(_one_category(F.col("_r")))
    dims = F.map_from_entries(
        F.transform("_r.classificacoes", lambda k: F.struct(k["id"], F.map_keys(k["categoria"])[0]))
    )
    s = r.select("*", dims.alias("dims"), F.explode("_r.series").alias("_s"))
    p = s.select("*", F.explode("_s.serie").alias("period", "published"))
    cell = decode_symbol(F.col("published"), dash)
    keep = [c for c in docs.columns if c != body]
    return p.select(
        *keep,
        F.col("_s.localidade.id").alias("territory"),
        F.col("_s.localidade.nivel.id").alias("level"),
        F.col("_v.id").alias("variable"),
        F.col("_v.variavel").alias("variable_name"),
        F.col("_v.unidade").alias("unit"),
        "dims", "period", "published",
        cell["value"].alias("value"), cell["status"].alias("status"), cell["raw"].alias("raw"),
    )


def dims_key(dims: Column) -> Column:
    """Comparable text of a dimension map."""
    return F.concat_ws(
        "|", F.transform(F.array_sort(F.map_entries(dims)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )


def keyed_series(docs: DataFrame, body: str = "body") -> DataFrame:
    """``id -> res[] -> {period: value}`` to rows."""
    a = docs.select("*", F.explode(F.from_json(body, KEYED_SCHEMA)).alias("a")).drop(body)
    r = a.select("*", F.explode("a.res").alias("r"))
    keep = [c for c in docs.columns if c != body]
    return r.select(
        *keep, F.col("a.id").alias("indicator"), F.col("r.localidade").alias("territory"),
        F.explode("r.res").alias("period", "published"),
    )


def confirmed_by_parent(rows: DataFrame, hierarchy: DataFrame, concept: str, unit: str, multiplier: float = 1.0) -> DataFrame:
    """Rows whose indicator is a child of the parent named ``concept``, in that unit.

    A leaf name alone (``revised series``) does not say what is measured.
    """
    h = hierarchy.select(F.explode(F.from_json("body", HIERARCHY_SCHEMA)).alias("h"))
    child = (
        h.filter(F.col("h.indicador") == concept)
        .select(F.explode("h.children").alias("c"))
        .filter((F.col("c.unidade.id") == unit) & (F.col("c.unidade.multiplicador") == multiplier))
        .select(F.col("c.id").alias("indicator"))
        .distinct()
    )
    return rows.join(child, "indicator", "left_semi")


def latest_published(rows: DataFrame, value: Column) -> DataFrame:
    """Value at the largest period of each (indicator, territory)."""
    return rows.groupBy("indicator", "territory").agg(
        F.max("period").alias("reference"), F.max_by(value, F.col("period")).alias("value")
    )


def paged_documents(docs: DataFrame, doc_schema: str, body: str = "body") -> DataFrame:
    """Response pages with a declared total: one row per document plus ``declared, received``.

    A page without a document keeps one row.  A page that cannot be read declares null and received 0:
    gate with ``declared_total(pages, keys, "declared", "received")``.
    """
    schema = f"struct<numFound: bigint, docs: array<{doc_schema}>>"
    p = docs.withColumn("_p", F.from_json(body, schema)).drop(body)
    return p.select(
        "*", F.col("_p.numFound").alias("declared"), F.greatest(F.coalesce(F.size("_p.docs"), F.lit(0)), F.lit(0)).cast("bigint").alias("received"),
        F.explode_outer("_p.docs").alias("doc"),
    ).drop("_p")


def geojson_features(docs: DataFrame, properties: str, body: str = "body") -> DataFrame:
    """Features of collections; ``complete`` is false for an error, a transfer limit or a missed declared number.

    Every feature is kept, of incomplete collections too; gate with :func:`feature_violations`.
    """
    schema = (
        f"struct<error: string, exceededTransferLimit: boolean, numberMatched: bigint, features: array<struct<"
        f"geometry: struct<type: string, coordinates: string>, properties: {properties}>>>"
    )
    p = docs.withColumn("_g", F.from_json(body, schema)).drop(body)
    complete = (
        F.col("_g.error").isNull()
        & ~F.coalesce(F.col("_g.exceededTransferLimit"), F.lit(False))
        & F.coalesce(F.size("_g.features") >= 0, F.lit(False))
        & F.coalesce(F.col("_g.numberMatched") == F.size("_g.features"), F.lit(True))
    )
    f = p.select("*", complete.alias("complete"), F.explode_outer("_g.features").alias("f")).drop("_g")
    return f.select("*", F.col("f.geometry.type").alias("geometry_type"),
                    F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")).drop("f")


def feature_violations(features: DataFrame, keys: Sequence[str], gate: str = "transfer") -> DataFrame:
    """Collections that did not come whole, once each."""
    return violations(features.filter(~F.col("complete")).select(*keys).distinct(), gate, keys, "incomplete collection")


def point_of(coordinates: Column) -> Column:
    xy = F.from_json(coordinates, "array<double>")
    return F.struct(xy[0].alias("x"), xy[1].alias("y"))


def multi_polygon_of(kind: Column, coordinates: Column) -> Column:
    """Polygon or MultiPolygon text as one nested array shape."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def feature_text(kind: Column, coordinates: Column, properties: Column) -> Column:
    """GeoJSON feature of a geometry, ready for a text sink."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"),
        F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    ))
