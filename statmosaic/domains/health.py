"""Registry of health units and hospital beds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import strict_number, tri_flag
from ..functions.periods import is_month
from ..functions.text import is_year_month, join_nonblank, pad_code
from ..operators import aggregates, joins, mapping, quality, sets, spatial

# fixed values: management codes, unit-type groups and legal natures
MANAGEMENT = {"M": "Municipal", "E": "Estadual", "D": "Dupla", "S": "Sem gestão"}
URGENT_TYPES = ("20", "21", "42", "73", "76")
HOSPITAL_TYPES = ("05", "07", "62")
OWNERSHIP_EXACT = {"2011": "Pública", "2038": "Economia mista"}
OWNERSHIP_PREFIX = (("1", "Pública"), ("2", "Privada"), ("3", "Sem fins lucrativos"), ("4", "Privada"))


def registry(raw: DataFrame, crosswalk: DataFrame, types: DataFrame, address: Sequence[str] = ()) -> DataFrame:
    """One row per unit of the crosswalk's territories, typed and classified.

    Ownership follows the legal nature, never the management.  ``conflict`` marks units
    whose copies differ, ``state_ok`` a code found in another state.
    """
    lat, lon = strict_number(F.col("NU_LATITUDE")), strict_number(F.col("NU_LONGITUDE"))
    usable = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    rows = mapping.located(raw, crosswalk, "CO_IBGE", "CO_UF").select(
        pad_code(F.col("CO_CNES"), 7).alias("unit"), "territory", "state_ok", F.trim("NO_FANTASIA").alias("name"),
        pad_code(F.regexp_replace("TP_UNIDADE", r"\.0$", ""), 2).alias("code"), F.trim("CO_NATUREZA_JUR").alias("legal"),
        F.coalesce(mapping.classify(F.trim("TP_GESTAO"), MANAGEMENT), F.lit("Não informada")).alias("management"),
        F.when(F.trim("CO_NATUREZA_JUR") != "", mapping.classify(F.trim("CO_NATUREZA_JUR"), OWNERSHIP_EXACT, OWNERSHIP_PREFIX)).alias("ownership"),
        (F.coalesce(F.trim("CO_MOTIVO_DESAB"), F.lit("")) == "").alias("active"), tri_flag(F.col("CO_AMBULATORIAL_SUS")).alias("ambulatory"),
        F.when(usable, lat).alias("latitude"), F.when(usable, lon).alias("longitude"),
        join_nonblank(", ", *[F.col(a) for a in address]).alias("address"),
    )
    labelled = joins.label_strict(sets.dedup(rows, ["unit", "territory"]), types, "code")
    return labelled.withColumns({
        "ownership": F.coalesce("ownership", F.lit("Não informada")), "urgent": F.col("code").isin(*URGENT_TYPES),
        "hospital": F.col("code").isin(*HOSPITAL_TYPES),
    })


def violations(units: DataFrame) -> DataFrame:
    return quality.rules(units, ["territory", "unit"], {
        "unit code": F.col("unit").isNotNull() & (F.col("unit") != "0000000"), "type known": F.col("label").isNotNull(), "copies agree": ~F.col("conflict"),
        "state agrees": F.col("state_ok"), "named": F.coalesce(F.col("name"), F.lit("")) != "",
        "legal nature": F.col("legal").isNull() | F.col("legal").rlike(r"^(\d{4})?$")})


def summary(units: DataFrame) -> DataFrame:
    """Counts per territory; the ambulatory share is over units that answered."""
    active = F.col("active")
    yes, no = F.count_if(active & F.col("ambulatory")), F.count_if(active & ~F.col("ambulatory"))
    return units.groupBy("territory").agg(
        F.count(F.lit(1)).alias("registered"), F.count_if(active).alias("active"), F.count_if(active & (F.col("ownership") == "Pública")).alias("public"),
        F.count_if(active & F.col("hospital")).alias("hospitals"), F.count_if(active & F.col("urgent")).alias("urgent"),
        yes.alias("ambulatory"), F.when(yes + no > 0, yes / (yes + no) * 100).alias("ambulatory_percent"))


def groups(units: DataFrame, by: str) -> DataFrame:
    return aggregates.frequency(units.filter("active"), ["territory"], by)


def beds(raw: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Hospital-month capacity; a disabled hospital is not counted."""
    whole = lambda c: strict_number(F.col(c), type_="decimal(18,2)").cast("bigint")
    rows = mapping.located(raw, crosswalk, "CO_IBGE", "UF").filter(F.coalesce(F.trim("MOTIVO_DESABILITACAO"), F.lit("")) == "")
    return sets.dedup(rows.select(
        "territory", F.trim("COMP").alias("month"), pad_code(F.col("CNES"), 7).alias("unit"), "state_ok", whole("LEITOS_EXISTENTES").alias("existing"),
        whole("LEITOS_SUS").alias("sus"), whole("UTI_TOTAL_EXIST").alias("icu_existing"), whole("UTI_TOTAL_SUS").alias("icu_sus")), ["territory", "month", "unit"])


def bed_violations(rows: DataFrame) -> DataFrame:
    return quality.rules(rows, ["territory", "month", "unit"], {
        "month": is_year_month(F.col("month")), "state agrees": F.col("state_ok"), "copies agree": ~F.col("conflict"), "counts present": F.col("existing") >= 0,
        "public within all": (F.col("sus") <= F.col("existing")) & (F.col("icu_sus") <= F.col("icu_existing"))})


def months_in(raw: DataFrame) -> list[str]:
    """Months a bed file reports on, first to last as far as they can be read; the span is reduced in the job."""
    month = F.when(is_month(F.trim("COMP")), F.trim("COMP"))
    seen = raw.select(month.alias("month")).where("month IS NOT NULL").groupBy("month").count().groupBy().agg(F.array_sort(F.collect_set("month")).alias("m"))
    return list(seen.first()["m"])


def bed_series(rows: DataFrame, months: Sequence[str], territories: DataFrame) -> DataFrame:
    """Capacity per territory and every month of the whole file: absence there is a confirmed zero."""
    spine = sets.expected_cells(territories.select("territory"), {"month": months})
    return aggregates.capacity(rows, spine, ["territory", "month"], ["existing", "sus", "icu_existing", "icu_sus"])


def mappable(units: DataFrame, boundaries: DataFrame, cell: float = 0.25) -> DataFrame:
    """Active units whose point lies inside their own territory's boundary (``territory, geometry``)."""
    points = units.filter("active AND latitude IS NOT NULL").select("unit", "territory", "latitude", "longitude")
    return spatial.points_in_shapes(points, boundaries, "longitude", "latitude", "geometry", cell, on=["territory"]).select("territory", "unit")
