"""School census, infrastructure, published indicators and their control totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import bit_flag, tri_any, with_number
from ..functions.text import is_digits, relabel
from ..operators import aggregates, joins, mapping, quality, sets
from ..sources.delimited import family_to_rows

# fixed values: code lists and source columns of the census
NETWORKS = {"1": "Federal", "2": "Estadual", "3": "Municipal", "4": "Privada"}
LOCATIONS = {"1": "Urbana", "2": "Rural"}
ENROLMENTS = {
    "total": "QT_MAT_BAS", "infant": "QT_MAT_INF", "nursery": "QT_MAT_INF_CRE", "preschool": "QT_MAT_INF_PRE", "fundamental": "QT_MAT_FUND",
    "initial": "QT_MAT_FUND_AI", "final": "QT_MAT_FUND_AF", "secondary": "QT_MAT_MED", "professional": "QT_MAT_PROF", "eja": "QT_MAT_EJA",
    "special": "QT_MAT_ESP", "fullTime": "QT_MAT_BAS_INT",
}
STAFF = {"teachingPosts": "QT_DOC_BAS", "classes": "QT_TUR_BAS"}
RESOURCES = {
    "water": ("IN_AGUA_POTAVEL",), "electricity": ("IN_ENERGIA_REDE_PUBLICA",), "sewage": ("IN_ESGOTO_REDE_PUBLICA",),
    "internet": ("IN_INTERNET",), "studentInternet": ("IN_INTERNET_ALUNOS",), "broadband": ("IN_BANDA_LARGA",),
    "computers": ("IN_LABORATORIO_INFORMATICA",), "library": ("IN_BIBLIOTECA", "IN_SALA_LEITURA"), "sports": ("IN_QUADRA_ESPORTES",),
    "accessibility": ("IN_ACESSIBILIDADE_INEXISTENTE",), "food": ("IN_ALIMENTACAO",),
}
INVERTED = ("accessibility",)
SUBSTAGES = (("infant", "nursery", "preschool"), ("fundamental", "initial", "final"))
MISSING = ("--", "-", "ND", "*", "**", "***", "..", "...")


def schools(raw: DataFrame, key: str = "CO_ENTIDADE") -> DataFrame:
    """One row per school: identical copies folded, typed counts and flags; ``conflict`` marks differing copies."""
    one = sets.dedup(raw, [key])
    counts = {**ENROLMENTS, **STAFF}
    has = [c for c in one.columns]
    typed = [
        F.col(field).try_cast("bigint").alias(name) if field in has else F.lit(None).cast("bigint").alias(name) for name, field in counts.items()
    ]
    flags = []
    for name, fields in RESOURCES.items():
        any_ = tri_any(*[bit_flag(F.col(f)) if f in has else F.lit(None).cast("boolean") for f in fields])
        flags.append((~any_ if name in INVERTED else any_).alias(name))
    declared = [bit_flag(F.col(f)) for f in ("IN_REGULAR", "IN_EJA", "IN_PROF") if f in has] or [F.lit(False)]
    active, total = F.col("TP_SITUACAO_FUNCIONAMENTO") == "1", F.col("QT_MAT_BAS").try_cast("bigint")
    return one.select(
        F.col(key).alias("school"), F.col("CO_MUNICIPIO").alias("territory"), F.col("NU_ANO_CENSO").alias("year"),
        mapping.classify(F.col("TP_DEPENDENCIA"), NETWORKS).alias("network"), mapping.classify(F.col("TP_LOCALIZACAO"), LOCATIONS).alias("location"),
        mapping.universe(active, total).alias("in_universe"), mapping.universe_problem(active, total, *declared).alias("problem"), "conflict", *typed, *flags)


def school_violations(typed: DataFrame) -> DataFrame:
    return quality.rules(typed, ["school"], {
        "school code": is_digits(F.col("school"), 8), "network": F.col("network").isNotNull(), "location": F.col("location").isNotNull(),
        "copies agree": ~F.col("conflict"), "declared without measure": F.col("problem").isNull()})


def series(typed: DataFrame) -> DataFrame:
    """Per territory, year and network (and ``Total``): enrolments, posts, classes, schools by location.

    A measure with one school missing is missing as a whole.
    """
    measures = (*ENROLMENTS, *STAFF)
    places = [f"schools_{v.lower()}" for v in LOCATIONS.values()]
    sums = [F.count(F.lit(1)).alias("active_schools")]
    sums += [f(F.col(c)).alias(f"{n}{c}") for c in measures for n, f in (("_s_", F.sum), ("_k_", F.count))]
    sums += [F.count_if(F.col("location") == v).alias(p) for v, p in zip(LOCATIONS.values(), places, strict=True)]
    whole = [F.when(F.col(f"_k_{c}") == F.col("active_schools"), F.col(f"_s_{c}")).alias(c) for c in measures]
    return aggregates.with_total(typed.filter("in_universe"), ["territory", "year"], "network", sums, [F.col("active_schools"), *whole, *map(F.col, places)])


def stage_violations(series_: DataFrame) -> DataFrame:
    """Sub-stages must add up to their stage wherever all three are known."""
    checks = {}
    for whole, a, b in SUBSTAGES:
        known = F.col(whole).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
        checks[f"{whole} = {a} + {b}"] = ~known | (F.col(whole) == F.col(a) + F.col(b))
    return quality.rules(series_, ["territory", "year", "network"], checks)


def infrastructure(typed: DataFrame) -> DataFrame:
    """Share of schools with each resource among those that answered."""
    long = typed.filter("in_universe").unpivot(["territory", "year", "network"], list(RESOURCES), "resource", "has")
    keyed = ["territory", "year", "resource"]
    yes, known = F.col("with_resource"), F.col("considered")
    return aggregates.with_total(
        long, keyed, "network", aggregates.known_share(F.col("has"))[:3],
        [yes, known, F.col("missing"), F.when(known > 0, yes / known * 100).alias("percent")])


def indicators(
    sheet: DataFrame, ids: Sequence[str], pattern: str, dims: Sequence[str], unit: str, upper: float | None, network: str,
) -> DataFrame:
    """Published indicator columns (a family named by stage and group) to rows with network labels."""
    # fixed values: publication names of combined networks
    exact = {
        "Total - Estadual E Municipal": "Estadual e Municipal", "Total - Federal, Estadual E Municipal": "Pública",
        "Total - Federal, Estadual, Municipal E Privada": "Total", "Municipal": "Municipal", "Estadual": "Estadual", "Federal": "Federal",
    }
    label = relabel(F.col(network), exact, (("Total", "Total"), ("Pública", "Pública"), ("Privada", "Privada")))
    rows = family_to_rows(sheet.withColumn(network, label), ids, pattern, dims, "raw")
    return with_number(rows, "raw", missing=MISSING, comma=True, upper=upper).withColumn("unit", F.lit(unit)).drop("raw")


def reconciled(series_: DataFrame, controls: DataFrame) -> DataFrame:
    """Computed totals against the official synopsis (``territory, year, network, kind, value``), tolerance zero."""
    computed = series_.unpivot(["territory", "year", "network"], ["total", "active_schools", "classes"], "kind", "value")
    names: Mapping[str, str] = {"total": "enrolments", "active_schools": "schools", "classes": "classes"}
    kind = mapping.classify(F.col("kind"), names)
    return joins.reconcile(computed.withColumn("kind", kind), controls, ["territory", "year", "network", "kind"]).filter(F.col("official").isNotNull())
