"""Social registry, benefits and services, under disclosure control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import ratio
from ..functions.periods import month_ordinal
from ..operators import aggregates, disclosure, mapping, quality, sets, windows
from ..session import attach_group
from ..sources.delimited import ContractError

# fixed values: measures of the monthly table, block by block: public name, source field, unit, kind
REGISTRY_MEASURES = (
    ("families", "cadun_qtd_familias_cadastradas_i", "famílias", "count"),
    ("people", "cadun_qtd_pessoas_cadastradas_i", "pessoas", "count"),
    ("updated", "cadun_qtd_familias_atualizadas_i", "famílias", "count"),
    ("updatedPercent", "cadun_taxa_atualizacao_cadastral_d", "%", "percent"),
    ("povertyFamilies", "cadun_qtd_familias_cadastradas_pobreza_pbf_i", "famílias", "count"),
    ("lowIncomeFamilies", "cadun_qtd_familias_cadastradas_baixa_renda_i", "famílias", "count"),
    ("aboveHalfFamilies", "cadun_qtd_familias_cadastradas_rfpc_acima_meio_sm_i", "famílias", "count"),
    ("povertyPeople", "cadun_qtd_pessoas_cadastradas_pobreza_pbf_i", "pessoas", "count"),
    ("lowIncomePeople", "cadun_qtd_pessoas_cadastradas_baixa_renda_i", "pessoas", "count"),
    ("aboveHalfPeople", "cadun_qtd_pessoas_cadastradas_rfpc_acima_meio_sm_i", "pessoas", "count"),
)
TRANSFER_MEASURES = (
    ("families", "qtd_familias_beneficiarias_bolsa_familia", "famílias", "count"),
    ("people", "qtd_pessoas_beneficiarias_bolsa_familia_i", "pessoas", "count"),
    ("transferredValue", "valor_repassado_bolsa_familia", "R$", "money"),
    ("averageBenefit", "pbf_vlr_medio_benef_f", "R$", "money"),
)
BENEFIT_MEASURES = (
    ("total", "bpc_ben_i", "benefícios", "count"),
    ("elderly", "bpc_idoso_ben_i", "benefícios", "count"),
    ("disabled", "bpc_pcd_ben_i", "benefícios", "count"),
    ("elderlyValue", "bpc_idoso_val_s", "R$", "money"),
    ("disabledValue", "bpc_pcd_val_s", "R$", "money"),
    ("transferredValue", "bpc_val_s", "R$", "money"),
)
# fixed values: units that count persons, and the first month of the present benefit rules
PERSON_UNITS = ("famílias", "pessoas", "benefícios", "atendimentos")
REGIME_START = "202303"

REGISTRY, TRANSFER, BENEFIT = ({name: field for name, field, _, _ in block} for block in (REGISTRY_MEASURES, TRANSFER_MEASURES, BENEFIT_MEASURES))
MEASURES = {name: (unit, kind) for block in (REGISTRY_MEASURES, TRANSFER_MEASURES, BENEFIT_MEASURES) for name, _, unit, kind in block}


def _full(fields: Mapping[str, str]) -> Column:
    full = F.lit(True)
    for f in fields.values():
        full = full & F.col(f).isNotNull()
    return full


def latest_month(raw: DataFrame, fields: Mapping[str, str], earliest: str = REGIME_START) -> DataFrame:
    """Latest month per territory in which every field of the block was published."""
    return raw.filter(_full(fields) & (F.col("anomes_s") >= earliest)).groupBy("codigo_ibge").agg(F.max("anomes_s").alias("reference"))


def block(raw: DataFrame, fields: Mapping[str, str], months: int = 24, whole_rows: bool = False, earliest: str = REGIME_START) -> DataFrame:
    """Measures of the last ``months`` calendar months up to each territory's reference.

    Gaps in the calendar stay gaps.  ``whole_rows`` blanks a month in which one field is missing.
    Primary suppression is already applied: ``territory, month, reference, measure, unit, value, status, error``.
    """
    age = month_ordinal(F.col("reference")) - month_ordinal(F.col("anomes_s"))
    # a territory has one row per month, so its group is as long as the calendar
    latest = F.max(F.when(_full(fields), F.col("anomes_s")))
    dated = attach_group(raw.filter(F.col("anomes_s") >= earliest), ["codigo_ibge"], {"reference": latest}, bounded=True)
    rows = dated.filter((age >= 0) & (age < months))
    if whole_rows:
        rows = rows.withColumns({f: F.when(_full(fields), F.col(f)) for f in fields.values()})
    keyed = rows.select(F.col("codigo_ibge").alias("territory"), F.col("anomes_s").alias("month"), "reference", *fields.values())
    long = mapping.mapped_measures(keyed, ["territory", "month", "reference"], fields, {n: MEASURES[n] for n in fields})
    return disclosure.suppress_primary(long.withColumn("status", F.lit("real")), "value", "unit", "status", PERSON_UNITS)


def protect_income(rows: DataFrame) -> DataFrame:
    """Income bands protect each other, separately for families and for people."""
    band = F.regexp_extract("measure", r"^(?:poverty|lowIncome|aboveHalf)(Families|People)$", 1)
    grouped = rows.withColumn("_band", F.when(band != "", band).otherwise(F.col("measure")))
    return disclosure.suppress_siblings(grouped, ["territory", "month", "_band"], ["value"], "status").drop("_band")


def registration_quality(rows: DataFrame) -> DataFrame:
    """Updated, rate and not-updated families: the difference must not reveal a protected part."""
    keys = ["territory", "month"]
    v = lambda n, c="value": F.max(F.when(F.col("measure") == n, F.col(c)))
    g = rows.groupBy(*keys).agg(v("families").alias("families"), v("updated").alias("updated"), v("updatedPercent").alias("updatedPercent"),
                                v("updated", "status").alias("updated_status"))
    c = mapping.complement(g, "families", "updated", "notUpdated")
    cells = F.array(
        F.struct(F.lit("updated").alias("measure"), F.lit("famílias").alias("unit"), F.col("updated").cast("decimal(18,2)").alias("value"), F.col("updated_status").alias("status")),
        F.struct(F.lit("updatedPercent").alias("measure"), F.lit("%").alias("unit"), F.col("updatedPercent").cast("decimal(18,2)").alias("value"), F.lit("real").alias("status")),
        F.struct(F.lit("notUpdated").alias("measure"), F.lit("famílias").alias("unit"), F.col("notUpdated").cast("decimal(18,2)").alias("value"), F.col("notUpdated_status").alias("status")))
    long = c.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    p = disclosure.suppress_primary(long, "value", "unit", "status", PERSON_UNITS)
    return disclosure.suppress_siblings(p, keys, ["value"], "status", F.col("measure") != "updatedPercent")


def protect_benefit(rows: DataFrame) -> DataFrame:
    """A protected category hides total, sibling and every money value of its month."""
    return disclosure.suppress_siblings(rows, ["territory", "month"], ["value"], "status", F.col("measure").isin("elderly", "disabled"))


def violations(raw: DataFrame) -> DataFrame:
    """Published identities: bands add up, the rate fits its parts, benefit totals and money agree."""
    n = lambda f: F.col(f).try_cast("decimal(18,2)")
    wide = raw.select("codigo_ibge", "anomes_s", *[n(f).alias(k) for k, f in {**REGISTRY, **{f"b_{k}": f for k, f in BENEFIT.items()}}.items()])
    keys = ["codigo_ibge", "anomes_s"]
    out = None
    for whole, parts, tolerance in (
        ("families", ("povertyFamilies", "lowIncomeFamilies", "aboveHalfFamilies"), 0.0), ("people", ("povertyPeople", "lowIncomePeople", "aboveHalfPeople"), 0.0),
        ("b_total", ("b_elderly", "b_disabled"), 0.0), ("b_transferredValue", ("b_elderlyValue", "b_disabledValue"), 0.011),
    ):
        summed = F.col(parts[0])
        for p in parts[1:]:
            summed = summed + F.col(p)
        g = quality.identity(wide, keys, F.col(whole), summed, tolerance, gate=f"{whole} parts")
        out = g if out is None else out.unionByName(g)
    return out.unionByName(quality.published_rate(wide, keys, "updated", "families", "updatedPercent"))


def per_hundred(people: DataFrame, population: DataFrame) -> DataFrame:
    """Registered people per 100 inhabitants, when the estimate is of the same year (``territory, year, population``)."""
    p = people.withColumn("year", F.substring("month", 1, 4)).join(population, ["territory", "year"], "left")
    return p.withColumn("per_100", ratio(F.col("value").cast("double"), F.col("population").cast("double"), 100.0))


def service_months(forms: DataFrame, territories: DataFrame, year: str, measures: Sequence[str] = ("a1", "a2", "c1")) -> DataFrame:
    """Twelve months of service forms: one missing answer leaves the territory's month without a total."""
    g = forms.withColumn("month", F.concat(F.lit(year), F.lpad("mes", 2, "0"))).groupBy("territory", "month").agg(
        F.count(F.lit(1)).alias("reporting_units"), *[aggregates.null_sum(F.col(m).try_cast("bigint")).alias(m) for m in measures])
    spine = windows.month_spine(territories.select("territory"), f"{year}01", f"{year}12")
    return spine.join(g, ["territory", "month"], "left").withColumn("reporting_units", F.coalesce("reporting_units", F.lit(0)))


# fixed values: by edition and kind of unit, the question whose "Sim" says that the unit offers a service
UNIT_SERVICES = {"2025": {"cras": ("q12_13", "PAIF"), "creas": ("q12_3", "PAEFI")}}


def institutional_units(
    rows: DataFrame, territories: DataFrame, kind: str, edition: str, services: Mapping[str, Mapping[str, tuple[str, str]]] = UNIT_SERVICES,
) -> DataFrame:
    """Units of one kind that answered the census of an edition: ``territory, unit, kind, name, address, services, reference, copies, problem``.

    ``rows`` has the census columns in lower case, ``territories`` the columns ``territory`` (seven digits) and ``states`` (accepted ways of
    writing its state).  Both codes of a row are its own and have to agree; six digits alone give no territory.  Identical answers fold,
    differing ones under one identifier are a problem, and any problem refuses the edition (:func:`unit_violations`).
    An edition without a dictionary of services fails.
    """
    if edition not in services:
        raise ContractError(f"no dictionary of services for edition {edition}")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    field, service = services[edition].get(kind, (None, None))
    offered = F.when(text(field) == "Sim", F.array(F.lit(service))).otherwise(F.array().cast("array<string>")) if field else F.array().cast("array<string>")
    parts = F.filter(F.array(*[text(c) for c in ("q0_2", "q0_3", "q0_4", "q0_6")]), lambda p: p != "")
    read = rows.select(
        text("ibge7").alias("territory"), text("ibge").alias("short"), text("uf").alias("state"), text("nu_identificador").alias("unit"),
        F.lit(kind).alias("kind"), text("q0_1").alias("name"), F.array_join(parts, ", ").alias("address"), offered.alias("services"), F.lit(edition).alias("reference"))
    own = territories.select("territory", "states")
    here = read.join(own, "territory")
    astray = read.join(own.select(F.substring("territory", 1, 6).alias("short")).distinct(), "short", "left_semi").join(own, "territory", "left_anti")
    problem = (
        F.when((F.col("short") != F.substring("territory", 1, 6)) | ~F.array_contains("states", F.col("state")), "codes or state disagree")
        .when(~F.col("unit").rlike("^[0-9]+$"), "no identifier").when(F.col("name") == "", "no name"))
    judged = here.withColumn("problem", problem).drop("states").unionByName(astray.withColumn("problem", F.lit("no confirmed code")))
    one = sets.dedup(judged.drop("short", "state"), ["territory", "unit"])
    return one.withColumn("problem", F.coalesce("problem", F.when(F.col("conflict"), "differing answers"))).drop("conflict")


def unit_violations(units: DataFrame) -> DataFrame:
    """Gate over :func:`institutional_units`."""
    return quality.violations(units.filter("problem IS NOT NULL"), "unit", ["territory", "unit"], F.col("problem"))
