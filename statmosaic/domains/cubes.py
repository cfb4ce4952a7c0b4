"""Population, economy and agriculture: blocks built from cells of statistical cubes.

A cell is ``territory, variable, period, dims, unit, value, status`` (see ``sources.nested``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import scale_units
from ..operators import aggregates, joins, mapping, quality, ranking, sets, windows
from ..session import attach_group


def dim(name: str) -> Column:
    return F.element_at("dims", F.lit(name))


def pick(cells: DataFrame, variable: str, **dims: str) -> DataFrame:
    """Cells of one variable with fixed categories."""
    out = cells.filter(F.col("variable") == variable)
    for k, v in dims.items():
        out = out.filter(dim(k.lstrip("_")) == v)
    return out


# --- population ---------------------------------------------------------------------------------


def age_bands(cells: DataFrame, age: str, sex: str, bands: DataFrame, male: str, female: str, both: str) -> DataFrame:
    """Disjoint age bands by sex; ``balanced`` compares male + female with the published total.

    ``bands(category, band)`` lists the disjoint categories only, so overlapping ones drop.
    """
    b = bands.select(F.col("category").alias("_age"), "band")
    rows = cells.withColumns({"_age": dim(age), "_sex": dim(sex)}).join(b, "_age", "inner")
    part = lambda code: F.sum(F.when(F.col("_sex") == code, F.col("value")))
    g = rows.groupBy("territory", "period", "band").agg(part(male).alias("male"), part(female).alias("female"), part(both).alias("total"))
    return g.withColumn("balanced", F.col("male") + F.col("female") == F.col("total"))


def shares(cells: DataFrame, by: str, total: str) -> DataFrame:
    """Categories of one dimension as a percentage of its published total."""
    rows = cells.select("territory", "period", dim(by).alias("category"), "value")
    return aggregates.distribution(rows.filter(F.col("category") != total), rows.filter(F.col("category") == total), ["territory", "period"])


def growth(cells: DataFrame, population: str, change: str) -> DataFrame:
    """Earlier population on today's boundaries, from the published change."""
    wide = cells.groupBy("territory", "period").pivot("variable", [population, change]).agg(F.max("value"))
    return mapping.backcast_growth(wide.toDF("territory", "period", "population", "change"), ["territory", "period"], "population", "change")


def history(census: DataFrame, estimates: DataFrame) -> DataFrame:
    """Counts and estimates one under the other, never merged; periods without information are left out."""
    cols = ["territory", "period", "value"]
    return sets.tag_append({"census": census.select(*cols), "estimate": estimates.select(*cols)}).filter(F.col("value").isNotNull())


# --- economy ------------------------------------------------------------------------------------


def base_currency(cells: DataFrame, factors: Mapping[str, tuple[str, int]]) -> DataFrame:
    return scale_units(cells, factors)


def product_series(cells: DataFrame, variable: str) -> DataFrame:
    """Gross product with change to the previous observation and whether that is one year."""
    return windows.changes(pick(cells, variable).select("territory", "period", "value"), ["territory"], "period", "value")


def composition(cells: DataFrame, sectors: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Sector value and published share; ``sectors`` gives (value variable, share variable)."""
    value = {v: k for k, (v, _) in sectors.items()}
    share = {s: k for k, (_, s) in sectors.items()}
    rows = cells.withColumn("sector", mapping.classify(F.col("variable"), {**value, **share})).filter("sector IS NOT NULL")
    return rows.groupBy("territory", "period", "sector").agg(
        F.max(F.when(F.col("variable").isin(*value), F.col("value"))).alias("value"),
        F.max(F.when(F.col("variable").isin(*share), F.col("value"))).alias("share"))


def opening_violations(cells: DataFrame, components: Sequence[str], gaps: Sequence[str]) -> DataFrame:
    """A year shows every component or none, and none only in the documented years."""
    return quality.all_or_nothing(cells.filter(F.col("variable").isin(*components)), ["territory", "period"], "variable", "value", len(components), gaps, "period")


def leading_sector(composition_: DataFrame) -> DataFrame:
    return aggregates.leader(composition_, ["territory", "period"], "sector", "share")


def tax_share(cells: DataFrame, tax: str, product: str) -> DataFrame:
    n = pick(cells, tax).select("territory", "period", F.col("value").alias("numerator"))
    d = pick(cells, product).select("territory", "period", F.col("value").alias("denominator"))
    return joins.matched_ratio(n, d, ["territory", "period"], 100.0)


def account_violations(cells: DataFrame, product: str, added: str, tax: str, sectors: Sequence[str]) -> DataFrame:
    """Product = value added + taxes (2,000), value added = its sectors (4,000), in currency units."""
    v = lambda name: F.max(F.when(F.col("variable") == name, F.col("value")))
    parts = v(sectors[0])
    for s in sectors[1:]:
        parts = parts + v(s)
    g = cells.groupBy("territory", "period").agg(v(product).alias("product"), v(added).alias("added"), v(tax).alias("tax"), parts.alias("parts"))
    keys = ["territory", "period"]
    return quality.identity(g, keys, F.col("product"), F.col("added") + F.col("tax"), 2000.0, gate="product").unionByName(
        quality.identity(g, keys, F.col("added"), F.col("parts"), 4000.0, gate="value added"))


def compared(series: DataFrame, territory: str, keys: Sequence[str] = ("indicator", "unit", "methodology", "period")) -> DataFrame:
    """Peers beside one territory's latest figure."""
    local = windows.latest_reference_rows(series.filter(F.col("territory") == territory), ["indicator"], "period")
    return joins.comparable(local, series.filter(F.col("territory") != territory), keys)


# --- agriculture --------------------------------------------------------------------------------


def products(cells: DataFrame, classification: str, metrics: Mapping[str, str], factors: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Product metrics in base units with strict annual change.

    ``metrics`` maps variable to metric name.
    """
    rows = cells.withColumns({"product": dim(classification), "metric": mapping.classify(F.col("variable"), metrics)}).filter("metric IS NOT NULL")
    return windows.annual_changes(scale_units(rows, factors), ["territory", "product", "metric"], "period", "value", "unit").select(
        "territory", "product", "metric", "period", "value", "unit", "original_unit", "status", "annual_change")


def present(products_: DataFrame, reference: str) -> DataFrame:
    """Which products are present in the reference year, and which ever were (a suppressed cell counts)."""
    return mapping.presence(products_, ["territory", "product"], "period", "value", "status", F.lit(reference))


def ranked(products_: DataFrame, names: DataFrame, metric: str, reference: str, subtotals: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Products by one metric in the reference year; totals and subtotals never compete, units never mix.

    Only products present in that year count; a product's group is its metrics and years.
    """
    there = ((F.col("value") > 0) | (F.col("status") == "suppressed")) & (F.col("period") == reference)
    rows = attach_group(products_, ["territory", "product"], {"_there": F.max(there)}, bounded=True).filter(
        F.coalesce("_there", F.lit(False)) & (F.col("metric") == metric) & (F.col("period") == reference)).drop("_there")
    return ranking.rank_products(rows.join(names, "product"), ["territory", "unit"], "value", "name", mapping.rank_eligible(F.col("product"), subtotals), limit)


def per_animal(production: DataFrame, animals: DataFrame, factor: float = 1000.0) -> DataFrame:
    """Production per animal where period agrees (``territory, period, value``)."""
    n = production.select("territory", "period", F.col("value").alias("numerator"))
    d = animals.select("territory", "period", F.col("value").alias("denominator"))
    return joins.matched_ratio(n, d, ["territory", "period"], factor)


def typology_violations(cells: DataFrame, by: str, total: str, parts: Sequence[str]) -> DataFrame:
    """Family + non-family against the total, within 2, wherever all three are known."""
    v = lambda c: F.max(F.when(dim(by) == c, F.col("value")))
    summed = v(parts[0])
    for p in parts[1:]:
        summed = summed + v(p)
    g = cells.groupBy("territory", "variable", "period").agg(v(total).alias("whole"), summed.alias("parts"))
    return quality.identity(g, ["territory", "variable", "period"], F.col("whole"), F.col("parts"), 2.0, gate="typology")


def state_share(local: DataFrame, state: DataFrame) -> DataFrame:
    """Share of each territory in its own state where state, product, metric, unit and period agree."""
    keys = ["state", "product", "metric", "unit", "period"]
    n = local.select("territory", *keys, F.col("value").alias("numerator"))
    d = state.select(*keys, F.col("value").alias("denominator"))
    return joins.matched_ratio(n, d, keys, 100.0)
