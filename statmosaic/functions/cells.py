"""Statistical cells: symbols, numbers, units, rates.  Absence is never zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: symbols of statistical cubes and the status each one means
SYMBOL_STATUS = {"X": "suppressed", "..": "notApplicable", "...": "unavailable"}
ZERO_SYMBOL = "-"

NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def finite(c: Column) -> Column:
    """True for ordinary numbers; null stays null."""
    d = c.cast("double")
    return ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def integral(c: Column) -> Column:
    return finite(c) & (c == F.floor(c))


def strict_number(c: Column, comma: bool = False, type_: str = "double") -> Column:
    """Number of a text; ``NaN``, ``inf`` and anything malformed become null."""
    t = F.trim(c)
    if comma:
        t = F.replace(t, F.lit(","), F.lit("."))
    n = t.try_cast(type_)
    ok = t.rlike(NUMBER_PATTERN)  # also spares the cast the cost of failing
    if type_ in ("double", "float"):
        ok = ok & (F.abs(n) < F.lit(float("inf")))  # an overflowing text is not finite
    return F.when(ok, n)


def decode_symbol(raw: Column, dash: str = "zero", type_: str = "double") -> Column:
    """``struct(value, status, raw)`` of a cube cell.

    ``dash='zero'`` reads ``-`` as a confirmed zero, ``dash='missing'`` as unavailable:
    publications differ, so the caller says which.  Unreadable text gets status ``invalid``.
    """
    if dash not in ("zero", "missing"):
        raise ValueError("dash is 'zero' or 'missing'")
    t = F.trim(raw)
    number = strict_number(t, type_=type_)
    value = F.when(t == ZERO_SYMBOL, F.lit(0).cast(type_)).otherwise(number) if dash == "zero" else number
    status = F.when(raw.isNull() | (t == ""), F.lit("unavailable"))
    for symbol, meaning in SYMBOL_STATUS.items():
        status = status.when(t == symbol, F.lit(meaning))
    status = (
        status.when(t == ZERO_SYMBOL, F.lit("real" if dash == "zero" else "unavailable"))
        .when(number.isNotNull(), F.lit("real"))
        .otherwise(F.lit("invalid"))
    )
    symbols = [ZERO_SYMBOL, *SYMBOL_STATUS]
    return F.struct(value.alias("value"), status.alias("status"), F.when(t.isin(symbols), t).alias("raw"))


def with_number(
    df: DataFrame,
    raw: str,
    value: str = "value",
    error: str = "error",
    missing: Sequence[str] = (),
    comma: bool = False,
    upper: float | Column | None = None,
    whole: bool | Column = False,
    type_: str = "decimal(20,4)",
) -> DataFrame:
    """Number of a text column under one source's rules, with the reason it is refused.

    Blank texts and those in ``missing`` are absent, not errors.  Otherwise the number must
    be finite, not negative, at most ``upper``, and whole when ``whole``; both limits may
    vary by row.  Each stage reads the one before it, so a text is parsed once.
    """
    t, n = F.col("_t"), F.col("_n")
    reason = F.when(t.isNotNull() & n.isNull(), "not a number").when(n < 0, "negative")
    if upper is not None:
        reason = reason.when(n > upper, "above limit")
    if whole is not False:
        reason = reason.when((n != F.floor(n)) if whole is True else (whole & (n != F.floor(n))), "not whole")
    return (
        df.withColumn("_t", F.nullif(F.trim(raw), F.lit("")))
        .withColumn("_t", F.when(~t.isin(*missing), t) if missing else t)
        .withColumn("_n", strict_number(t, comma, type_))
        .withColumn(error, reason)
        .withColumn(value, F.when(F.col(error).isNull(), n))
        .drop("_t", "_n")
    )


def money(c: Column) -> Column:
    """Cents-exact amount of a dotted decimal text."""
    return strict_number(c, type_="decimal(18,2)")


def round2(c: Column) -> Column:
    """Two decimals, half up, on exact decimals (never on binary doubles)."""
    return F.round(c.cast("decimal(38,10)"), 2).cast("decimal(38,2)")


def ratio2(num_cents: Column, den: Column) -> Column:
    """Cents of ``num_cents/den`` rounded half up, in integers only; both non-negative."""
    n, d = num_cents.cast("decimal(38,0)"), den.cast("decimal(38,0)")
    return F.when(d > 0, F.floor((n * 2 + d) / (d * 2)).cast("bigint"))


def within(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Do two numbers agree within the larger of two tolerances?"""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(b) * F.lit(relative))


def ratio(num: Column, den: Column, factor: float = 1.0) -> Column:
    """``num / den * factor`` for a positive denominator, else null."""
    return F.when(den > 0, num / den * F.lit(factor))


def percent(num: Column, den: Column) -> Column:
    return ratio(num, den, 100.0)


def per_1000_km2(count: Column, km2: Column) -> Column:
    return ratio(count, km2, 1000.0)


def km2_to_ha(km2: Column) -> Column:
    return km2 * F.lit(100.0)


def guarded_change(current: Column, previous: Column) -> Column:
    """Percent change; null unless the base is present and positive."""
    return F.when(previous > 0, (current / previous - 1) * 100)


def currency_interval_unit(unit: Column, period: Column, marker: str, plain: str) -> Column:
    """``struct(unit, error)`` of a unit like ``marker [1994 a 2024]``: valid inside its years only."""
    inside = rf"{marker} \[(\d{{4}}) a (\d{{4}})\]"
    first = F.regexp_extract(unit, inside, 1).try_cast("int")
    last = F.regexp_extract(unit, inside, 2).try_cast("int")
    year = period.try_cast("int")
    dated = F.contains(unit, F.lit(marker + " ["))
    ok = first.isNotNull() & year.between(first, last)
    return F.struct(
        F.when(~dated, unit).when(ok, F.lit(plain)).alias("unit"),
        F.when(dated & ~F.coalesce(ok, F.lit(False)), F.lit("period outside currency interval")).alias("error"),
    )


def resolve_unit(
    published: Column, category_unit: Column, override: Column, period: Column, marker: str, plain: str
) -> Column:
    """Documented override, else the category's own unit, else the dated currency unit."""
    by_category = published.startswith("Vide categorias")
    dated = currency_interval_unit(published, period, marker, plain)
    chosen = F.when(by_category, F.coalesce(category_unit, F.lit("Não aplicável"))).otherwise(dated["unit"])
    return F.struct(
        F.coalesce(override, chosen).alias("unit"),
        F.when(~by_category, dated["error"]).alias("error"),
    )


def scale_units(df: DataFrame, factors: Mapping[str, tuple[str, int]], value: str = "value", unit: str = "unit") -> DataFrame:
    """Bring scaled units to their base exactly once; ``factors`` maps unit to (base unit, factor).

    The published unit stays in ``original_unit``.
    """
    base, factor = F.col("original_unit"), F.lit(1)
    for name, (plain, times) in factors.items():
        hit = F.col("original_unit") == name
        base, factor = F.when(hit, F.lit(plain)).otherwise(base), F.when(hit, F.lit(times)).otherwise(factor)
    scaled = df.withColumn("original_unit", F.col(unit))
    return scaled.withColumns({value: F.col(value) * factor, unit: base})


def derived_cell(value: Column, unit: str, formula: str, inputs: Mapping[str, Column], reason: str) -> Column:
    """A computed cell with its formula and inputs, and a reason when it has no value."""
    return F.struct(
        value.alias("value"),
        F.lit(unit).alias("unit"),
        F.when(value.isNotNull(), "derived").otherwise("unavailable").alias("status"),
        F.lit(formula).alias("formula"),
        F.to_json(F.struct(*[c.alias(k) for k, c in inputs.items()])).alias("inputs"),
        F.when(value.isNull(), F.lit(reason)).alias("reason"),
    )


def tri_any(*flags: Column) -> Column:
    """Any yes is yes, all no is no, otherwise unknown (SQL three-valued OR)."""
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def tri_flag(c: Column, yes: str = "SIM", no: str = "NAO") -> Column:
    t = F.trim(c)
    return F.when(t == yes, F.lit(True)).when(t == no, F.lit(False))


def bit_flag(c: Column) -> Column:
    """``0/1`` or ``0.0/1.0`` texts as nullable booleans."""
    n = strict_number(c)
    return F.when(n == 1, F.lit(True)).when(n == 0, F.lit(False))


def status_consistent(value: Column, status: Column) -> Column:
    """A value is absent exactly when its status says so."""
    return status.isin("suppressed", "notApplicable", "unavailable") == value.isNull()
