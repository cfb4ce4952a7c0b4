"""Panels over a calendar: dense spines, guarded changes, complete windows.

Windows here partition by series and run over its periods.  A series has at most one row
per period of the stated calendar (aggregate first), which bounds every window group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import guarded_change
from ..functions.periods import month_list, month_ordinal
from ..session import attach_group, lit_array


def month_spine(
    territories: DataFrame, start: str, end: str, period: str = "month",
    categories: Sequence[str] | None = None, category: str = "category",
) -> DataFrame:
    """One row per territory, month (and category): each territory unfolds the calendar itself."""
    out = territories
    if categories is not None:
        out = out.withColumn(category, F.explode(lit_array(categories)))
    return out.withColumn(period, F.explode(month_list(start, end)))


def densify(
    spine: DataFrame, facts: DataFrame, keys: Sequence[str], measures: Sequence[str], fill_zero: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Put facts on the spine; a gap becomes zero only where ``fill_zero`` holds, else null.

    Columns in ``carry`` (means, flags) come along and are never filled.
    """
    j = spine.join(facts.select(*keys, *measures, *carry), list(keys), "left")
    if fill_zero is None:
        return j
    return j.withColumns({
        m: F.coalesce(F.col(m), F.when(fill_zero, F.lit(0).cast(facts.schema[m].dataType))) for m in measures
    })


def changes(df: DataFrame, keys: Sequence[str], period: str, value: str) -> DataFrame:
    """Change to the previous observation, with its period and whether it is one year back."""
    w = Window.partitionBy(*keys).orderBy(period)
    prev, before = F.lag(value).over(w), F.lag(period).over(w)
    return df.withColumns({"from_period": before, "previous": prev}).withColumns({
        "change": guarded_change(F.col(value), F.col("previous")),
        "annual": F.coalesce(F.col(period).cast("int") - F.col("from_period").cast("int") == 1, F.lit(False)),
    })


def annual_changes(df: DataFrame, keys: Sequence[str], year: str, value: str, unit: str) -> DataFrame:
    """Change only between consecutive years in the same unit."""
    w = Window.partitionBy(*keys).orderBy(year)
    ok = (F.col(year).cast("int") - F.lag(year).over(w).cast("int") == 1) & (F.col(unit) == F.lag(unit).over(w))
    prev = F.lag(value).over(w)
    return df.withColumn("annual_change", F.when(ok, guarded_change(F.col(value), prev)))


def complete_trailing(df: DataFrame, keys: Sequence[str], month: str, measures: Sequence[str], length: int = 12) -> DataFrame:
    """Sums of the last ``length`` months of a dense spine; null unless every month has a value."""
    w = Window.partitionBy(*keys).orderBy(month).rowsBetween(1 - length, 0)
    return df.withColumns({
        f"{m}_{length}m": F.when(F.count(m).over(w) == length, F.sum(m).over(w)) for m in measures
    })


def complete_year_to_date(df: DataFrame, keys: Sequence[str], month: str, measures: Sequence[str]) -> DataFrame:
    """Running sums within the year; null unless they start in January and have no gap."""
    w = Window.partitionBy(*keys, F.substring(month, 1, 4)).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    bare = F.replace(F.col(month), F.lit("-"), F.lit(""))
    due = F.substring(bare, 5, 2).cast("int")
    return df.withColumns({f"{m}_ytd": F.when(F.count(m).over(w) == due, F.sum(m).over(w)) for m in measures})


def last_calendar_months(df: DataFrame, month: str, reference: Column, n: int) -> DataFrame:
    """Rows of the last ``n`` calendar months up to the reference, gaps included."""
    age = month_ordinal(reference) - month_ordinal(F.col(month))
    return df.filter((age >= 0) & (age < n))


def last_published(df: DataFrame, keys: Sequence[str], period: str, n: int) -> DataFrame:
    """Rows of the last ``n`` published periods per series, whatever their spacing.

    The periods themselves are ranked (one row per period and series), not the facts.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(period))
    recent = (
        df.select(*keys, period).distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    )
    return df.join(recent, [*keys, period], "left_semi")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; every task keeps its own first before rows are sent, so no key is gathered."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", first).where("_first = 1").drop("_first")


PERIOD_DIGITS = 17


def period_number(df: DataFrame, period: str) -> Column:
    """A period as one number that sorts like it: texts of digits and separators by their digits, dates and times by their count."""
    kind = df.schema[period].dataType.typeName()
    if kind == "string":
        digits = F.regexp_replace(F.col(period), "[^0-9]", "")
        return F.rpad(digits, PERIOD_DIGITS, "0").cast("long")
    if kind == "date":
        return F.unix_date(period).cast("long")
    return F.unix_micros(F.col(period).cast("timestamp")) if kind.startswith("timestamp") else F.col(period)


def latest_complete(
    df: DataFrame, keys: Sequence[str], period: str, required: Sequence[str], earliest: str | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest record per entity with every required field.

    The period is packed into one number, whose maximum is reduced by hash inside the tasks; a semi-join then leaves the
    records of that period, and only among these are ties resolved by ``tie`` and then by all other columns.
    A null key is an entity, a null period the earliest.
    """
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    if earliest is not None:
        ok = ok & (F.col(period) >= earliest)
    rest = [c for c in df.columns if c not in keys]
    # every orderable column takes part, so equal periods resolve the same way in every run
    others = [c for c in rest if c not in (period, *tie) and df.schema[c].dataType.typeName() not in ("map", "variant")]
    # a struct is equal to another where its null fields are null in both
    numbered = df.filter(ok).withColumns({"_entity": F.struct(*keys), "_number": F.coalesce(period_number(df, period), F.lit(-(1 << 62)))})
    newest = numbered.groupBy("_entity").agg(F.max("_number").alias("_number"))
    last = numbered.join(newest, ["_entity", "_number"], "left_semi")
    order = [F.col(period).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in (*tie, *others)]]
    return top_per_key(last, keys, order).select(*keys, *rest)


def latest_reference_rows(df: DataFrame, keys: Sequence[str], reference: str) -> DataFrame:
    """All rows of the latest reference of each series; references are reduced by hash before they are compared."""
    newest = df.select(*keys, reference).distinct().groupBy(*keys).agg(F.max(reference).alias(reference))
    return df.join(newest, [*keys, reference], "left_semi")


def between_periods(df: DataFrame, keys: Sequence[str], period: str, value: str, start: str, end: str) -> DataFrame:
    """Value at two chosen periods and their difference; null when the order is wrong."""
    at = lambda p: F.max(F.when(F.col(period) == p, F.col(value)))
    g = df.filter(F.col(period).isin(start, end)).groupBy(*keys).agg(at(start).alias("start_value"), at(end).alias("end_value"))
    return g.withColumn("difference", F.when(F.lit(start < end), F.col("end_value") - F.col("start_value")))


def group_share(df: DataFrame, keys: Sequence[str], value: str, bounded: bool = True) -> DataFrame:
    """Share of each category in its group; one row per category (else ``bounded=False``)."""
    return (
        attach_group(df, keys, {"_total": F.sum(value)}, bounded)
        .withColumn("share", F.when(F.col("_total") > 0, F.col(value) / F.col("_total") * 100))
        .drop("_total")
    )


def regime_segments(df: DataFrame, keys: Sequence[str], period: str, value: str, breaks: Sequence[str]) -> DataFrame:
    """Null the marked periods and number the segments they separate."""
    marked = F.col(period).isin(*breaks) if breaks else F.lit(False)
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(marked.cast("int")).over(w)).withColumn(value, F.when(~marked, F.col(value)))


def first_last_label(df: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """``2007-2023`` (or a single year) per source."""
    lo, hi = F.min(year), F.max(year)
    return df.groupBy(*keys).agg(F.when(lo == hi, lo.cast("string")).otherwise(
        F.concat_ws("–", lo.cast("string"), hi.cast("string"))).alias("years"))
