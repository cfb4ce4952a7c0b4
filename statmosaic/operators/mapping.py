"""Filters, crosswalks and code-to-class mappings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import with_number
from ..functions.periods import is_month
from ..functions.text import fold


def located(df: DataFrame, crosswalk: DataFrame, code: str, state: str) -> DataFrame:
    """Rows whose code is in the crosswalk, with ``territory`` and whether the state agrees.

    ``crosswalk`` has ``source_code, state_code, code``.  Matched by code, never by name.
    One pass serves both the filter and its violations (``state_ok`` false).
    """
    x = crosswalk.select(
        F.col("source_code").alias("_c"), F.col("state_code").alias("_s"), F.col("code").alias("territory")
    )
    return (
        df.join(x, F.col(code) == F.col("_c"), "inner")
        .withColumn("state_ok", F.col(state).eqNullSafe(F.col("_s")))
        .drop("_c", "_s")
    )


def in_territory(df: DataFrame, crosswalk: DataFrame, code: str, state: str) -> DataFrame:
    """Keep rows whose (code, state) is in the crosswalk; a homonym in another state drops out."""
    return located(df, crosswalk, code, state).filter("state_ok").drop("state_ok")


def in_named_territory(df: DataFrame, territories: DataFrame, name: str, state: str) -> DataFrame:
    """Same for files without codes: folded name and folded state must both agree."""
    x = territories.select(
        fold(F.col("name")).alias("_n"), fold(F.col("state")).alias("_s"), F.col("code").alias("territory")
    )
    keyed = df.withColumns({"_n": fold(F.col(name)), "_s": fold(F.col(state))})
    return keyed.join(x, ["_n", "_s"], "inner").drop("_n", "_s")


def allow_fields(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only listed fields pass; a listed field that is absent fails."""
    return df.select(*allowed)


def one_cell(cells: DataFrame, variable: str, period: str, dims: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """The wanted cell per key with how many there are; ``problem`` is null when exactly one has a value."""
    wanted = (F.col("variable") == variable) & (F.col("period") == period)
    for k, v in dims.items():
        wanted = wanted & (F.element_at("dims", F.lit(k)) == v)
    n, filled = F.count_if(wanted), F.count(F.when(wanted, F.col("value")))
    return cells.groupBy(*keys).agg(
        n.alias("found"),
        F.max(F.when(wanted, F.col("value"))).alias("value"),
        F.when(n == 0, "missing").when(n > 1, "repeated").when(filled == 0, "no value").alias("problem"),
    )


def classify(c: Column, exact: Mapping[str, str], prefix: Sequence[tuple[str, str]] = (), default: str | None = None) -> Column:
    """Class of a code: exact code first, then longest prefix; unmapped is ``default``."""
    out = F.lit(default).cast("string")
    for start, label in sorted(prefix, key=lambda p: len(p[0])):
        out = F.when(c.startswith(start), F.lit(label)).otherwise(out)
    for code, label in exact.items():
        out = F.when(c == code, F.lit(label)).otherwise(out)
    return out


def classify_range(c: Column, ranges: Sequence[tuple[int, int, str]]) -> Column:
    """Class of a numeric division by inclusive ranges; outside is null."""
    out = F.lit(None).cast("string")
    for low, high, label in ranges:
        out = F.when(c.between(low, high), F.lit(label)).otherwise(out)
    return out


def unmapped(df: DataFrame, code: str, label: str) -> DataFrame:
    """Codes without a class, with how often they occur."""
    return df.filter(F.col(label).isNull()).groupBy(code).agg(F.count(F.lit(1)).alias("rows"))


def movement_problem(
    kind: Column, event_month: Column, declared: Column, excluded: Column, late: Column, is_exclusion: Column,
    sign: Column, move_type: Column, publication: Column, admissions: Iterable[str], dismissals: Iterable[str],
) -> Column:
    """Why a movement record does not belong to its file, or null.

    On-time files hold only their own month; late files are flagged late; exclusion
    files match the exclusion month.  The sign must agree with the movement type.  A field that is
    missing or unreadable breaks the rule that needs it.
    """
    admissions, dismissals = list(admissions), list(dismissals)
    fails = lambda must_hold: ~F.coalesce(must_hold, F.lit(False))
    return (
        F.when(fails(kind.isin("MOV", "FOR", "EXC")), "unknown file kind")
        .when(fails(is_month(publication) & is_month(event_month)), "unreadable month")
        .when((kind == "EXC") & fails((is_exclusion == "1") & (excluded == publication)), "wrong exclusion month")
        .when((kind != "EXC") & fails(declared == publication), "wrong declaration month")
        .when((kind == "MOV") & fails((event_month == publication) & (late == "0")), "not on time")
        .when((kind == "FOR") & fails(late == "1"), "not flagged late")
        .when(fails(sign.isin(1, -1)), "unknown sign")
        .when(fails(move_type.isin(*admissions, *dismissals)), "unknown movement type")
        .when(fails(F.when(sign == 1, move_type.isin(*admissions)).otherwise(move_type.isin(*dismissals))), "sign against movement type")
    )


def wage_eligible(
    df: DataFrame, minimum: DataFrame, year: str, wage: Column, admission: Column, intermittent: Column,
    low: float = 0.3, high: float = 150.0,
) -> DataFrame:
    """Flag wages usable for a mean: admission, regular contract, within multiples of that year's minimum.

    ``minimum(year, minimum)``; a year without a minimum is never eligible.
    """
    joined = df.join(minimum.select(F.col("year").alias(year), F.col("minimum").alias("_min")), year, "left")
    ok = admission & ~intermittent & wage.between(F.col("_min") * low, F.col("_min") * high)
    return joined.withColumn("wage_eligible", F.coalesce(ok, F.lit(False))).drop("_min")


def active_stock(active: Column, abandoned: Column) -> Column:
    """In the stock: active at year end and not abandoned; other flag values raise no match."""
    return (active == "1") & (abandoned == "0")


def universe(active: Column, measure: Column) -> Column:
    return active & measure.isNotNull()


def universe_problem(active: Column, measure: Column, *declared: Column) -> Column:
    """An active unit that declares activity must report its measure."""
    any_declared = F.coalesce(declared[0], F.lit(False))
    for d in declared[1:]:
        any_declared = any_declared | F.coalesce(d, F.lit(False))
    return F.when(active & measure.isNull() & any_declared, "declared without measure")


def presence(df: DataFrame, keys: Sequence[str], period: str, value: str, status: str, latest: Column) -> DataFrame:
    """Per series: present in the latest period, and ever present (positive or suppressed)."""
    there = (F.col(value) > 0) | (F.col(status) == "suppressed")
    return df.groupBy(*keys).agg(
        F.coalesce(F.max(there & (F.col(period) == latest)), F.lit(False)).alias("present_latest"),
        F.coalesce(F.max(there), F.lit(False)).alias("ever_present"),
    )


def rank_eligible(category: Column, subtotals: Sequence[str], total: str = "0") -> Column:
    """Published totals and subtotals are never ranked with their parts."""
    return ~category.isin(total, *subtotals)


def backcast_growth(df: DataFrame, keys: Sequence[str], total: str, change: str) -> DataFrame:
    """Base = total - published change; growth on that base, null unless the base is positive."""
    base = F.col(total) - F.col(change)
    return df.select(
        *keys, total, change, base.alias("base"), F.when(base > 0, F.col(change) / base * 100).alias("growth")
    )


def complement(df: DataFrame, whole: str, part: str, name: str) -> DataFrame:
    """Whole - part in one universe; null and ``unavailable`` when either is missing."""
    diff = F.col(whole) - F.col(part)
    return df.withColumns({name: diff, f"{name}_status": F.when(diff.isNull(), "unavailable").otherwise("derived")})


def mapped_measures(
    df: DataFrame, keys: Sequence[str], mapping: Mapping[str, str], kinds: Mapping[str, tuple[str, str]],
    missing: Sequence[str] = ("-", "..", "...", "X"),
) -> DataFrame:
    """``{public name: source field}`` to long rows ``keys, measure, unit, value, error``.

    ``kinds`` gives (unit, kind) per public name with kind ``count``, ``money`` or ``percent``.
    """
    unknown = {kinds[n][1] for n in mapping} - {"count", "money", "percent"}
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.lit(kinds[name][0]).alias("unit"), F.lit(kinds[name][1]).alias("kind"),
                 F.col(field).alias("raw"))
        for name, field in mapping.items()
    ])).alias("m")).select(*keys, "m.*")
    limit = F.when(F.col("kind") == "percent", F.lit(100)).cast("decimal(18,2)")
    return with_number(long, "raw", missing=missing, upper=limit, whole=F.col("kind") == "count").select(
        *keys, "measure", "unit", F.col("value").cast("decimal(18,2)").alias("value"), "error")


def unavailable_rows(expected: DataFrame, title: str, reason: str) -> DataFrame:
    """Explicit rows for blocks that have no publication."""
    return expected.withColumns({
        "title": F.lit(title), "value": F.lit(None).cast("double"),
        "status": F.lit("unavailable"), "reason": F.lit(reason),
    })


def with_provenance(df: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Source facts on every exported row; a row without a source keeps nulls (gate: referential)."""
    return df.join(sources, key, "left")
