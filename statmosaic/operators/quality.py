"""Publication gates.  Each returns a violations frame ``(gate, key, detail)``; empty means pass.

``require`` is the fail-closed end: it refuses when any gate has a row, looking at no more
than a handful of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import within
from ..functions.periods import is_month, month_list, month_ordinal

VIOLATION = "gate string, key string, detail string"


class GateFailure(ValueError):
    """A publication gate found violations."""


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("∅")) for k in keys])


def violations(df: DataFrame, gate: str, keys: Sequence[str], detail: Column | str) -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(gate).alias("gate"), key_text(keys).alias("key"), d.cast("string").alias("detail"))


def require(*gates: DataFrame, show: int = 5) -> None:
    for g in gates:
        rows = g.limit(show).collect()
        if rows:
            raise GateFailure("; ".join(f"{r['gate']} [{r['key']}] {r['detail']}" for r in rows))


def unique_keys(df: DataFrame, keys: Sequence[str], gate: str = "unique") -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return violations(g, gate, keys, F.col("_n"))


def complete_cells(differences: DataFrame, keys: Sequence[str], gate: str = "complete") -> DataFrame:
    """Gate over :func:`sets.cell_differences`: each requested cell exactly once."""
    return violations(differences, gate, keys, F.col("problem"))


def metadata_contract(published: DataFrame, contract: DataFrame, keys: Sequence[str], gate: str = "metadata") -> DataFrame:
    """Published names, units, labels and levels must all be in the contract, and the reverse."""
    p, c = published.select(*keys).distinct(), contract.select(*keys).distinct()
    return violations(p.join(c, list(keys), "left_anti"), gate, keys, "not in contract").unionByName(
        violations(c.join(p, list(keys), "left_anti"), gate, keys, "not published")
    )


def rules(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """Row rules: each names a condition that must hold; unknown (null) does not hold.

    All rules are evaluated in one pass; a row yields one violation per broken rule.
    """
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()
    ]))
    return df.select(key_text(keys).alias("key"), F.explode(broken).alias("gate")).select(
        "gate", "key", F.lit("rule broken").alias("detail")
    )


def sums_to_total(
    parts: DataFrame, totals: DataFrame, keys: Sequence[str], measures: Sequence[str], gate: str = "conservation"
) -> DataFrame:
    """Parts must add up exactly to their total, for every measure."""
    s = parts.groupBy(*keys).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    j = s.join(totals.select(*keys, *measures), list(keys), "full_outer")
    same = F.lit(True)
    for m in measures:
        same = same & F.col(m).eqNullSafe(F.col(f"_{m}"))
    detail = F.concat_ws(", ", *[F.concat_ws("≠", F.col(f"_{m}").cast("string"), F.col(m).cast("string")) for m in measures])
    return violations(j.filter(~same), gate, keys, detail)


def identity(
    df: DataFrame, keys: Sequence[str], left: Column, right: Column, absolute: float = 0.0, relative: float = 0.0,
    gate: str = "identity",
) -> DataFrame:
    """An accounting identity within its stated tolerance; an absent side is not tested."""
    bad = ~within(left, right, absolute, relative)
    return violations(df.filter(bad), gate, keys, F.round((left - right).cast("double"), 6))


def published_rate(
    df: DataFrame, keys: Sequence[str], num: str, den: str, rate: str, tolerance: float = 0.02, gate: str = "rate"
) -> DataFrame:
    """Published percentage against its own parts; numerator within bounds; an absent part or rate is a violation."""
    n, d, r = F.col(num), F.col(den), F.col(rate)
    computed = F.when(d > 0, n / d * 100).otherwise(F.lit(0.0))
    problem = (
        F.when(n.isNull() | d.isNull() | r.isNull(), "rate or part absent").when(n > d, "numerator above universe").when(~r.between(0, 100), "rate out of bounds")
        .when(F.abs(computed - r) > tolerance, "rate off its parts")
    )
    return violations(df.withColumn("_p", problem).filter(F.col("_p").isNotNull()), gate, keys, F.col("_p"))


def referential(df: DataFrame, parents: DataFrame, key: str, ids: Sequence[str], gate: str = "reference") -> DataFrame:
    return violations(df.join(parents.select(key), key, "left_anti"), gate, ids, F.concat(F.lit("no "), F.lit(key)))


def https_only(df: DataFrame, ids: Sequence[str], url: str, gate: str = "provenance") -> DataFrame:
    return violations(df.filter(~F.coalesce(F.col(url).startswith("https://"), F.lit(False))), gate, ids, F.col(url))


def continuous(df: DataFrame, keys: Sequence[str], month: str, gate: str = "calendar") -> DataFrame:
    """A monthly series has no gap between its first and last month.

    Counts distinct months against the span they cover; no calendar has to be unfolded.  A month that is
    absent or no month is a violation of its own.
    """
    ordinal = F.when(is_month(F.col(month)), month_ordinal(F.col(month)))
    g = df.groupBy(*keys).agg(
        (F.max(ordinal) - F.min(ordinal) + 1).alias("_s"), F.count_distinct(ordinal).alias("_n"), F.count_if(ordinal.isNull()).alias("_u"))
    problem = F.when(F.col("_u") > 0, F.concat(F.col("_u").cast("string"), F.lit(" unreadable months"))).when(
        F.col("_s") != F.col("_n"), F.concat_ws("/", F.col("_n").cast("string"), F.col("_s").cast("string")))
    return violations(g.withColumn("_p", problem).filter(F.col("_p").isNotNull()), gate, keys, F.col("_p"))


def missing_months(df: DataFrame, territories: DataFrame, keys: Sequence[str], month: str, start: str, end: str, gate: str = "calendar") -> DataFrame:
    spine = territories.select(*keys, F.explode(month_list(start, end)).alias(month))
    return violations(spine.join(df.select(*keys, month).distinct(), [*keys, month], "left_anti"), gate, [*keys, month], "missing month")


def volume_floor(df: DataFrame, floor: int, gate: str = "volume") -> DataFrame:
    """A scan below its floor is truncated."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return violations(n.filter(F.col("_n") < floor), gate, ["_n"], f"below {floor}")


def declared_total(df: DataFrame, keys: Sequence[str], declared: str, received: str | None = None, gate: str = "truncation") -> DataFrame:
    """What each response declares against what it brought.

    ``received`` names the response's own count; without it, rows are counted.  A response whose total
    cannot be read is a violation, an empty one that declares nothing is not.
    """
    got = F.count(F.lit(1)) if received is None else F.max(received)
    g = df.groupBy(*keys).agg(F.max(declared).alias("_d"), got.alias("_n"))
    problem = F.when(F.col("_d").isNull(), "no readable total").when(
        ~F.col("_d").eqNullSafe(F.col("_n")), F.concat_ws("/", F.coalesce(F.col("_n"), F.lit(0)).cast("string"), F.col("_d").cast("string")))
    return violations(g.withColumn("_p", problem).filter(F.col("_p").isNotNull()), gate, keys, F.col("_p"))


def all_or_nothing(
    df: DataFrame, keys: Sequence[str], component: str, value: str, components: int, gaps: Sequence[str] = (),
    period: str | None = None, gate: str = "partial",
) -> DataFrame:
    """A period opens with every component or with none; only documented gaps may be empty."""
    g = df.groupBy(*keys).agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(component))).alias("_n"))
    problem = F.when((F.col("_n") > 0) & (F.col("_n") < components), "partial opening")
    if period is not None:
        problem = problem.when((F.col("_n") == 0) & ~F.col(period).isin(*gaps), "undocumented gap")
    return violations(g.withColumn("_p", problem).filter(F.col("_p").isNotNull()), gate, keys, F.col("_p"))


def recomputed(published: DataFrame, detail: DataFrame, keys: Sequence[str], measures: Sequence[str], gate: str = "recompute") -> DataFrame:
    """A published summary must equal its recomputation from detail, both ways."""
    p = published.select(*keys, *measures)
    d = detail.select(*keys, *[F.col(m).alias(f"_{m}") for m in measures])
    same = F.lit(True)
    for m in measures:
        same = same & F.col(m).eqNullSafe(F.col(f"_{m}"))
    return violations(p.join(d, list(keys), "full_outer").filter(~same), gate, keys, "summary differs from detail")


def yield_warnings(df: DataFrame, keys: Sequence[str], production: str, area: str, yield_: str, planted: str | None = None, factor: float = 1000.0) -> DataFrame:
    """Warnings that never change data: yield far from production/area; more harvested than planted."""
    p, a, y = F.col(production), F.col(area), F.col(yield_)
    expected = F.when(a > 0, p * F.lit(factor) / a)
    warn = lambda gate, when, detail: F.when(when, F.struct(F.lit(gate).alias("gate"), F.lit(detail).alias("detail")))
    found = [warn("yield", F.abs(y - expected) > F.greatest(F.lit(1.0), expected * 0.03), "yield off production/area")]
    if planted is not None:
        found.append(warn("area", a > F.col(planted), "harvested above planted"))
    return df.select(key_text(keys).alias("key"), F.explode(F.array_compact(F.array(*found))).alias("w")).select("w.gate", "key", "w.detail")


def confirmed_scan(scanned: DataFrame, expected: DataFrame, key: str, gate: str = "empty") -> DataFrame:
    """A zero needs a scan that read something: an empty input, or an expected key without rows, fails."""
    return violations(expected.select(key).join(scanned.select(key).distinct(), key, "left_anti"), gate, [key], "absent from the scan")


def schema_differences(actual: T.StructType, expected: T.StructType) -> list[str]:
    """Missing, extra and differently typed fields by path."""
    from ..functions.documents import field_paths

    a = {p: t.simpleString() for p, t in field_paths(actual)}
    e = {p: t.simpleString() for p, t in field_paths(expected)}
    return sorted(
        [f"missing {p}" for p in e.keys() - a.keys()] + [f"extra {p}" for p in a.keys() - e.keys()]
        + [f"{p}: {a[p]} is not {e[p]}" for p in a.keys() & e.keys() if a[p] != e[p]]
    )


def export_matches(exported: DataFrame, derived: DataFrame, gate: str = "export") -> DataFrame:
    """A read-back export equals the re-derived data as a multiset, both ways."""
    if exported.columns != derived.columns:
        raise GateFailure(f"columns {exported.columns} are not {derived.columns}")
    cols = derived.columns
    text = lambda df, a, b: df.select(*[F.col(c).cast("string").alias(c) for c in cols], F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    both = text(exported, 1, 0).unionByName(text(derived, 0, 1))
    g = both.groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).filter(F.col("_a") != F.col("_b"))
    return violations(g, gate, cols, F.concat_ws("/", F.col("_a").cast("string"), F.col("_b").cast("string")))


def revalidate(df: DataFrame, keys: Sequence[str], value: str, status: str) -> DataFrame:
    """Reader-side check of a published panel: unique keys, value and status agree, no negatives."""
    from ..functions.cells import finite, status_consistent

    return unique_keys(df, keys).unionByName(rules(df, keys, {
        "status": status_consistent(F.col(value), F.col(status)),
        "range": F.col(value).isNull() | (finite(F.col(value)) & (F.col(value) >= 0)),
    }))


def last_is_latest(df: DataFrame, keys: Sequence[str], month: str, latest: str, gate: str = "latest") -> DataFrame:
    """The declared latest month is the last one of the series; an unreadable one is a violation."""
    ordinal = lambda c: F.when(is_month(F.col(c)), month_ordinal(F.col(c)))
    text = lambda n: F.concat(F.lpad(F.floor(n / 12).cast("string"), 4, "0"), F.lpad((n % 12 + 1).cast("string"), 2, "0"))
    g = df.groupBy(*keys).agg(F.max(ordinal(month)).alias("_m"), F.max(ordinal(latest)).alias("_l"))
    bad = g.filter(~F.coalesce(F.col("_m") == F.col("_l"), F.lit(False)))
    return violations(bad, gate, keys, F.concat_ws("/", text(F.col("_m")), text(F.col("_l"))))
