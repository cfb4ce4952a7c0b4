"""Aggregations of ledgers, registries and panels.

All of them are plain grouped aggregates, so Spark combines before its shuffle and a
hot group reaches the reducer as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach_group


def flow_counts(sign: str = "sign", weight: str = "weight") -> list[Column]:
    """Admissions, dismissals and balance of signed, weighted movements."""
    s, w = F.col(sign), F.col(weight)
    return [
        F.sum(F.when(s == 1, w).otherwise(0)).cast("bigint").alias("admissions"),
        F.sum(F.when(s == -1, w).otherwise(0)).cast("bigint").alias("dismissals"),
        F.sum(s * w).cast("bigint").alias("balance"),
    ]


def ledger(moves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed movement ledger by original event month; weight -1 retracts an earlier movement."""
    return moves.groupBy(*keys).agg(*flow_counts())


def breakdowns(moves: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Total and one-dimensional breakdowns together: ``axis`` (``total`` or dim), ``category``.

    The rows are first reduced on all dimensions, so the grouping sets expand a small table.
    """
    small = moves.groupBy(*keys, *dims).agg(*flow_counts())
    keyed = [F.col(k) for k in keys]
    sets = [keyed, *[[*keyed, F.col(d)] for d in dims]]
    grouped = small.groupingSets(sets, *keyed, *[F.col(d) for d in dims]).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("admissions", "dismissals", "balance")],
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    axis, category = F.lit("total"), F.lit("total")
    for d in dims:
        axis = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(axis)
        category = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(category)
    return grouped.select(*keys, axis.alias("axis"), category.alias("category"), "admissions", "dismissals", "balance")


def mean_with_sample(value: Column, weight: Column, eligible: Column, minimum: int = 5) -> list[Column]:
    """Weighted mean published only from ``minimum`` net observations; retractions reduce both parts."""
    return mean_of_sums(*sample_sums(value, weight, eligible), minimum)


def sample_sums(value: Column, weight: Column, eligible: Column) -> tuple[Column, Column]:
    """Net observations and their weighted total, which add up over any split of the rows."""
    return F.sum(F.when(eligible, weight)), F.sum(F.when(eligible, value * weight))


def mean_of_sums(n: Column, total: Column, minimum: int = 5) -> list[Column]:
    """The mean of :func:`mean_with_sample` from its two sums."""
    ok = n >= minimum
    return [
        F.when(ok, total.cast("double") / n.cast("double")).alias("mean"),
        F.when(ok, n).cast("bigint").alias("sample"),
        F.when(ok, "available").otherwise("unavailable").alias("mean_status"),
    ]


def null_sum(c: Column) -> Column:
    """Sum that is null as soon as one member is missing, and for no members."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def known_share(flag: Column) -> list[Column]:
    """Share of yes among the known; the unknown are counted apart, never as no."""
    known, yes = F.count(flag), F.count_if(flag)
    return [
        yes.alias("with_resource"), known.alias("considered"), (F.count(F.lit(1)) - known).alias("missing"),
        F.when(known > 0, yes / known * 100).alias("percent"),
    ]


def with_total(
    df: DataFrame, keys: Sequence[str], category: str, sums: Sequence[Column], final: Sequence[Column] | None = None, label: str = "Total",
) -> DataFrame:
    """Rows per category plus their total.

    ``sums`` are named sums and counts: they are taken per category first, so that only that small table is
    expanded for the total.  ``final`` are named columns over them (by default the sums themselves).
    """
    small = df.groupBy(*keys, category).agg(*sums)
    names = small.columns[len(keys) + 1 :]
    keyed = [F.col(k) for k in keys]
    g = small.groupingSets([keyed, [*keyed, F.col(category)]], *keyed, F.col(category)).agg(
        *[F.sum(n).alias(n) for n in names], F.grouping(category).alias("_g"))
    named = F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(category)).alias(category)
    return g.select(*keys, named, *(final if final is not None else names))


def grand_total(df: DataFrame, key: str, sums: Sequence[Column], label: str = "Total") -> DataFrame:
    return with_total(df, [], key, sums, label=label)


def conditional_counts(df: DataFrame, keys: Sequence[str], predicates: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(p).alias(name) for name, p in predicates.items()])


def frequency(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Counts per label, largest first, then by label."""
    return (
        df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys, F.desc("n"), F.asc(label))
    )


def bands(df: DataFrame, keys: Sequence[str], band: Column, split: str, parts: Sequence[str], value: str) -> DataFrame:
    """Disjoint bands with one column per part and their sum; ``balanced`` compares with a given total."""
    g = df.withColumn("band", band).groupBy(*keys, "band").pivot(split, list(parts)).agg(F.sum(value))
    total = F.coalesce(F.col(parts[0]), F.lit(0))
    for p in parts[1:]:
        total = total + F.coalesce(F.col(p), F.lit(0))
    return g.withColumn("total", total)


def distribution(
    parts: DataFrame, totals: DataFrame, keys: Sequence[str], value: str = "value", bounded: bool = True
) -> DataFrame:
    """Category values as a percentage of the *published* total, with whether the parts add up to it.

    ``parts`` has one row per category (else ``bounded=False``).
    """
    t = totals.select(*keys, F.col(value).alias("total"))
    summed = attach_group(parts, keys, {"_parts": F.sum(value)}, bounded)
    return (
        summed.join(t, list(keys), "left")
        .withColumn("percent", F.when(F.col("total") > 0, F.col(value) / F.col("total") * 100))
        .withColumn("balanced", F.col("_parts") == F.col("total"))
        .drop("_parts")
    )


def class_panel(long: DataFrame, keys: Sequence[str], cls: str, path: str, period: str, value: str) -> DataFrame:
    """Area per terminal class and period, summed over sub-areas (such as biomes)."""
    return long.groupBy(*keys, cls, path, period).agg(F.sum(value).alias(value))


def semantic_groups(
    panel: DataFrame, keys: Sequence[str], cls: str, path: str, value: str,
    prefixes: Mapping[str, str], codes: Mapping[str, Sequence], conditions: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Overlapping groups of classes side by side: by path prefix, by code set or by any condition."""
    zero = F.lit(0)
    cols = [F.sum(F.when(F.col(path).startswith(p), F.col(value)).otherwise(zero)).alias(n) for n, p in prefixes.items()]
    cols += [F.sum(F.when(F.col(cls).isin(*c), F.col(value)).otherwise(zero)).alias(n) for n, c in codes.items()]
    cols += [F.sum(F.when(c, F.col(value)).otherwise(zero)).alias(n) for n, c in (conditions or {}).items()]
    return panel.groupBy(*keys).agg(*cols)


def covered_counts(events: DataFrame, spine: DataFrame, coverage: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Event counts on a dense calendar: zero in a covered period, null where nothing was covered."""
    counts = events.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("_n"))
    j = spine.join(counts, [*keys, period], "left").join(
        coverage.select(period).distinct().withColumn("_covered", F.lit(True)), period, "left"
    )
    covered = F.coalesce(F.col("_covered"), F.lit(False))
    return j.select(
        *keys, period, covered.alias("available"),
        F.when(covered, F.coalesce("_n", F.lit(0))).cast("bigint").alias("count"),
    )


def annual_coverage(monthly: DataFrame, keys: Sequence[str], year: Column) -> DataFrame:
    """Yearly counts with the number of covered months; ``complete`` only with all twelve."""
    return monthly.groupBy(*keys, year.alias("year")).agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count"),
        F.count_if("available").alias("coverage_months"),
        (F.count_if("available") == 12).alias("complete"),
    )


def capacity(units: DataFrame, spine: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Capacity sums on a spine that was read to its end: no unit is a confirmed zero."""
    g = units.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("units"))
    return spine.join(g, list(keys), "left").select(
        *keys, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures],
        F.coalesce("units", F.lit(0)).alias("units"), F.col("units").isNull().alias("zero_confirmed"),
    )


def leader(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Category with the largest value per group; equal values resolve to the smallest label."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l")))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.l").alias(label), (-F.col("_b.v")).alias(value)
    )


def stock_and_mean(df: DataFrame, key: str, sector: str, value: str, minimum: int = 5) -> DataFrame:
    """Stock, positive-value sample, uncovered rest and mean per sector and in total."""
    v = F.col(value)
    positive, n = v > 0, F.col("_n")
    enough = n >= minimum
    return with_total(
        df, [key], sector,
        [F.count(F.lit(1)).alias("stock"), F.count_if(positive).alias("_n"), F.sum(F.when(positive, v)).alias("_s")],
        [
            F.col("stock"), F.when(enough, n).alias("sample"), F.when(enough, F.col("stock") - n).alias("missing_or_zero"),
            F.when(enough, F.col("_s").cast("double") / n).alias("mean"),
        ],
    )


def reference_range(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """First and last period per key; rows are reduced to distinct periods by hash before texts are compared."""
    return df.select(*keys, period).distinct().groupBy(*keys).agg(F.min(period).alias("first"), F.max(period).alias("reference"))


def subset_share(df: DataFrame, keys: Sequence[str], value: str, subset: Column) -> DataFrame:
    part, whole = F.sum(F.when(subset, F.col(value)).otherwise(0)), F.sum(value)
    return df.groupBy(*keys).agg(part.alias("part"), whole.alias("whole"), F.when(whole > 0, part / whole * 100).alias("share"))


def sorted_set(c: Column) -> Column:
    """Distinct values in order, for dimensions of a known small domain (units, years, biomes)."""
    return F.array_sort(F.collect_set(c))


def bounding_box(df: DataFrame, keys: Sequence[str], x: Column, y: Column, pad: float = 0.0) -> DataFrame:
    return df.groupBy(*keys).agg(
        (F.min(x) - pad).alias("min_x"), (F.min(y) - pad).alias("min_y"),
        (F.max(x) + pad).alias("max_x"), (F.max(y) + pad).alias("max_y"),
    )


def headline(df: DataFrame, keys: Sequence[str], indicator: str, period: str, value: str) -> DataFrame:
    """Catalog rows: the value at the latest period that has one."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max(period).alias("reference"), F.max_by(F.col(value), F.col(period)).alias("value")
    ).withColumn("indicator", F.lit(indicator))
