"""Disclosure control of small cells."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import field_paths
from ..session import attach_group

SMALL_LIMIT = 5


def is_small(c: Column, limit: int = SMALL_LIMIT) -> Column:
    return (c > 0) & (c < limit)


def suppress_primary(
    df: DataFrame, value: str, unit: str, status: str, person_units: Sequence[str], limit: int = SMALL_LIMIT
) -> DataFrame:
    """Person-like counts of 1 to ``limit``-1 lose their value; zero and institutions stay."""
    hit = F.col(status).isin("real", "derived") & F.col(unit).isin(*person_units) & is_small(F.col(value), limit)
    hit = F.coalesce(hit, F.lit(False))
    gone = F.col(value).isNull()
    return df.withColumns({
        value: F.when(~hit, F.col(value)),
        status: F.when(hit, "suppressed").when(gone, F.when(F.col(status).isin("real", "derived"), "unavailable").otherwise(F.col(status))).otherwise(F.col(status)),
    })


def suppress_siblings(
    df: DataFrame, group: Sequence[str], values: Sequence[str], status: str, triggers: Column | None = None,
    bounded: bool = True,
) -> DataFrame:
    """If one member of a group is suppressed, all of them are, with every value column.

    ``triggers`` limits which members may start it (all by default).  ``df`` has one row
    per published cell, so a group is as long as its classification; for anything else
    pass ``bounded=False``.
    """
    start = (F.col(status) == "suppressed") & (triggers if triggers is not None else F.lit(True))
    marked = attach_group(df, group, {"_hit": F.max(start)}, bounded)
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return marked.withColumns({
        **{v: F.when(~hit, F.col(v)) for v in values},
        status: F.when(hit, "suppressed").otherwise(F.col(status)),
    }).drop("_hit")


def merge_small(
    df: DataFrame, keys: Sequence[str], code: str, inflow: str = "admissions", outflow: str = "dismissals",
    limit: int = SMALL_LIMIT,
) -> DataFrame:
    """Fold small categories into ``other`` until ``other`` itself is not small.

    Categories with a count of 1..limit-1 go to ``other``.  While ``other`` is small, the
    smallest visible category (by inflow + outflow, then code) joins it.  If nothing is
    left to join, the whole breakdown is suppressed: one row without values.

    "The first safe prefix" is a running sum over the categories of one group in absorption
    order, so no loop is needed.  Groups are as long as the classification: one row per
    category must come in.
    """
    i, o = F.col(inflow), F.col(outflow)
    rows = df.filter((i != 0) | (o != 0)).withColumn("_small", is_small(i, limit) | is_small(o, limit))
    order = [F.desc("_small"), (i + o).asc(), F.col(code).asc()]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    start = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    staged = rows.withColumns({
        "_in": F.coalesce(F.sum(inflow).over(before), F.lit(0)),
        "_out": F.coalesce(F.sum(outflow).over(before), F.lit(0)),
        "_any": F.max("_small").over(start),
    })
    # for a visible row: is "other" still unsafe just before it would join?
    unsafe = is_small(F.col("_in"), limit) | is_small(F.col("_out"), limit)
    staged = staged.withColumn("_open", F.when(~F.col("_small"), F.col("_any") & unsafe))
    joined = F.col("_small") | F.coalesce(F.min("_open").over(upto), F.lit(False))
    folded = (
        # the fold is told by its flag, so a published category named "other" stays itself
        staged.withColumns({"_fold": joined, "_code": F.when(joined, F.lit("other")).otherwise(F.col(code))})
        .groupBy(*keys, "_fold", "_code")
        .agg(F.sum(inflow).alias(inflow), F.sum(outflow).alias(outflow))
    )
    group = Window.partitionBy(*keys)
    is_other = F.col("_fold")
    small_other = is_other & (is_small(F.col(inflow), limit) | is_small(F.col(outflow), limit))
    checked = folded.withColumns({
        "_bad": F.max(small_other).over(group), "_agg": F.max(is_other).over(group),
    })
    status = F.when(F.col("_bad"), "suppressed").when(F.col("_agg"), "aggregated").otherwise("complete")
    keep = ~F.col("_bad") | is_other
    shown = lambda c: F.when(~F.col("_bad"), c)
    return checked.filter(keep).select(
        *keys, shown(F.col("_code")).alias(code), shown(F.col(inflow)).alias(inflow), shown(F.col(outflow)).alias(outflow),
        shown(F.col(inflow) - F.col(outflow)).alias("balance"), status.alias("privacy"),
    )


def display_order(df: DataFrame, keys: Sequence[str], label: str, inflow: str = "admissions") -> DataFrame:
    return df.orderBy(*keys, F.desc(inflow), F.asc(label))


def sampled(value: Column, n: Column, minimum: int = SMALL_LIMIT) -> Column:
    """A mean is shown only from a minimum sample."""
    return F.when(n >= minimum, value)


def forbidden_fields(schema: T.StructType, allowed: Iterable[str], named: Iterable[str] = (), identifiers: Iterable[str] = ()) -> list[str]:
    """Paths outside the allow-list, names outside their allowed paths, identifiers anywhere."""
    allowed, named, identifiers = set(allowed), set(named), {i.lower() for i in identifiers}
    bad = []
    for path, _ in field_paths(schema):
        leaf = path.split(".")[-1].rstrip("[]{}")
        if leaf.lower() in identifiers or path not in allowed or (leaf == "name" and path not in named):
            bad.append(path)
    return sorted(set(bad))


def leaks(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    """Published rows whose text carries a personal identifier; one row per column and match count."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])
    return (
        df.select(F.explode(cells).alias("c")).filter(F.col("c.text").rlike(pattern))
        .groupBy(F.col("c.column").alias("column")).agg(F.count(F.lit(1)).alias("rows"))
    )
