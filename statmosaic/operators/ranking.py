"""Orders, rankings and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unaccent


def locale_key(name: Column) -> Column:
    """Sort key that ignores accents and case, then settles equal keys by the text itself."""
    return F.struct(F.lower(unaccent(name)).alias("k"), name.alias("n"))


def rank_products(
    df: DataFrame, keys: Sequence[str], value: str, name: str, eligible: Column, limit: int | None = None
) -> DataFrame:
    """Position by value, largest first, nulls last, then by name.

    ``df`` has one row per product and key, so a group is as long as its classification.
    With ``limit`` Spark keeps only the best rows of each task before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), locale_key(F.col(name)))
    ranked = df.filter(eligible).withColumn("position", F.row_number().over(w))
    return ranked if limit is None else ranked.filter(F.col("position") <= limit)


def top_with_tail(
    df: DataFrame, keys: Sequence[str], code: str, order: Sequence[Column], k: int, grouped: Sequence[str] = ("other", "unknown")
) -> DataFrame:
    """First ``k`` detailed categories, then the grouped ones, which never compete."""
    w = Window.partitionBy(*keys).orderBy(*order)
    is_tail = F.col(code).isin(*grouped)
    top = df.filter(~is_tail).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
    tail = df.filter(is_tail).withColumn("position", F.lit(k) + F.array_position(F.array(*[F.lit(g) for g in grouped]), F.col(code)).cast("int"))
    return top.unionByName(tail)


def smallest_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def by_priority(df: DataFrame, column: str, priority: Sequence[str]) -> DataFrame:
    """Fixed editorial order; ids that are not listed come last."""
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(column))
    return df.withColumn("priority", F.when(at > 0, at).otherwise(len(priority) + 1).cast("int")).orderBy("priority", column)


def registry_order(df: DataFrame, active: str, name: str, code: str) -> DataFrame:
    return df.orderBy(F.desc(active), name, code)


def catalog_order(df: DataFrame) -> DataFrame:
    return df.orderBy("module", "id")


def by_measure(df: DataFrame, measure: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), tie)


def first_matching(df: DataFrame, predicate: Column, order: Sequence[Column], n: int) -> DataFrame:
    return df.filter(predicate).orderBy(*order).limit(n)


def recent_years(df: DataFrame, year: str, n: int = 2) -> DataFrame:
    """Rows of the last ``n`` years, the newest year taken from the data.

    The years are reduced to their distinct values first; only those meet in one place.
    """
    years = df.select(year).distinct()
    newest = F.max(F.col(year).cast("int")).over(Window.partitionBy())
    recent = years.withColumn("_newest", newest).filter(F.col(year).cast("int") > F.col("_newest") - n).select(year)
    return df.join(recent, year, "left_semi")


def default_choice(df: DataFrame, keys: Sequence[str], label: str, *measures: str) -> DataFrame:
    """Preselected product: largest first measure, or the next one where it is absent."""
    value = F.coalesce(*[F.col(m) for m in measures], F.lit(-1))
    best = F.min(F.struct((-value).alias("v"), F.col(label).alias("l")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.l").alias(label), (-F.col("_b.v")).alias("value"))
