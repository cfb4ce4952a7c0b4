"""Set operations between snapshots, catalogs and expected cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lit_array
from .windows import top_per_key


def with_peers(own: DataFrame, *peers: DataFrame) -> DataFrame:
    out = own
    for p in peers:
        out = out.unionByName(p)
    return out


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Upsert whole partitions; the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_by(catalog: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Same without a table layout: rows of the refreshed keys give way to the new ones."""
    return catalog.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def tag_append(frames: Mapping[str, DataFrame], tag: str = "methodology") -> DataFrame:
    """Series of several sources in one table; the source label keeps them apart."""
    out = None
    for label, df in frames.items():
        row = df.withColumn(tag, F.lit(label))
        out = row if out is None else out.unionByName(row)
    return out


def expected_cells(territories: DataFrame, dims: Mapping[str, Sequence[str]]) -> DataFrame:
    """Every cell the request must return; each territory unfolds the requested lists."""
    out = territories
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(lit_array(values)))
    return out


def cell_differences(expected: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``missing`` (expected, not seen), ``unexpected`` and ``repeated`` cells, in one shuffle."""
    e = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_s"))
    s = seen.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_s"))
    g = e.unionByName(s).groupBy(*keys).agg(F.sum("_e").alias("wanted"), F.sum("_s").alias("found"))
    problem = (
        F.when((F.col("wanted") > 0) & (F.col("found") == 0), "missing")
        .when((F.col("wanted") == 0), "unexpected")
        .when(F.col("found") > 1, "repeated")
    )
    return g.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("wanted")


def dedup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with ``copies`` and ``conflict`` (its copies are not all identical).

    Identical copies fold; a conflicting key keeps its smallest copy only to be reported
    (``filter("NOT conflict")`` is the clean table, ``filter("conflict")`` the violations).
    Whole rows are grouping keys, so copies fold by hash inside the tasks, whatever their number; what is left
    is counted by key, and only the copies of conflicting keys are ordered.
    """
    rest = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys, *rest).agg(F.count(F.lit(1)).alias("_n"))
    # a struct is equal to another where its null fields are null in both; the counts share the rows' exchange
    placed = folded.withColumn("_key", F.struct(*keys)).repartition("_key")
    counts = placed.groupBy("_key").agg(F.sum("_n").alias("copies"), F.count(F.lit(1)).alias("_variants"))
    each = placed.join(counts.hint("shuffle_hash"), "_key")
    clean = each.where("_variants = 1")
    smallest = top_per_key(each.where("_variants > 1"), keys, [F.col(c).asc_nulls_first() for c in rest])
    return clean.unionByName(smallest).select(*keys, *rest, "copies", (F.col("_variants") > 1).alias("conflict"))


def same_keys(a: Column, b: Column) -> Column:
    """Are two key arrays equal as sets?"""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def exclusive(lists: Mapping[str, DataFrame], item: str) -> DataFrame:
    """Items that appear in more than one list."""
    return (
        tag_append(lists, "_list").select(item, "_list").distinct().groupBy(item).agg(F.min("_list").alias("first_list"), F.max("_list").alias("last_list"))
        .filter(F.col("first_list") != F.col("last_list"))
    )


def assemble(expected: DataFrame, results: DataFrame, key: str, reason: str) -> DataFrame:
    """One row per expected block; a block without a result is explicitly unavailable."""
    j = expected.join(results, key, "left")
    return j.withColumns({
        "status": F.coalesce("status", F.lit("unavailable")),
        "reason": F.when(F.col("status").isNull(), F.lit(reason)),
    })
