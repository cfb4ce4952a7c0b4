"""Joins of official tables.  Equi-joins only; a mismatch yields null or a violation, never a silent drop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_parts(parts: Mapping[str, DataFrame], key: Sequence[str], active: str | None = None) -> DataFrame:
    """Outer merge of N tables on a natural key in one shuffle.

    The parts are stacked and folded per key, so partial aggregation runs before the
    exchange whatever the number of parts.  Result: key, every column once, ``in_<part>``
    flags, ``conflicts`` (columns whose parts disagree) and ``incomplete`` (an active key
    that some part lacks).
    """
    columns: dict[str, T.DataType] = {}
    for df in parts.values():
        for f in df.schema.fields:
            if f.name not in key:
                columns.setdefault(f.name, f.dataType)
    stacked = None
    for name, df in parts.items():
        row = df.select(
            *key,
            # a struct tells "present but empty" from "this part has no such column"
            *[
                (F.struct(F.col(c).alias("v")) if c in df.columns else F.lit(None).cast(T.StructType([T.StructField("v", t)]))).alias(c)
                for c, t in columns.items()
            ],
            F.lit(name).alias("_part"),
        )
        stacked = row if stacked is None else stacked.unionByName(row)
    out = stacked.groupBy(*key).agg(
        *[F.min(c).alias(c) for c in columns],
        *[F.max(c).alias(f"_max_{c}") for c in columns],
        *[F.coalesce(F.max(F.col("_part") == p), F.lit(False)).alias(f"in_{p}") for p in parts],
    )
    clash = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"_max_{c}")), F.lit(c)) for c in columns
    ])) if columns else F.array().cast("array<string>")
    everywhere = F.lit(True)
    for p in parts:
        everywhere = everywhere & F.col(f"in_{p}")
    gap = ~everywhere & F.coalesce(F.col(f"_max_{active}.v").cast("string").isin("1", "true"), F.lit(False)) if active else ~everywhere
    return out.select(
        *key, *[F.col(f"_max_{c}.v").alias(c) for c in columns], *[f"in_{p}" for p in parts],
        clash.alias("conflicts"), gap.alias("incomplete"),
    )


def lookup(df: DataFrame, dictionary: DataFrame, code: str, width: int, label: str = "label") -> DataFrame:
    """Dictionary lookup with an ``unknown`` bucket.

    A well-formed code absent from the dictionary becomes ``unknown``; a malformed one is
    reported in ``<code>_problem``.  Dictionaries carry one row per code.
    """
    d = dictionary.select(F.col("code").alias(code), F.col("label").alias(label), F.lit(True).alias("_hit"))
    well_formed = F.col(code).rlike(rf"^\d{{{width}}}$")
    return (
        df.join(d, code, "left")
        .withColumn(f"{code}_problem", F.when(F.col("_hit").isNull() & ~F.coalesce(well_formed, F.lit(False)), "malformed"))
        .withColumn(code, F.when(F.col("_hit"), F.col(code)).when(well_formed, F.lit("unknown")).otherwise(F.col(code)))
        .drop("_hit")
    )


def label_strict(df: DataFrame, labels: DataFrame, code: str) -> DataFrame:
    """Legend join; every code must be in the legend (``mapping.unmapped`` lists those that are not)."""
    return df.join(labels.withColumnRenamed("code", code), code, "left")


def crosswalk(df: DataFrame, codes: DataFrame, short: str, full: str) -> DataFrame:
    """Six-digit to seven-digit (or any other) code translation; unknown codes drop."""
    return df.join(codes.select(F.col("short").alias(short), F.col("full").alias(full)), short, "inner")


def comparable(local: DataFrame, peers: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Peers beside the local figure: the peer's value shows only when every key agrees.

    ``keys`` are what makes two figures comparable (indicator, unit, method, period, base).
    Every peer row stays; ``comparable`` says whether it may be compared.  Several local figures under one
    key are none: ``local_repeated`` reports them, and nothing is compared with them.
    """
    own = local.groupBy(*keys).agg(F.count(F.lit(1)).alias("_own"), F.max(value).alias("local_value"))
    j = peers.join(own, list(keys), "left").withColumn("local_repeated", F.coalesce(F.col("_own") > 1, F.lit(False)))
    return (
        j.withColumn("local_value", F.when(~F.col("local_repeated"), F.col("local_value")))
        .withColumn("comparable", F.coalesce(F.col("_own") == 1, F.lit(False)))
        .withColumn("peer_value", F.when(F.col("comparable"), F.col(value)))
        .drop("_own")
    )


def leaves(df: DataFrame, path: str, within: Sequence[str] = (), sep: str = ".") -> DataFrame:
    """Rows whose path is not the prefix of another present path.

    Every path is cut into its proper prefixes, so finding the parents is an equi-join.
    """
    parts = F.split(F.col(path), "\\" + sep)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep),
    )
    parents = (
        df.filter(F.size(parts) > 1)
        .select(*within, F.explode(prefixes).alias(path))
        .distinct()
    )
    return df.join(parents, [*within, path], "left_anti")


def reconcile(computed: DataFrame, official: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Computed against official totals, zero tolerance: matched, mismatch, pending or missing."""
    a = computed.select(*keys, F.col(value).alias("computed"))
    b = official.select(*keys, F.col(value).alias("official"))
    return a.join(b, list(keys), "full_outer").withColumn(
        "status",
        F.when(F.col("official").isNull(), "pending").when(F.col("computed").isNull(), "missing")
        .when(F.col("computed") == F.col("official"), "matched").otherwise("mismatch"),
    )


def changed_rows(previous: DataFrame, current: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys in both snapshots whose fields differ, with before and after."""
    a = previous.select(*keys, *[F.col(f).alias(f"previous_{f}") for f in fields])
    b = current.select(*keys, *fields)
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"previous_{f}"))
    return b.join(a, list(keys), "inner").filter(~same)


def fallback(current: DataFrame, previous: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Take the previous edition's value where the current one is missing."""
    p = previous.select(*keys, F.col(value).alias("_previous"))
    return (
        current.join(p, list(keys), "left")
        .withColumn("carried", F.col(value).isNull() & F.col("_previous").isNotNull())
        .withColumn(value, F.coalesce(value, "_previous"))
        .drop("_previous")
    )


def superseded(monthly: DataFrame, annual: DataFrame, year: str = "year") -> DataFrame:
    """Monthly extracts of years that have no complete annual archive."""
    return monthly.join(annual.select(year).distinct(), year, "left_anti")


def matched_ratio(
    num: DataFrame, den: DataFrame, keys: Sequence[str], factor: float = 1.0,
    num_value: str = "numerator", den_value: str = "denominator",
) -> DataFrame:
    """Ratio of two tables where period and unit keys agree and the denominator is positive."""
    j = num.join(den, list(keys), "inner")
    return j.withColumn(
        "ratio", F.when(F.col(den_value) > 0, F.col(num_value) / F.col(den_value) * F.lit(factor))
    )


def one_membership(df: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """Region of each entity; ``problem`` when it has none or more than one."""
    m = members.groupBy(key).agg(F.min(group).alias(group), F.count_distinct(group).alias("_n"))
    return df.join(m, key, "left").withColumn(
        "problem", F.when(F.col("_n").isNull(), "no region").when(F.col("_n") > 1, "ambiguous region")
    ).drop("_n")


def in_scope(df: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in scope; the scope is reduced to its distinct keys before any shuffle."""
    return df.join(scope.select(*keys).distinct(), list(keys), "left_semi")


def missing_from(keys_of: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keys_of.select(*keys).distinct().join(part.select(*keys).distinct(), list(keys), "left_anti")
