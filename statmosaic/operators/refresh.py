"""Incremental refresh: what changed, what keeps its date, what is published."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import VOLATILE, content_digest
from .aggregates import flow_counts
from .joins import changed_rows
from .quality import require


def content_differences(candidate: DataFrame, previous: DataFrame, volatile: Sequence[str] = VOLATILE) -> DataFrame:
    """Row contents (without collection dates) that only one side has, as a multiset; empty = unchanged."""
    a = candidate.select(content_digest(candidate, volatile).alias("digest"), F.lit(1).alias("_d"))
    b = previous.select(content_digest(previous, volatile).alias("digest"), F.lit(-1).alias("_d"))
    return a.unionByName(b).groupBy("digest").agg(F.sum("_d").alias("difference")).filter(F.col("difference") != 0)


def keep_or_replace(candidate: DataFrame, previous: DataFrame, volatile: Sequence[str] = VOLATILE) -> DataFrame:
    """The previous snapshot, dates included, when only collection dates moved."""
    return previous if content_differences(candidate, previous, volatile).isEmpty() else candidate


def retain_dates(sources: DataFrame, previous: DataFrame, now: Column, identity: Sequence[str]) -> DataFrame:
    """A source whose hash, address and reference did not move keeps its collection date."""
    p = previous.select(*identity, F.col("collected_at").alias("_before"))
    return sources.join(p, list(identity), "left").withColumn(
        "collected_at", F.coalesce(F.col("_before"), now)
    ).drop("_before")


def revision_log(
    previous: DataFrame, current: DataFrame, keys: Sequence[str], fields: Sequence[str], detected: Column
) -> DataFrame:
    """Past periods whose figures changed, with before, after and time of detection."""
    return changed_rows(previous, current, keys, fields).withColumn("detected_at", detected)


def ledger_revisions(
    moves: DataFrame, keys: Sequence[str], publication: str, cutoff: str, detected: Column,
    wage: Column | None = None, eligible: Column | None = None, minimum: int = 5,
) -> DataFrame:
    """Revisions of a movement ledger since a publication, when the movements themselves are at hand.

    Both states come out of one aggregation instead of two passes and a join.  With ``wage`` and
    ``eligible`` the mean admission wage is compared as well, as far as its sample is large enough.
    """
    early = F.col(publication) <= cutoff
    s, w = F.col("sign"), F.col("weight")
    fields = ["admissions", "dismissals", "balance"]
    figures = [
        *flow_counts(),
        *[c.cast("bigint").alias(f"previous_{n}") for n, c in (
            ("admissions", F.sum(F.when(early & (s == 1), w).otherwise(0))), ("dismissals", F.sum(F.when(early & (s == -1), w).otherwise(0))),
            ("balance", F.sum(F.when(early, s * w).otherwise(0))))],
    ]
    if wage is not None:
        fields.append("admission_wage")
        for name, known in (("admission_wage", F.lit(True)), ("previous_admission_wage", early)):
            counted = known & (s == 1) & (F.lit(True) if eligible is None else eligible)
            n, total = F.sum(F.when(counted, w)), F.sum(F.when(counted, wage * w))
            figures.append(F.when(n >= minimum, total.cast("double") / n.cast("double")).alias(name))
    g = moves.groupBy(*keys).agg(*figures, F.max(early).alias("_known"))
    same = F.lit(True)
    for n in fields:
        same = same & F.col(n).eqNullSafe(F.col(f"previous_{n}"))
    return g.filter(F.col("_known") & ~same).drop("_known").withColumn("detected_at", detected)


POINTER = "moved bigint, version string, path string"


def publish(
    df: DataFrame, root: str, version: str, gates: Callable[[DataFrame], Sequence[DataFrame]]
) -> str:
    """Stage under a version, read back, run the gates, then move the pointer.

    A failing gate leaves the pointer on the last good version.  A move of the pointer adds a file and
    takes none away, so a publication that breaks off leaves the version before it in place.
    """
    spark = df.sparkSession
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    require(*gates(spark.read.parquet(path)))
    moved = time.time_ns()
    pointer = spark.createDataFrame([(moved, version, path)], POINTER).coalesce(1)
    pointer.write.json(f"{root}/pointers/{moved}")
    return path


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the newest pointer names."""
    pointers = spark.read.schema(POINTER).option("recursiveFileLookup", "true").json(f"{root}/pointers")
    return spark.read.parquet(pointers.agg(F.max_by("path", "moved")).first()[0])


GROUP_POINTER = "moved bigint, version string, tables map<string, string>"


def group_paths(spark: SparkSession, root: str) -> dict[str, str]:
    """Where the tables of the group's newest version lie; empty before the first one."""
    try:
        pointers = spark.read.schema(GROUP_POINTER).option("recursiveFileLookup", "true").json(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    newest = pointers.agg(F.max("moved")).first()[0]  # one row a publication
    return dict(pointers.where(F.col("moved") == newest).first()["tables"])


def published_group(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the group's newest version."""
    return {name: spark.read.parquet(path) for name, path in group_paths(spark, root).items()}


def publish_group(
    spark: SparkSession, tables: Mapping[str, DataFrame], root: str, version: str,
    gates: Callable[[Mapping[str, DataFrame]], Sequence[DataFrame]],
    derived: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]] | None = None,
) -> dict[str, str]:
    """Tables that must move together: all are staged and read back, then one manifest file names the version of each.

    A gate that finds anything refuses the whole group, so every table stays at its last good version; so does a
    publication that breaks off before the manifest.  A table whose contents did not move stays where it lies.
    ``derived`` makes further tables of the group from the staged ones.
    """
    held = group_paths(spark, root)
    paths = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{root}/{name}/version={version}"
        df.write.mode("overwrite").parquet(paths[name])
        staged = spark.read.parquet(paths[name])
        if name in held and content_differences(staged, spark.read.parquet(held[name])).isEmpty():
            paths[name] = held[name]
        return staged

    staged = {name: stage(name, df) for name, df in tables.items()}
    require(*gates(staged))
    for name, df in (derived(staged) if derived else {}).items():
        stage(name, df)
    moved = time.time_ns()
    spark.createDataFrame([(moved, version, paths)], GROUP_POINTER).coalesce(1).write.json(f"{root}/pointers/{moved}")
    return paths


def refresh_group(
    spark: SparkSession, root: str, version: str, tables: Mapping[str, DataFrame],
    gates: Callable[[Mapping[str, DataFrame]], Sequence[DataFrame]], series: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    sources: DataFrame, identity: Sequence[str], now: Column,
) -> dict[str, str]:
    """One refresh of a module: stage, validate, publish together, log revisions, keep dates.

    ``series`` gives key and figures of the tables whose past may be revised; what changed under a key that was
    published before goes to ``revisions_<table>``, which keeps its earlier entries.  ``sources`` lists what was read;
    one that did not move keeps its date of collection.  Every table is computed once, when it is staged.
    """
    held = published_group(spark, root)

    def derived(staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out = {"sources": retain_dates(sources, held["sources"], now, identity) if held else sources.withColumn("collected_at", now)}
        for name, (keys, fields) in series.items():
            log = f"revisions_{name}"
            new = revision_log(held.get(name, staged[name].limit(0)), staged[name], keys, fields, now)
            out[log] = held[log].unionByName(new) if log in held else new
        return out

    return publish_group(spark, tables, root, version, gates, derived)


def isolate_failures(results: DataFrame, group: str, together: Sequence[str] = ()) -> DataFrame:
    """Usable source results.  A failed source drops alone, except in groups that move together."""
    bad = results.filter((F.col("status") != "ok") & F.col(group).isin(*together)).select(group).distinct()
    return results.filter(F.col("status") == "ok").join(bad, group, "left_anti")


def new_periods(available: DataFrame, published_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is offered and not yet held; empty means the run is skipped."""
    return available.select(*keys).distinct().join(published_.select(*keys).distinct(), list(keys), "left_anti")


def carry_forward(current: DataFrame, previous: DataFrame, keys: Sequence[str], unchanged: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Keep a verified result while the totals it was checked against stay equal."""
    p = previous.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in unchanged], *[F.col(c).alias(f"_c_{c}") for c in carried])
    j = current.join(p, list(keys), "left")
    same = F.lit(True)
    for c in unchanged:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    out = j.withColumns({c: F.coalesce(F.col(c), F.when(same, F.col(f"_c_{c}"))) for c in carried})
    return out.drop(*[f"_p_{c}" for c in unchanged], *[f"_c_{c}" for c in carried])


def as_of(df: DataFrame, publication: str, cutoff: str, month: str | None = None, latest: str | None = None, length: int | None = None) -> DataFrame:
    """What was known at a publication date, limited to an event window if one is given."""
    out = df.filter(F.col(publication) <= cutoff)
    if month is not None and latest is not None:
        out = out.filter(F.col(month) <= latest)
        if length is not None:
            total = int(latest[:4]) * 12 + int(latest[-2:]) - length
            out = out.filter(F.col(month) >= f"{total // 12:04}{total % 12 + 1:02}")
    return out
