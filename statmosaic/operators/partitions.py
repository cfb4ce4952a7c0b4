"""Publications by partition: every partition carries an additive digest, and only those whose digest moved are touched.

A digest is the number of rows and two sums of 64-bit row hashes, so it follows from partial sums in any order and
counts repeated rows.  A manifest (one row a partition) names the version each partition lies in; its pointer is written
last, so a publication that breaks off leaves the one before in place.  The driver reads manifests only: rows as many
as there are partitions, never data.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.documents import VOLATILE, canonical_json
from ..session import param_table
from .quality import require

MANIFEST = "part string, version string, row_count bigint, low decimal(38,0), high decimal(38,0)"
POINTER = "moved bigint, manifest string, columns string"
_PART = "_part_key"
_DIGEST = ("row_count", "low", "high")


def part_key(partition: Sequence[str]) -> Column:
    """Name of a row's partition; a null or empty value is a partition like any other."""
    return F.md5(canonical_json(partition))


def partition_digests(df: DataFrame, partition: Sequence[str], volatile: Sequence[str] = VOLATILE) -> DataFrame:
    """(part, row_count, low, high): one hash aggregate; collection dates are left out."""
    if _PART in df.columns:
        raise ValueError(f"column {_PART} is reserved")
    content = canonical_json([c for c in df.columns if c not in volatile])
    rows = df.select(part_key(partition).alias("part"), content.alias("_content"))
    sums = [F.sum(F.xxhash64(F.lit(i), "_content").cast("decimal(20,0)")).cast("decimal(38,0)").alias(n) for i, n in enumerate(("low", "high"))]
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("row_count"), *sums)


def _pointer(spark: SparkSession, root: str) -> Row | None:
    """(manifest, columns) of the newest publication; one row a publication is read."""
    try:
        pointers = spark.read.schema(POINTER).option("recursiveFileLookup", "true").json(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return pointers.agg(F.max_by(F.struct("manifest", "columns"), "moved")).first()[0]


def _entries(spark: SparkSession, at: Row | None) -> dict[str, Row]:
    return {} if at is None else {r["part"]: r for r in spark.read.schema(MANIFEST).json(at["manifest"]).collect()}


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The newest manifest; no rows before the first publication."""
    at = _pointer(spark, root)
    return param_table(spark, [], MANIFEST) if at is None else spark.read.schema(MANIFEST).json(at["manifest"])


def _digest(row: Row) -> tuple:
    return tuple(row[c] for c in _DIGEST)


def moved_partitions(before: Mapping[str, Row], after: Mapping[str, Row]) -> dict[str, str]:
    """``same``, ``changed``, ``new`` or ``gone`` for every partition of two manifests, by their digests."""
    out = {p: "gone" for p in before if p not in after}
    for p, row in after.items():
        out[p] = "new" if p not in before else "same" if _digest(row) == _digest(before[p]) else "changed"
    return out


def publish_partitions(
    df: DataFrame, root: str, version: str, partition: Sequence[str],
    gates: Callable[[DataFrame], Sequence[DataFrame]], volatile: Sequence[str] = VOLATILE,
) -> DataFrame:
    """Write, check and publish the partitions whose contents moved; the others stay where they lie.

    ``df`` is read for its digests and once more for what moved, so pass a written table.  The gates see the staged
    partitions alone: their rules must hold partition by partition.  A gate that finds anything leaves the publication
    before in place.  Other columns than those published before move every partition.  Returns (part, status).
    """
    spark = df.sparkSession
    at = _pointer(spark, root)
    held = _entries(spark, at) if at is not None and at["columns"] == df.schema.json() else {}
    now = {r["part"]: r for r in partition_digests(df, partition, volatile).collect()}
    status = moved_partitions(held, now)
    moved = [p for p, s in status.items() if s in ("new", "changed")]
    base = f"{root}/data/version={version}"
    if moved:
        staged = df.withColumn(_PART, part_key(partition)).where(F.col(_PART).isin(moved))
        staged.write.mode("overwrite").partitionBy(_PART).parquet(base)
        require(*gates(spark.read.schema(df.schema).parquet(base)))
    stamp = time.time_ns()
    path = f"{root}/manifests/{stamp}"
    whole = [(p, version if status[p] != "same" else held[p]["version"], *_digest(r)) for p, r in now.items()]
    param_table(spark, whole, MANIFEST).coalesce(1).write.json(path)
    param_table(spark, [(stamp, path, df.schema.json())], POINTER).coalesce(1).write.json(f"{root}/pointers/{stamp}")
    return param_table(spark, list(status.items()), "part string, status string")


def _read(spark: SparkSession, root: str, at: Row, entries: Mapping[str, Row], parts: Sequence[str]) -> DataFrame:
    schema = StructType.fromJson(json.loads(at["columns"]))
    paths = [f"{root}/data/version={entries[p]['version']}/{_PART}={p}" for p in parts if p in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _published(spark: SparkSession, root: str) -> tuple[Row, dict[str, Row]]:
    at = _pointer(spark, root)
    if at is None:
        raise ValueError(f"nothing is published below {root}")
    return at, _entries(spark, at)


def read_partitions(spark: SparkSession, root: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The published table, or the named partitions of it; files of no other partition are listed or opened."""
    at, entries = _published(spark, root)
    return _read(spark, root, at, entries, list(entries) if parts is None else parts)


def judge_moved(
    spark: SparkSession, roots: Mapping[str, str], record: str, gate: Callable[[Mapping[str, DataFrame]], DataFrame],
) -> tuple[DataFrame, list[str]]:
    """What ``gate`` finds in the partitions that moved, in any of the tables, since they were last found right.

    The tables have the same partition columns; the gate gets each of them cut to the moved partitions (a summary and
    its detail, say).  Digests of partitions without findings of their run are kept below ``record``; a run with
    findings keeps none of its own, so its partitions are judged again.  Returns (findings, parts read).
    """
    tables = {n: _published(spark, root) for n, root in sorted(roots.items())}
    now: dict[str, str] = {}
    for n, (_, entries) in tables.items():
        for p, row in entries.items():
            now[p] = f"{now.get(p, '')}|{n}:{_digest(row)}"
    schema = "moved bigint, checked map<string, string>"
    try:
        kept = spark.read.schema(schema).option("recursiveFileLookup", "true").json(record)
        checked = kept.agg(F.max_by("checked", "moved")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        checked = {}
    moved = sorted(p for p, m in now.items() if checked.get(p) != m)
    found = gate({n: _read(spark, roots[n], at, entries, moved) for n, (at, entries) in tables.items()})
    if moved and found.isEmpty():
        stamp = time.time_ns()
        param_table(spark, [(stamp, list(now.items()))], schema).coalesce(1).write.json(f"{record}/{stamp}")
    return found, moved
