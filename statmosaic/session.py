"""Session, scratch space, parameter tables and skew-aware joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_OWN_SCRATCH: dict[str, str] = {}


def build_session(app: str = "statmosaic", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # keep splitting hot keys even when that costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # the JVM does not compile methods above 8,000 bytes: wide rows then run faster uncombined
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.legacy.javaCharsets": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = tempfile.mkdtemp(prefix="statmosaic-")
    return _OWN_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/statmosaic/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a written table, so a lost executor replays files only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def param_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A driver-supplied mapping as a local relation, whose measured size tells Spark whether to broadcast it."""
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)

    def column(values: tuple, kind: T.DataType) -> pa.Array:
        try:
            return pa.array(values, type=to_arrow_type(kind))
        except (pa.ArrowInvalid, pa.ArrowTypeError):  # another Python type: Spark casts it
            return pa.array(values)

    local = pa.Table.from_arrays([column(v, f.dataType) for v, f in zip(columns, fields, strict=True)], names=[f"c{i}" for i in range(len(fields))])
    return spark.createDataFrame(local).select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def lit_array(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def salted_join(
    facts: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Equi-join of many facts with a frame that has few rows per key.

    The fact side is spread over ``salts`` sub-keys by its own content, and each
    row of the other side is repeated once per sub-key, so a key holding a third
    of all facts lands on ``salts`` tasks.  Exact for inner, left and left_semi.  The salt
    is a hash of the row, so a repeated task makes the same split; wholly identical rows
    share a salt and are left to the skew split of adaptive execution.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"salted_join cannot be exact for {how}")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns if not _is_map(facts, c)]), F.lit(salts))
    left = facts.withColumn("_salt", spread.cast("int"))
    right = per_key.withColumn("_salt", F.explode(lit_array(range(salts))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def attach_group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], bounded: bool) -> DataFrame:
    """Put per-group aggregates on every row.

    ``bounded=True`` is for panels, whose groups are as long as a classification or a
    calendar: one shuffle and a window, and what produced ``df`` runs once.
    ``bounded=False`` never brings a group together: the aggregate is reduced inside the
    tasks first and joined back by broadcast or a skew-split merge, at the price of
    computing ``df`` twice (pass a written table).
    """
    if bounded:
        w = Window.partitionBy(*keys)
        return df.withColumns({name: a.over(w) for name, a in aggs.items()})
    groups = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    for i, k in enumerate(keys):
        groups = groups.withColumnRenamed(k, f"_group{i}")
    same = F.lit(True)
    for i, k in enumerate(keys):  # a null key is a group like any other
        same = same & df[k].eqNullSafe(groups[f"_group{i}"])
    return df.join(groups, same, "left").select(*[df[c] for c in df.columns], *aggs)
