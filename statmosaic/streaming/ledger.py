"""Streaming form of the movement ledger.

State is one small sum per (territory, period), not events.  Every batch writes its
updated sums under its own batch id, so a replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregates import flow_counts
from ..operators.joins import changed_rows


FIELDS = ("admissions", "dismissals", "balance")
# Sums behind the mean admission wage, where a ledger carries wages.
WAGE_SUMS = ("wage_sum", "wage_count")


def as_instant(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def once_per_id(stream: DataFrame, ids: Sequence[str], time: str, delay: str) -> DataFrame:
    """One observation per official id, however often it is delivered within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(ids))


def daily_ledger(
    stream: DataFrame, time: str, delay: str, keys: Sequence[str], watermarked: bool = False,
    wage: Column | None = None, eligible: Column | None = None,
) -> DataFrame:
    """Signed sums per key and ``day`` of the event; late and retracting records update their own day.

    The day is a window on event time, so the watermark holds: a record that comes later than ``delay`` after
    the end of its day is dropped and counted, and days beyond it leave the state.  Longer periods are
    folded from days on reading (:func:`by_period`).  With ``wage`` the wages of (eligible) admissions are summed as well.
    """
    s = stream if watermarked else stream.withWatermark(time, delay)
    sums = list(flow_counts())
    if wage is not None:
        counted = (F.col("sign") == 1) & (F.lit(True) if eligible is None else eligible)
        sums += [F.sum(F.when(counted, wage * F.col("weight"))).alias("wage_sum"), F.sum(F.when(counted, F.col("weight"))).cast("bigint").alias("wage_count")]
    days = s.groupBy(*keys, F.window(time, "1 day").alias("_w")).agg(*sums)
    return days.select(*keys, F.to_date("_w.start").alias("day"), *_sums(days))


def _sums(df: DataFrame) -> list[str]:
    return [c for c in (*FIELDS, *WAGE_SUMS) if c in df.columns]


def current_state(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest sums per key among written batches."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*_sums(updates)), F.col("batch")).alias("_s")).select(*keys, "_s.*")


def by_period(days: DataFrame, keys: Sequence[str], period: Column) -> DataFrame:
    """Days folded to a longer period computed from ``day``."""
    return days.groupBy(*keys, period.alias("period")).agg(*[F.sum(f).alias(f) for f in _sums(days)])


def figures(state: DataFrame, minimum: int = 5) -> DataFrame:
    """Sums as they are published: counts, and the mean wage where its sample is large enough."""
    if "wage_sum" not in state.columns:
        return state
    mean = F.when(F.col("wage_count") >= minimum, F.col("wage_sum").cast("double") / F.col("wage_count"))
    return state.withColumn("admission_wage", mean).drop(*WAGE_SUMS)


def state_before(spark: SparkSession, path: str, keys: Sequence[str], batch: int, schema: T.StructType, every: int) -> DataFrame:
    """Sums as they stood before a batch: the last snapshot and the batches after it.

    Which snapshot that is follows from the batch number alone, so nothing is listed and at
    most ``every`` folders are read, however long the stream has run.
    """
    snapshot = (batch - 1) // every * every
    paths = [f"{path}/snapshot={snapshot}"] if snapshot > 0 else []
    paths += [f"{path}/b={i}" for i in range(snapshot + 1 if snapshot > 0 else 0, batch)]
    return current_state(spark.read.schema(schema).parquet(*paths), keys)


def write_ledger(
    ledger: DataFrame, path: str, checkpoint: str, keys: Sequence[str], log_path: str | None = None, every: int = 100,
    available_now: bool = True, period: Column | None = None, minimum: int = 5,
) -> StreamingQuery:
    """Update-mode sink: each batch's changed sums in its own folder, a snapshot every ``every`` batches.

    With ``log_path``, figures of days (or of ``period``) that change after they were first published, the mean wage
    among them, are logged with their earlier values.  A replayed batch overwrites its own folders, so it counts once.
    """
    day_keys = [*keys, "day"]
    shown = day_keys if period is None else [*keys, "period"]

    def folded(state: DataFrame) -> DataFrame:
        return figures(state if period is None else by_period(state, keys, period), minimum)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{path}/b={batch_id}")
        written = spark.read.schema(rows.schema).parquet(f"{path}/b={batch_id}")
        if batch_id == 0:
            return
        if log_path is not None:
            before = state_before(spark, path, day_keys, batch_id, rows.schema, every)
            after = current_state(before.withColumn("batch", F.lit(batch_id - 1).cast("bigint")).unionByName(written), day_keys)
            shown_figures = folded(after)
            changed_rows(folded(before), shown_figures, shown, [c for c in shown_figures.columns if c not in shown]).write.mode("overwrite").parquet(f"{log_path}/b={batch_id}")
        if batch_id % every == 0:
            before = state_before(spark, path, day_keys, batch_id, rows.schema, every).withColumn("batch", F.lit(batch_id - 1).cast("bigint"))
            state = current_state(before.unionByName(written), day_keys)
            state.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/snapshot={batch_id}")

    w = ledger.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Every written batch (snapshots repeat what they hold and are left out)."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/b=*")


def read_state(spark: SparkSession, path: str, keys: Sequence[str], batches: int, every: int = 100) -> DataFrame:
    """Days as they stand after so many batches, from the last snapshot on."""
    schema = spark.read.parquet(f"{path}/b=0").schema
    return state_before(spark, path, [*keys, "day"], batches, schema, every)


def write_rows(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append-mode file sink; its own log makes each batch count once."""
    w = rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def dropped_rows(query: StreamingQuery) -> int:
    """Records that came later than the watermark allows, summed over the reported batches."""
    return sum(
        op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators
    )
