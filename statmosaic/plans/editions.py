"""L: refresh, revisions and publication.  M: the streaming ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import partitions, quality, refresh
from ..session import materialize, scratch_path
from ..streaming import ledger as live
from .base import FLOWS_SQL, MOVES_SQL, ORDERS_SQL, YEARLY_SQL, dbl, movements, orders_by_territory, table, yearly_prices
from .registry import query


@query("l01_unchanged_content", f"""
WITH {YEARLY_SQL} SELECT 'dates only' AS case_, CAST(0 AS BIGINT) AS differences UNION ALL SELECT 'revised', CAST(2 * count(*) AS BIGINT) FROM yr WHERE state = 'ASIA'""")
def l01(spark, d):
    y = yearly_prices(spark, d).select("territory", "state", "year", "n")
    previous = y.withColumn("collectedAt", F.lit("2024-01-01"))
    dated = y.withColumn("collectedAt", F.lit("2024-02-01"))
    revised = dated.withColumn("n", F.col("n") + F.when(F.col("state") == "ASIA", 100000).otherwise(0))
    count = lambda case, df: refresh.content_differences(df, previous).agg(F.count(F.lit(1)).alias("differences")).withColumn("case_", F.lit(case))
    return count("dates only", dated).unionByName(count("revised", revised))


@query("l01_partition_digests", """
WITH y AS (SELECT year(o_orderdate) AS year, count(*) AS row_count FROM orders GROUP BY 1)
SELECT year, row_count, CASE year WHEN 1996 THEN 'changed' WHEN 1998 THEN 'gone' WHEN 1992 THEN 'new' ELSE 'same' END AS status FROM y""")
def l01_partitions(spark, d):
    """All orders by year: one year is revised, one is withdrawn and one is added; the others are not written again."""
    root = scratch_path(spark, "l01-partitions")
    orders = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    gates = lambda df: [quality.volume_floor(df, 1)]
    partitions.publish_partitions(orders.where("year <> 1992"), root, "1", ["year"], gates)
    revised = orders.where("year <> 1998").withColumn("o_totalprice", F.when(F.col("year") == 1996, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    status = partitions.publish_partitions(revised, root, "2", ["year"], gates)
    years = orders.groupBy("year").agg(F.count(F.lit(1)).alias("row_count")).withColumn("part", partitions.part_key(["year"]))
    return years.join(status, "part").drop("part")


@query("l02_date_retention", f"""
WITH {YEARLY_SQL} SELECT territory || '-' || year AS source_id, sha256(CAST(CASE WHEN year = '2001' THEN n + 1 ELSE n END AS VARCHAR)) AS sha256, CASE WHEN year = '2001' OR year = '2000' THEN '2024-06-01' ELSE '2024-01-01' END AS collected_at FROM yr""")
def l02(spark, d):
    y = yearly_prices(spark, d).select(F.concat_ws("-", "territory", "year").alias("source_id"), "year", "n")
    digest = lambda c: F.sha2(c.cast("string"), 256)
    previous = y.filter("year <> '2000'").select("source_id", digest(F.col("n")).alias("sha256"), F.lit("2024-01-01").alias("collected_at"))
    current = y.select("source_id", digest(F.when(F.col("year") == "2001", F.col("n") + 1).otherwise(F.col("n"))).alias("sha256"))
    return refresh.retain_dates(current, previous, F.lit("2024-06-01"), ["source_id", "sha256"])


L03_SQL = FLOWS_SQL + """, CASE WHEN sum(CASE WHEN sign = 1 AND salary > 2000 THEN weight END) >= 5
  THEN CAST(sum(CASE WHEN sign = 1 AND salary > 2000 THEN salary * weight END) AS DOUBLE) / CAST(sum(CASE WHEN sign = 1 AND salary > 2000 THEN weight END) AS DOUBLE) END AS admission_wage"""


@query("l03_revision_log", f"""
WITH {MOVES_SQL}, cur AS (SELECT territory, month, {L03_SQL} FROM mov GROUP BY ALL), prev AS (SELECT territory, month, {L03_SQL} FROM mov WHERE declared <= '200006' GROUP BY ALL)
SELECT cur.*, prev.admissions AS previous_admissions, prev.dismissals AS previous_dismissals, prev.balance AS previous_balance, prev.admission_wage AS previous_admission_wage, '2000-07-31' AS detected_at
FROM cur JOIN prev USING (territory, month) WHERE (cur.admissions, cur.dismissals, cur.balance) <> (prev.admissions, prev.dismissals, prev.balance) OR cur.admission_wage IS DISTINCT FROM prev.admission_wage""")
def l03(spark, d):
    return refresh.ledger_revisions(
        movements(spark, d), ["territory", "month"], "declared", "200006", F.lit("2000-07-31"), F.col("salary"), F.col("salary") > 2000)


@query("l04_publish", f"WITH {YEARLY_SQL} SELECT territory, year, n FROM yr")
def l04(spark, d):
    root = scratch_path(spark, "l04")
    y = yearly_prices(spark, d).select("territory", "year", "n")
    gates = lambda df: [quality.unique_keys(df, ["territory", "year"]), quality.volume_floor(df, 1)]
    refresh.publish(y, root, "1", gates)
    try:
        refresh.publish(y.unionByName(y), root, "2", gates)
    except quality.GateFailure:
        pass
    return refresh.published(spark, root)


@query("l05_failure_isolation", f"""
WITH {YEARLY_SQL}, r AS (SELECT territory, year, state, CASE WHEN n < 80 THEN 'failed' ELSE 'ok' END AS status FROM yr)
SELECT * FROM r WHERE status = 'ok' AND NOT (state = 'ASIA' AND state IN (SELECT state FROM r WHERE status <> 'ok'))""")
def l05(spark, d):
    r = yearly_prices(spark, d).select("territory", "year", "state", F.when(F.col("n") < 80, "failed").otherwise("ok").alias("status"))
    return refresh.isolate_failures(r, "state", ["ASIA"])


@query("l06_new_periods", f"""
WITH {ORDERS_SQL} SELECT DISTINCT territory, month FROM ord WHERE (territory, month) NOT IN (SELECT (territory, month) FROM ord WHERE (priority = '2-HIGH' AND status_code = 'P') OR month < '200001')""")
def l06(spark, d):
    o = orders_by_territory(spark, d)
    return refresh.new_periods(o, o.filter("(priority = '2-HIGH' AND status_code = 'P') OR month < '200001'"), ["territory", "month"])


@query("l07_carry_forward", f"""
WITH {YEARLY_SQL} SELECT territory, year, n, CASE WHEN state = 'ASIA' THEN CAST(price AS DOUBLE) WHEN year <> '1999' THEN CAST(price AS DOUBLE) + 1 END AS mean FROM yr""")
def l07(spark, d):
    y = yearly_prices(spark, d)
    current = y.select("territory", "year", "n", F.when(F.col("state") == "ASIA", dbl("price")).alias("mean"))
    previous = y.select("territory", "year", (F.col("n") + F.when(F.col("year") == "1999", 1).otherwise(0)).alias("n"), (dbl("price") + 1).alias("mean"))
    return refresh.carry_forward(current, previous, ["territory", "year"], ["n"], ["mean"])


@query("l08_offline_revalidation", f"""
WITH {YEARLY_SQL} SELECT 'unique' AS gate, territory || '|' || year AS key, '2' AS detail FROM yr WHERE state = 'EUROPE'""")
def l08(spark, d):
    path = scratch_path(spark, "l08")
    y = yearly_prices(spark, d).select("territory", "state", "year", dbl("n").alias("value"), F.lit("real").alias("status"))
    y.unionByName(y.filter("state = 'EUROPE'")).write.parquet(path)
    return quality.revalidate(spark.read.parquet(path), ["territory", "year"], "value", "status")


@query("l08_moved_partitions", f"""
WITH {YEARLY_SQL} SELECT 'unique' AS gate, territory || '|' || year AS key, '2' AS detail, CAST(1 AS INTEGER) AS parts_read FROM yr WHERE state = 'EUROPE'""")
def l08_partitions(spark, d):
    """A publication found right is read again only where its digest moved: one state of all."""
    root = scratch_path(spark, "l08-partitions")
    y = materialize(yearly_prices(spark, d).select("territory", "state", "year", dbl("n").alias("value"), F.lit("real").alias("status")), "l08-panel")
    gate = lambda t: quality.revalidate(t["panel"], ["territory", "year"], "value", "status")
    for version, df in (("1", y), ("2", y.unionByName(y.filter("state = 'EUROPE'")))):
        partitions.publish_partitions(df, f"{root}/panel", version, ["state"], lambda staged: [quality.volume_floor(staged, 1)])
        found, read = partitions.judge_moved(spark, {"panel": f"{root}/panel"}, f"{root}/checked", gate)
    return found.withColumn("parts_read", F.lit(len(read)))


@query("l09_as_of", f"""
WITH {MOVES_SQL} SELECT territory, month, {FLOWS_SQL} FROM mov WHERE declared <= '199906' AND month BETWEEN '199707' AND '199906' GROUP BY ALL""")
def l09(spark, d):
    return agg.ledger(refresh.as_of(movements(spark, d, ("199707", "199906")), "declared", "199906", "month", "199906", 24), ["territory", "month"])


EVENT_SQL = """ev AS (SELECT event_id, event_type AS territory, strftime(ts, '%Y-%m-%d') AS period, CASE WHEN event_type = 'signup' THEN -1 ELSE 1 END AS sign,
  CASE WHEN value < 1 THEN -1 ELSE 1 END AS weight, value FROM events)"""


def _marked(df):
    return live.as_instant(df, "ts").select(
        "event_id", "ts", F.col("event_type").alias("territory"), F.when(F.col("event_type") == "signup", -1).otherwise(1).alias("sign"),
        F.when(F.col("value") < 1, -1).otherwise(1).alias("weight"), "value")


def _day():
    return F.date_format(F.col("ts"), "yyyy-MM-dd")


DELAY = "60 days"  # of the deduplication: longer than any delay in the data, so the end state equals the batch result
LATE = "2 days"


@query("m01_stream_ledger", f"""
WITH {EVENT_SQL}, b AS (SELECT ev.*, CAST(period AS DATE) AS day, CASE WHEN event_id % 10 = 3 THEN 2 ELSE 1 END AS batch FROM ev),
mark AS (SELECT max(ts) - INTERVAL 2 DAY AS m FROM events WHERE event_id % 10 <> 3)
SELECT territory, strftime(day, '%Y%m') AS period, {FLOWS_SQL} FROM b, mark WHERE batch = 1 OR day + INTERVAL 1 DAY > m GROUP BY ALL""")
def m01(spark, d):
    """Every tenth record comes in a second batch; those whose day the watermark has left are dropped."""
    root = scratch_path(spark, "m01")
    events = table(spark, d, "events")
    for part in ("event_id % 10 <> 3", "event_id % 10 = 3"):
        events.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/in")
        led = live.daily_ledger(_marked(stream), "ts", LATE, ["territory"])
        run = live.write_ledger(led, f"{root}/state", f"{root}/checkpoint", ["territory"])
        run.awaitTermination()
    # the batches after the last one with records only let days leave the state
    last = max(p.batchId for p in run.recentProgress if p.numInputRows)
    days = live.read_state(spark, f"{root}/state", ["territory"], last + 1)
    return live.by_period(days, ["territory"], F.date_format("day", "yyyyMM"))


@query("m02_stream_dedup", f"WITH {EVENT_SQL} SELECT territory, period, {FLOWS_SQL} FROM ev GROUP BY ALL")
def m02(spark, d):
    root = scratch_path(spark, "m02")
    events = table(spark, d, "events")
    events.unionByName(events.filter("value > 5")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    once = live.once_per_id(_marked(stream), ["event_id"], "ts", DELAY)
    q = live.write_rows(once, f"{root}/rows", f"{root}/checkpoint")
    q.awaitTermination()
    return agg.ledger(spark.read.parquet(f"{root}/rows").withColumn("period", _day()), ["territory", "period"])


M03_SQL = FLOWS_SQL + """, sum(CASE WHEN sign = 1 AND value > 1.5 THEN CAST(value AS DECIMAL(18,2)) * weight END) AS ws, sum(CASE WHEN sign = 1 AND value > 1.5 THEN weight END) AS wn"""


@query("m03_stream_revisions", f"""
WITH {EVENT_SQL}, mark AS (SELECT max(ts) - INTERVAL 2 DAY AS m FROM events WHERE value >= 2),
a AS (SELECT territory, period, {M03_SQL} FROM ev WHERE value >= 2 GROUP BY ALL),
b AS (SELECT territory, period, {M03_SQL} FROM ev, mark WHERE value >= 2 OR CAST(period AS DATE) + INTERVAL 1 DAY > m GROUP BY ALL),
c AS (SELECT territory, period, b.admissions, b.dismissals, b.balance, CASE WHEN b.wn >= 5 THEN round(CAST(b.ws AS DOUBLE) / b.wn, 6) END AS admission_wage,
  a.admissions AS previous_admissions, a.dismissals AS previous_dismissals, a.balance AS previous_balance, CASE WHEN a.wn >= 5 THEN round(CAST(a.ws AS DOUBLE) / a.wn, 6) END AS previous_admission_wage
  FROM a JOIN b USING (territory, period))
SELECT * FROM c WHERE (admissions, dismissals, balance) <> (previous_admissions, previous_dismissals, previous_balance) OR admission_wage IS DISTINCT FROM previous_admission_wage""")
def m03(spark, d):
    """Small events come in a second batch and revise counts and mean wages of the days that are still open."""
    root = scratch_path(spark, "m03")
    events = table(spark, d, "events")
    for part in ("value >= 2", "value < 2"):
        events.filter(part).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/in")
        led = live.daily_ledger(_marked(stream), "ts", LATE, ["territory"], wage=F.col("value").cast("decimal(18,2)"), eligible=F.col("value") > 1.5)
        live.write_ledger(led, f"{root}/state", f"{root}/checkpoint", ["territory"], f"{root}/log").awaitTermination()
    log = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/log").drop("batch")
    return log.withColumns({
        "period": F.date_format("day", "yyyy-MM-dd"), **{c: F.round(c, 6) for c in ("admission_wage", "previous_admission_wage")}}).drop("day")
