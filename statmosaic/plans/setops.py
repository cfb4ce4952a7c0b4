"""G: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets
from ..session import scratch_path
from ..sources import delimited
from .base import MONTHS_SQL, MOVES_SQL, ORDERS_SQL, PRIORITIES, YEARLY_SQL, YEARS, dbl, orders_by_territory, table, territories, yearly_prices
from .registry import query


@query("g01_own_and_peers", f"WITH {YEARLY_SQL} SELECT territory, year, n, territory = 'NATION_4' AS own FROM yr")
def g01(spark, d):
    y = yearly_prices(spark, d).select("territory", "year", "n")
    own = y.filter("territory = 'NATION_4'").withColumn("own", F.lit(True))
    return sets.with_peers(own, y.filter("territory <> 'NATION_4'").withColumn("own", F.lit(False)))


@query("g02_replace_by_module", f"""
WITH {YEARLY_SQL} SELECT state AS module, territory, year, CASE WHEN state = 'EUROPE' THEN n + 1000 ELSE n END AS n FROM yr""")
def g02(spark, d):
    path = scratch_path(spark, "g02")
    y = yearly_prices(spark, d).select(F.col("state").alias("module"), "territory", "year", "n")
    y.write.partitionBy("module").parquet(path)
    sets.replace_partitions(y.filter("module = 'EUROPE'").withColumn("n", F.col("n") + 1000), path, "module")
    return spark.read.parquet(path).select("module", "territory", "year", "n")


@query("g03_file_facts", f"""
WITH {ORDERS_SQL} SELECT CASE status_code WHEN 'F' THEN 'MOV' WHEN 'O' THEN 'FOR' ELSE 'EXC' END AS kind, year AS publication, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM ord GROUP BY ALL""")
def g03(spark, d):
    path = scratch_path(spark, "g03")
    kind = F.when(F.col("status_code") == "F", "MOV").when(F.col("status_code") == "O", "FOR").otherwise("EXC")
    orders_by_territory(spark, d).select(F.concat(kind, "year").alias("file"), "o_orderkey", "price").write.partitionBy("file").parquet(path)
    rows = spark.read.schema("o_orderkey bigint, price decimal(18,2)").parquet(f"{path}/file=*")
    return delimited.file_facts(rows, r"file=([A-Z]{3})(\d{4})", ["kind", "publication"]).groupBy("kind", "publication").agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum("price")).alias("total"))


@query("g04_expected_seen", f"""
WITH {ORDERS_SQL}, e AS (SELECT n_name AS territory, y AS year, p AS priority, 1 AS e FROM nation, (SELECT unnest({YEARS + ['2002']}) AS y), (SELECT unnest({PRIORITIES[:4]}) AS p)),
s AS (SELECT territory, year, priority, count(*) AS k FROM ord WHERE price > 480000 GROUP BY ALL)
SELECT territory, year, priority, CAST(coalesce(k, 0) AS BIGINT) AS found, CASE WHEN k IS NULL THEN 'missing' WHEN e IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem
FROM e FULL JOIN s USING (territory, year, priority) WHERE k IS NULL OR e IS NULL OR k > 1""")
def g04(spark, d):
    expected = sets.expected_cells(territories(spark, d).select("territory"), {"year": [*YEARS, "2002"], "priority": PRIORITIES[:4]})
    seen = orders_by_territory(spark, d).filter("price > 480000").select("territory", "year", "priority")
    return sets.cell_differences(expected, seen, ["territory", "year", "priority"])


@query("g05_dedup", """
WITH g AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS lo, max(l_returnflag) AS hi, count(*) AS copies FROM lineitem GROUP BY ALL)
SELECT lo <> hi AS conflict, lo AS flag, count(*) AS keys, CAST(sum(copies) AS BIGINT) AS copies FROM g GROUP BY ALL""")
def g05(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    return sets.dedup(li, ["l_orderkey", "l_linenumber"]).groupBy("conflict", "flag").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("copies"))


@query("g06_key_sets", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, priority, year, list_sort(list(DISTINCT month)) AS m FROM ord GROUP BY ALL)
SELECT territory, priority, year, len(m) = 12 AS complete, len(m) AS months FROM g""")
def g06(spark, d):
    wanted = F.array(*[F.concat(F.col("year"), F.lit(f"{m:02}")) for m in range(1, 13)])
    g = orders_by_territory(spark, d).groupBy("territory", "priority", "year").agg(F.array_sort(F.collect_set("month")).alias("m"))
    return g.select("territory", "priority", "year", sets.same_keys(F.col("m"), wanted).alias("complete"), F.size("m").cast("bigint").alias("months"))


@query("g07_exclusive_lists", """
WITH u AS (SELECT p_name AS item, CASE WHEN p_size <= 25 THEN 'permanent' ELSE 'temporary' END AS l FROM part) SELECT item, min(l) AS first_list, max(l) AS last_list FROM u GROUP BY 1 HAVING min(l) <> max(l)""")
def g07(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("item"), "p_size")
    return sets.exclusive({"permanent": p.filter("p_size <= 25").select("item"), "temporary": p.filter("p_size > 25").select("item")}, "item")


@query("g08_delete_then_append", f"""
WITH {YEARLY_SQL} SELECT state AS source_id, territory, year, n FROM yr WHERE state <> 'ASIA' UNION ALL SELECT state, territory, '2002', n FROM yr WHERE state = 'ASIA' AND year = '2000'""")
def g08(spark, d):
    y = yearly_prices(spark, d).select(F.col("state").alias("source_id"), "territory", "year", "n")
    fresh = y.filter("source_id = 'ASIA' AND year = '2000'").withColumn("year", F.lit("2002"))
    return sets.replace_by(y, fresh, ["source_id"])


@query("g09_labelled_append", f"""
WITH {MOVES_SQL}, o AS (SELECT year, count(*) AS n FROM ord GROUP BY 1), l AS (SELECT year, count(*) AS n FROM mov GROUP BY 1)
SELECT year, n, 'orders' AS methodology FROM o UNION ALL SELECT year, n, 'lines' FROM l""")
def g09(spark, d):
    o = orders_by_territory(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    li = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return sets.tag_append({"orders": o, "lines": li})


@query("g10_assemble_blocks", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory || '/' || priority || '/' || month AS block, count(*) AS n FROM ord GROUP BY 1), {MONTHS_SQL}, e AS (SELECT n_name || '/' || p || '/' || month AS block FROM nation, (SELECT unnest({PRIORITIES}) AS p), cal)
SELECT block, n, CASE WHEN n IS NULL THEN 'unavailable' ELSE 'real' END AS status, CASE WHEN n IS NULL THEN 'no publication' END AS reason FROM e LEFT JOIN g USING (block)""")
def g10(spark, d):
    expected = sets.expected_cells(territories(spark, d).select("territory"), {
        "priority": PRIORITIES, "month": [f"{y}{m:02}" for y in YEARS for m in range(1, 13)]}).select(F.concat_ws("/", "territory", "priority", "month").alias("block"))
    got = orders_by_territory(spark, d).groupBy(F.concat_ws("/", "territory", "priority", "month").alias("block")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("real"))
    return sets.assemble(expected, got, "block", "no publication").select("block", "n", "status", "reason")
