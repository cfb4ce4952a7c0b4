"""D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import sets, windows
from .base import FIRST_MONTH, FLOWS_SQL, LAST_MONTH, MONTHS_SQL, MOVES_SQL, ORDERS_SQL, YEARLY_SQL, dbl, dec, movements, orders_by_territory, table, territories, yearly_prices
from .registry import query


@query("d01_ledger", f"WITH {MOVES_SQL} SELECT territory, month, {FLOWS_SQL} FROM mov GROUP BY ALL")
def d01(spark, d):
    return agg.ledger(movements(spark, d), ["territory", "month"])


@query("d02_grouping_sets", f"""
WITH {MOVES_SQL}, m AS (SELECT * FROM mov JOIN part ON l_partkey = p_partkey)
SELECT territory, year, CASE WHEN grouping(p_brand) = 0 THEN 'p_brand' WHEN grouping(priority) = 0 THEN 'priority' ELSE 'total' END AS axis,
  CASE WHEN grouping(p_brand) = 0 THEN p_brand WHEN grouping(priority) = 0 THEN priority ELSE 'total' END AS category, {FLOWS_SQL}
FROM m GROUP BY GROUPING SETS ((territory, year), (territory, year, p_brand), (territory, year, priority))""")
def d02(spark, d):
    m = movements(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return agg.breakdowns(m, ["territory", "year"], ["p_brand", "priority"])


@query("d03_mean_min_sample", f"""
WITH {MOVES_SQL}, g AS (SELECT territory, month, sum(CASE WHEN sign = 1 AND l_linenumber <> 7 THEN weight END) AS n, sum(CASE WHEN sign = 1 AND l_linenumber <> 7 THEN salary * weight END) AS s FROM mov GROUP BY ALL)
SELECT territory, month, CASE WHEN n >= 5 THEN CAST(s AS DOUBLE) / CAST(n AS DOUBLE) END AS mean, CAST(CASE WHEN n >= 5 THEN n END AS BIGINT) AS sample, CASE WHEN n >= 5 THEN 'available' ELSE 'unavailable' END AS mean_status FROM g""")
def d03(spark, d):
    return movements(spark, d).groupBy("territory", "month").agg(
        *agg.mean_with_sample(F.col("salary"), F.col("weight"), (F.col("sign") == 1) & (F.col("l_linenumber") != 7)))


@query("d04_national_total", f"""
WITH {MOVES_SQL} SELECT coalesce(state, 'Total') AS state, {FLOWS_SQL} FROM mov GROUP BY ROLLUP (state)""")
def d04(spark, d):
    return agg.grand_total(movements(spark, d), "state", agg.flow_counts())


@query("d05_dimension_totals", f"""
WITH {MOVES_SQL}, a AS (SELECT year, priority AS category, {FLOWS_SQL} FROM mov GROUP BY ALL)
SELECT year, CAST(sum(admissions) AS BIGINT) AS admissions, CAST(sum(dismissals) AS BIGINT) AS dismissals, CAST(sum(balance) AS BIGINT) AS balance, TRUE AS conserved FROM a GROUP BY 1""")
def d05(spark, d):
    measures = ["admissions", "dismissals", "balance"]
    rows = agg.breakdowns(movements(spark, d), ["year"], ["priority"])
    total, parts = F.col("axis") == "total", F.col("axis") == "priority"
    g = rows.groupBy("year").agg(
        *[F.sum(F.when(parts, F.col(m))).alias(m) for m in measures], *[F.sum(F.when(total, F.col(m))).alias(f"t_{m}") for m in measures])
    same = F.lit(True)
    for m in measures:
        same = same & (F.col(m) == F.col(f"t_{m}"))
    return g.select("year", *measures, same.alias("conserved"))


@query("d06_category_total", f"""
WITH {ORDERS_SQL} SELECT territory, CASE WHEN grouping(segment) = 1 THEN 'Total' ELSE segment END AS segment, count(*) AS schools, CAST(sum(price) AS DOUBLE) AS total
FROM ord GROUP BY GROUPING SETS ((territory), (territory, segment))""")
def d06(spark, d):
    sums = [F.count(F.lit(1)).alias("schools"), F.sum("price").alias("total")]
    return agg.with_total(orders_by_territory(spark, d), ["territory"], "segment", sums, [F.col("schools"), dbl("total").alias("total")])


@query("d07_null_sum", """
SELECT lang, source, CAST(CASE WHEN count(*) = count(quality) THEN sum(quality) END AS BIGINT) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def d07(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang", "source").agg(
        agg.null_sum(F.col("quality").cast("bigint")).alias("quality"))


@query("d08_conditional_counts", f"""
WITH {ORDERS_SQL} SELECT territory, CAST(count(CASE WHEN status_code = 'F' THEN 1 END) AS BIGINT) AS closed, CAST(count(CASE WHEN priority = '1-URGENT' THEN 1 END) AS BIGINT) AS urgent,
 CAST(count(CASE WHEN price > 400000 AND segment IN ('BUILDING', 'MACHINERY') THEN 1 END) AS BIGINT) AS large FROM ord GROUP BY 1""")
def d08(spark, d):
    return agg.conditional_counts(orders_by_territory(spark, d), ["territory"], {
        "closed": F.col("status_code") == "F", "urgent": F.col("priority") == "1-URGENT",
        "large": (F.col("price") > 400000) & F.col("segment").isin("BUILDING", "MACHINERY")})


@query("d09_frequency", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL")
def d09(spark, d):
    return agg.frequency(table(spark, d, "part"), ["p_type"], "p_brand")


@query("d10_known_share", """
SELECT lang, CAST(count(CASE WHEN toxic = 1 THEN 1 END) AS BIGINT) AS with_resource, count(toxic) AS considered, count(*) - count(toxic) AS missing,
 CASE WHEN count(toxic) > 0 THEN CAST(count(CASE WHEN toxic = 1 THEN 1 END) AS DOUBLE) / count(toxic) * 100 END AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def d10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(*agg.known_share(F.col("toxic") == 1))


@query("d11_bands", """
SELECT r_name AS state, CASE WHEN p_size <= 14 THEN '0-14' WHEN p_size <= 29 THEN '15-29' ELSE '30+' END AS band, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 END) AS BIGINT) AS F,
 CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 END) AS BIGINT) AS O, count(*) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def d11(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus").join(
        table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        territories(spark, d).select("n_nationkey", "state"), F.col("s_nationkey") == F.col("n_nationkey"))
    band = F.when(F.col("p_size") <= 14, "0-14").when(F.col("p_size") <= 29, "15-29").otherwise("30+")
    return agg.bands(li.withColumn("one", F.lit(1).cast("bigint")), ["state"], band, "l_linestatus", ["F", "O"], "one")


@query("d12_distribution", f"""
WITH {ORDERS_SQL}, p AS (SELECT territory, segment, count(*) AS value FROM ord GROUP BY ALL), t AS (SELECT territory, count(*) + CASE WHEN territory = 'NATION_1' THEN 1 ELSE 0 END AS total FROM ord GROUP BY 1)
SELECT territory, segment, value, total, CAST(value AS DOUBLE) / total * 100 AS percent, territory <> 'NATION_1' AS balanced FROM p JOIN t USING (territory)""")
def d12(spark, d):
    o = orders_by_territory(spark, d)
    totals = o.groupBy("territory").agg((F.count(F.lit(1)) + F.when(F.col("territory") == "NATION_1", 1).otherwise(0)).alias("value"))
    return agg.distribution(o.groupBy("territory", "segment").agg(F.count(F.lit(1)).alias("value")), totals, ["territory"])


CLASS_SQL = """panel AS (SELECT r_name AS state, p_size AS cls, CASE WHEN p_size <= 10 THEN '1.' || p_size || '.' WHEN p_size <= 25 THEN '3.1.' || p_size || '.' WHEN p_size <= 40 THEN '3.2.' || p_size || '.' ELSE '4.' || p_size || '.' END AS path,
  CAST(year(l_shipdate) AS VARCHAR) AS year, sum(CAST(l_quantity AS DECIMAL(18,2))) AS ha
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def _class_panel(spark, d):
    size = F.col("p_size").cast("string")
    stem = F.when(F.col("p_size") <= 10, "1.").when(F.col("p_size") <= 25, "3.1.").when(F.col("p_size") <= 40, "3.2.").otherwise("4.")
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").cast("string").alias("year"), dec("l_quantity").alias("ha")).join(
        table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        territories(spark, d).select("n_nationkey", "state"), F.col("s_nationkey") == F.col("n_nationkey"))
    long = li.select("state", F.col("p_size").alias("cls"), F.concat(stem, size, F.lit(".")).alias("path"), "year", "ha")
    return agg.class_panel(long, ["state"], "cls", "path", "year", "ha")


@query("d13_class_panel", f"""
WITH {CLASS_SQL} SELECT state, year, CAST(sum(CASE WHEN starts_with(path, '1.') THEN ha ELSE 0 END) AS DOUBLE) AS forest, CAST(sum(CASE WHEN starts_with(path, '3.') THEN ha ELSE 0 END) AS DOUBLE) AS farming,
 CAST(sum(CASE WHEN starts_with(path, '3.2.') THEN ha ELSE 0 END) AS DOUBLE) AS agriculture, CAST(sum(CASE WHEN cls IN (3, 4, 12) THEN ha ELSE 0 END) AS DOUBLE) AS native, CAST(sum(ha) AS DOUBLE) AS mapped FROM panel GROUP BY ALL""")
def d13(spark, d):
    g = agg.semantic_groups(_class_panel(spark, d), ["state", "year"], "cls", "path", "ha",
                            {"forest": "1.", "farming": "3.", "agriculture": "3.2.", "mapped": ""}, {"native": [3, 4, 12]})
    return g.select("state", "year", *[dbl(c).alias(c) for c in ("forest", "farming", "agriculture", "native", "mapped")])


@query("d14_covered_counts", f"""
WITH {ORDERS_SQL}, {MONTHS_SQL}, t AS (SELECT n_name AS territory FROM nation), c AS (SELECT territory, month, count(*) AS k FROM ord GROUP BY ALL),
m AS (SELECT t.territory, cal.month, cal.month < '200006' AND substr(cal.month, 5) <> '02' AS available, CASE WHEN cal.month < '200006' AND substr(cal.month, 5) <> '02' THEN coalesce(k, 0) END AS n FROM t CROSS JOIN cal LEFT JOIN c ON c.territory = t.territory AND c.month = cal.month)
SELECT territory, substr(month, 1, 4) AS year, CAST(coalesce(sum(n), 0) AS BIGINT) AS count, CAST(count(CASE WHEN available THEN 1 END) AS BIGINT) AS coverage_months, FALSE AS complete FROM m GROUP BY ALL""")
def d14(spark, d):
    o = orders_by_territory(spark, d)
    spine = windows.month_spine(territories(spark, d).select("territory"), FIRST_MONTH, LAST_MONTH)
    covered = orders_by_territory(spark, d).filter("month < '200006' AND substr(month, 5, 2) <> '02'").select("month")
    return agg.annual_coverage(agg.covered_counts(o, spine, covered, ["territory"], "month"), ["territory"], F.substring("month", 1, 4))


@query("d15_capacity", f"""
WITH {ORDERS_SQL}, {MONTHS_SQL}, t AS (SELECT n_name AS territory FROM nation), g AS (SELECT territory, month, sum(price) AS beds, count(*) AS units FROM ord WHERE status_code = 'F' GROUP BY ALL)
SELECT t.territory, cal.month, CAST(coalesce(beds, 0) AS DOUBLE) AS beds, coalesce(units, 0) AS units, units IS NULL AS zero_confirmed FROM t CROSS JOIN cal LEFT JOIN g ON g.territory = t.territory AND g.month = cal.month""")
def d15(spark, d):
    o = orders_by_territory(spark, d).filter("status_code = 'F'").withColumn("beds", F.col("price"))
    spine = windows.month_spine(territories(spark, d).select("territory"), FIRST_MONTH, LAST_MONTH)
    return agg.capacity(o, spine, ["territory", "month"], ["beds"]).select("territory", "month", dbl("beds").alias("beds"), "units", "zero_confirmed")


@query("d16_distinct_entities", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(*) AS memberships FROM lineitem GROUP BY 1""")
def d16(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey")
    one = sets.dedup(li.withColumn("seen", F.lit(1)), ["l_returnflag", "l_orderkey"])
    return one.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("orders"), F.sum("copies").alias("memberships"))


@query("d17_leader", f"""
WITH {MOVES_SQL}, g AS (SELECT territory, year, p_brand, sum(quantity) AS q FROM mov JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT territory, year, p_brand, CAST(q AS DOUBLE) AS q FROM (SELECT *, row_number() OVER (PARTITION BY territory, year ORDER BY q DESC, p_brand) AS r FROM g) WHERE r = 1""")
def d17(spark, d):
    m = movements(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = m.groupBy("territory", "year", "p_brand").agg(F.sum("quantity").alias("q"))
    return agg.leader(g, ["territory", "year"], "p_brand", "q").withColumn("q", dbl("q"))


@query("d18_reference_range", f"WITH {ORDERS_SQL} SELECT territory, min(month) AS first, max(month) AS reference FROM ord GROUP BY 1")
def d18(spark, d):
    return agg.reference_range(orders_by_territory(spark, d), ["territory"], "month")


@query("d19_bounding_box", """
SELECT p_brand, min(p_size) - CAST(0.25 AS DOUBLE) AS min_x, min(p_retailprice) - CAST(0.25 AS DOUBLE) AS min_y, max(p_size) + CAST(0.25 AS DOUBLE) AS max_x, max(p_retailprice) + CAST(0.25 AS DOUBLE) AS max_y FROM part GROUP BY 1""")
def d19(spark, d):
    return agg.bounding_box(table(spark, d, "part"), ["p_brand"], dbl("p_size"), F.col("p_retailprice"), 0.25)


@query("d20_subset_share", """
SELECT p_type, CAST(sum(CASE WHEN p_size >= 40 THEN p_size ELSE 0 END) AS BIGINT) AS part, CAST(sum(p_size) AS BIGINT) AS whole, CAST(sum(CASE WHEN p_size >= 40 THEN p_size ELSE 0 END) AS DOUBLE) / sum(p_size) * 100 AS share FROM part GROUP BY 1""")
def d20(spark, d):
    return agg.subset_share(table(spark, d, "part"), ["p_type"], "p_size", F.col("p_size") >= 40)


@query("d21_sorted_sets", f"""
WITH {ORDERS_SQL} SELECT territory, string_agg(DISTINCT year, ' | ' ORDER BY year) AS years, string_agg(DISTINCT status_code, ' | ' ORDER BY status_code) AS codes FROM ord GROUP BY 1""")
def d21(spark, d):
    return orders_by_territory(spark, d).groupBy("territory").agg(
        F.array_join(agg.sorted_set(F.col("year")), " | ").alias("years"), F.array_join(agg.sorted_set(F.col("status_code")), " | ").alias("codes"))


@query("d22_stock_and_mean", f"""
WITH {MOVES_SQL}, s AS (SELECT territory, segment, CASE WHEN l_linenumber > 2 THEN salary ELSE 0 END AS v FROM mov WHERE l_linestatus = 'F' AND year = '1995')
SELECT territory, CASE WHEN grouping(segment) = 1 THEN 'Total' ELSE segment END AS segment, count(*) AS stock, CAST(CASE WHEN count(CASE WHEN v > 0 THEN 1 END) >= 5 THEN count(CASE WHEN v > 0 THEN 1 END) END AS BIGINT) AS sample,
 CAST(CASE WHEN count(CASE WHEN v > 0 THEN 1 END) >= 5 THEN count(*) - count(CASE WHEN v > 0 THEN 1 END) END AS BIGINT) AS missing_or_zero,
 CASE WHEN count(CASE WHEN v > 0 THEN 1 END) >= 5 THEN CAST(sum(CASE WHEN v > 0 THEN v END) AS DOUBLE) / count(CASE WHEN v > 0 THEN 1 END) END AS mean
FROM s GROUP BY GROUPING SETS ((territory), (territory, segment))""")
def d22(spark, d):
    s = movements(spark, d, ("199501", "199512")).filter("l_linestatus = 'F'").select(
        "territory", "segment", F.when(F.col("l_linenumber") > 2, F.col("salary")).otherwise(dec(F.lit(0))).alias("v"))
    return agg.stock_and_mean(s, "territory", "segment", "v")


@query("d23_headline", f"""
WITH {YEARLY_SQL}, v AS (SELECT territory, year, CASE WHEN n >= 80 THEN CAST(price AS DOUBLE) END AS value FROM yr)
SELECT territory, max(year) AS reference, arg_max(value, year) AS value, 'orders-value' AS indicator FROM v WHERE value IS NOT NULL GROUP BY 1""")
def d23(spark, d):
    y = yearly_prices(spark, d).select("territory", "year", F.when(F.col("n") >= 80, dbl("price")).alias("value"))
    return agg.headline(y, ["territory"], "orders-value", "year", "value")
