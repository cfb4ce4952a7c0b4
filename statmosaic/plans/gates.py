"""I: publication gates.  The stand-in tables really violate some of them, so frames are not all empty."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import partitions, quality, sets
from ..session import materialize, param_table, scratch_path
from ..sources import delimited, landing, nested
from .base import MONTHS_SQL, MOVES_SQL, ORDERS_SQL, PRIORITIES, YEARLY_SQL, YEARS, damaged_pages, dbl, movements, orders_by_territory, table, territories, yearly_prices
from .registry import query


def _count(v, *extra):
    return v.groupBy("gate", *extra).agg(F.count(F.lit(1)).alias("violations"))


@query("i01_cube_completeness", f"""
WITH {ORDERS_SQL}, {MONTHS_SQL}, e AS (SELECT n_name AS territory, month, p AS priority, 1 AS e FROM nation, cal, (SELECT unnest({PRIORITIES}) AS p)),
s AS (SELECT territory, month, priority, count(*) AS k FROM ord GROUP BY ALL)
SELECT 'complete' AS gate, CASE WHEN k IS NULL THEN 'missing' ELSE 'repeated' END AS detail, count(*) AS violations FROM e LEFT JOIN s USING (territory, month, priority) WHERE k IS NULL OR k > 1 GROUP BY 2""")
def i01(spark, d):
    keys = ["territory", "month", "priority"]
    months = [f"{y}{m:02}" for y in YEARS for m in range(1, 13)]
    expected = sets.expected_cells(territories(spark, d).select("territory"), {"month": months, "priority": PRIORITIES})
    diff = sets.cell_differences(expected, orders_by_territory(spark, d).select(*keys), keys)
    return _count(quality.complete_cells(diff, keys), "detail")


@query("i02_unique_keys", """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL HAVING count(*) > 1) SELECT 'unique' AS gate, CAST(k AS VARCHAR) AS detail, count(*) AS violations FROM g GROUP BY 2""")
def i02(spark, d):
    return _count(quality.unique_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "detail")


@query("i03_metadata_contract", """
SELECT 'metadata' AS gate, p_type || '|' || CASE p_type WHEN 'PROMO' THEN 'kg' ELSE 't' END AS key, 'not in contract' AS detail FROM part WHERE p_type IN ('PROMO', 'LARGE') GROUP BY p_type UNION ALL SELECT 'metadata', 'PROMO|t', 'not published' UNION ALL SELECT 'metadata', 'TINY|t', 'not published'""")
def i03(spark, d):
    published = table(spark, d, "part").select(F.col("p_type").alias("name"), F.when(F.col("p_type") == "PROMO", "kg").otherwise("t").alias("unit"))
    contract = param_table(spark, [(n, "t") for n in ("STANDARD", "PROMO", "MEDIUM", "SMALL", "ECONOMY", "TINY")], "name string, unit string")
    return quality.metadata_contract(published, contract, ["name", "unit"])


@query("i04_cross_field_rules", """
SELECT gate, count(*) AS violations FROM (SELECT 'status domain' AS gate FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'closed needs price' FROM orders WHERE NOT (o_orderstatus <> 'F' OR o_totalprice > 2000)) GROUP BY 1""")
def i04(spark, d):
    return _count(quality.rules(table(spark, d, "orders"), ["o_orderkey"], {
        "status domain": F.col("o_orderstatus").isin("F", "O"),
        "closed needs price": (F.col("o_orderstatus") != "F") | (F.col("o_totalprice") > 2000)}))


@query("i05_ranges", """
SELECT gate, count(*) AS violations FROM (SELECT 'not negative' AS gate FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'part within whole' FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT 'whole number' FROM customer WHERE c_acctbal <> floor(c_acctbal)) GROUP BY 1""")
def i05(spark, d):
    b = F.col("c_acctbal")
    return _count(quality.rules(table(spark, d, "customer"), ["c_custkey"], {
        "not negative": b >= 0, "part within whole": b <= 9500, "whole number": b == F.floor(b)}))


@query("i06_conservation", f"""
WITH {ORDERS_SQL}, t AS (SELECT territory, year, count(*) AS n, sum(CASE WHEN price > 499000 THEN 1 ELSE 0 END) AS lost FROM ord GROUP BY ALL)
SELECT 'conservation' AS gate, territory || '|' || year AS key, (n - lost) || '≠' || n AS detail FROM t WHERE lost > 0""")
def i06(spark, d):
    o = orders_by_territory(spark, d)
    parts = o.filter("price <= 499000").groupBy("territory", "year", "segment").agg(F.count(F.lit(1)).alias("n"))
    totals = o.groupBy("territory", "year").agg(F.count(F.lit(1)).alias("n"))
    return quality.sums_to_total(parts, totals, ["territory", "year"], ["n"])


@query("i07_identities", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year, sum(price) AS whole, sum(CASE WHEN price < 499000 THEN price END) AS parts FROM ord GROUP BY ALL)
SELECT 'identity' AS gate, territory || '|' || year AS key FROM g WHERE abs(whole - parts) > greatest(2000.0, abs(parts) * 0.021)""")
def i07(spark, d):
    g = orders_by_territory(spark, d).groupBy("territory", "year").agg(
        F.sum("price").alias("whole"), F.sum(F.when(F.col("price") < 499000, F.col("price"))).alias("parts"))
    return quality.identity(g, ["territory", "year"], dbl("whole"), dbl("parts"), 2000.0, 0.021).select("gate", "key")


@query("i08_published_rate", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, month, count(*) AS den, count(CASE WHEN status_code = 'F' THEN 1 END) AS num FROM ord GROUP BY ALL),
p AS (SELECT territory, month, den, CASE WHEN substr(month, 5, 2) = '02' THEN NULL ELSE num END AS num, CASE WHEN substr(month, 5, 2) = '03' THEN NULL ELSE round(CAST(num AS DOUBLE) / den * 100) END AS rate FROM g)
SELECT 'rate' AS gate, territory || '|' || month AS key, CASE WHEN num IS NULL OR rate IS NULL THEN 'rate or part absent' ELSE 'rate off its parts' END AS detail
FROM p WHERE num IS NULL OR rate IS NULL OR abs(CAST(num AS DOUBLE) / den * 100 - rate) > 0.2""")
def i08(spark, d):
    of_year = F.substring("month", 5, 2)
    g = orders_by_territory(spark, d).groupBy("territory", "month").agg(F.count(F.lit(1)).alias("den"), F.count_if(F.col("status_code") == "F").alias("num"))
    published = g.withColumns({"rate": F.when(of_year != "03", F.round(F.col("num") / F.col("den") * 100)), "num": F.when(of_year != "02", F.col("num"))})
    return quality.published_rate(published, ["territory", "month"], "num", "den", "rate", 0.2)


@query("i09_references", """
SELECT 'reference' AS gate, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'provenance', count(*) FROM pages WHERE NOT starts_with(url, 'https://')""")
def i09(spark, d):
    parents = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    a = quality.referential(table(spark, d, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", ["o_orderkey"])
    return _count(a.unionByName(quality.https_only(table(spark, d, "pages"), ["page_id"], "url")))


@query("i10_calendar", f"""
WITH {ORDERS_SQL}, p AS (SELECT territory, priority, CASE WHEN price > 499900 AND priority = '5-LOW' THEN '202413' WHEN price > 499900 AND priority = '2-HIGH' THEN NULL ELSE month END AS month FROM ord),
o AS (SELECT territory, priority, CASE WHEN month <> '202413' THEN CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 5, 2) AS INT) END AS m FROM p),
g AS (SELECT territory, priority, count(DISTINCT m) AS n, max(m) - min(m) + 1 AS span, count(CASE WHEN m IS NULL THEN 1 END) AS lost FROM o GROUP BY ALL)
SELECT 'calendar' AS gate, territory || '|' || priority AS key, CASE WHEN lost > 0 THEN lost || ' unreadable months' ELSE n || '/' || span END AS detail FROM g WHERE n <> span OR lost > 0
UNION ALL SELECT 'missing', n_name || '|' || m, 'missing month' FROM nation, (SELECT unnest(['200001', '200002', '200003']) AS m) WHERE (n_name, m) NOT IN (SELECT (territory, month) FROM ord WHERE priority = '1-URGENT')""")
def i10(spark, d):
    o = orders_by_territory(spark, d)
    dear = F.col("price") > 499900
    p = o.withColumn("month", F.when(dear & (F.col("priority") == "5-LOW"), "202413").when(dear & (F.col("priority") == "2-HIGH"), None).otherwise(F.col("month")))
    urgent = o.filter("priority = '1-URGENT'")
    gaps = quality.missing_months(urgent, territories(spark, d).select("territory"), ["territory"], "month", "200001", "200003", gate="missing")
    return quality.continuous(p, ["territory", "priority"], "month").unionByName(gaps)


@query("i10_latest", f"""
WITH {ORDERS_SQL}, p AS (SELECT territory, priority, month, CASE WHEN priority = '5-LOW' THEN '2001-13' WHEN priority = '2-HIGH' THEN NULL ELSE '200108' END AS latest FROM ord),
g AS (SELECT territory, priority, max(month) AS m, max(CASE WHEN latest <> '2001-13' THEN latest END) AS l FROM p GROUP BY ALL)
SELECT 'latest' AS gate, territory || '|' || priority AS key, concat_ws('/', m, l) AS detail FROM g WHERE l IS NULL OR m <> l""")
def i10_latest(spark, d):
    p = orders_by_territory(spark, d).withColumn("latest", F.when(F.col("priority") == "5-LOW", "2001-13").when(F.col("priority") != "2-HIGH", "200108"))
    return quality.last_is_latest(p, ["territory", "priority"], "month", "latest")


@query("i11_volume_floor", """
WITH c AS (SELECT c_custkey, c_custkey // 200 AS page FROM customer)
SELECT 'volume' AS gate, CAST(count(*) AS VARCHAR) AS key, 'below 1000000000' AS detail FROM orders HAVING count(*) < 1000000000
UNION ALL SELECT 'truncation', CAST(page AS VARCHAR), CASE WHEN page % 11 = 5 THEN 'no readable total' ELSE count(*) || '/' || (count(*) + 1) END FROM c WHERE page % 11 = 5 OR page % 7 = 3 GROUP BY page
UNION ALL SELECT 'truncation', '-2', 'no readable total' UNION ALL SELECT 'truncation', '-3', '0/4'""")
def i11(spark, d):
    rows = table(spark, d, "orders")
    odd = param_table(spark, [(-1, '{"numFound":0,"docs":[]}'), (-2, '{"docs":[]}'), (-3, '{"numFound":4}')], "page bigint, body string")
    pages = nested.paged_documents(damaged_pages(spark, d).unionByName(odd), "struct<id: bigint, segment: string>")
    return quality.volume_floor(rows, 1_000_000_000).unionByName(quality.volume_floor(rows, 1)).unionByName(
        quality.declared_total(pages, ["page"], "declared", "received"))


@query("i12_all_or_nothing", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, month, count(DISTINCT CASE WHEN price > 250000 THEN priority END) AS k FROM ord GROUP BY ALL)
SELECT 'partial' AS gate, territory || '|' || month AS key, CASE WHEN k > 0 THEN 'partial opening' ELSE 'undocumented gap' END AS detail FROM g WHERE k BETWEEN 1 AND 4 OR (k = 0 AND month NOT IN ('199501', '200108'))""")
def i12(spark, d):
    o = orders_by_territory(spark, d).withColumn("value", F.when(F.col("price") > 250000, F.col("price")))
    return quality.all_or_nothing(o, ["territory", "month"], "priority", "value", 5, ["199501", "200108"], "month")


@query("i13_recompute", f"""
WITH {YEARLY_SQL} SELECT 'recompute' AS gate, territory || '|' || year AS key, 'summary differs from detail' AS detail FROM yr WHERE state = 'AFRICA'""")
def i13(spark, d):
    detail = yearly_prices(spark, d)
    published = detail.withColumn("n", F.col("n") + F.when(F.col("state") == "AFRICA", 1).otherwise(0))
    return quality.recomputed(published, detail, ["territory", "year"], ["n", "price"])


@query("i13_moved_partitions", f"""
WITH {ORDERS_SQL} SELECT 'recompute' AS gate, territory || '|' || month AS key, 'summary differs from detail' AS detail, CAST(1 AS INTEGER) AS parts_read
FROM ord WHERE state = 'AFRICA' GROUP BY territory, month""")
def i13_partitions(spark, d):
    """Summaries are recomputed from the detail of the one state whose orders were published anew."""
    root = scratch_path(spark, "i13")
    orders = materialize(orders_by_territory(spark, d), "i13-orders")
    summed = lambda df: df.groupBy("state", "territory", "month").agg(F.count(F.lit(1)).alias("n"))
    summary = materialize(summed(orders), "i13-summary")
    gate = lambda t: quality.recomputed(t["summary"], summed(t["detail"]), ["territory", "month"], ["n"])
    roots = {"summary": f"{root}/summary", "detail": f"{root}/detail"}
    keep = lambda staged: [quality.volume_floor(staged, 1)]
    for version, detail in (("1", orders), ("2", orders.unionByName(orders.where("state = 'AFRICA'")))):
        partitions.publish_partitions(detail, roots["detail"], version, ["state"], keep)
        partitions.publish_partitions(summary, roots["summary"], version, ["state"], keep)
        found, read = partitions.judge_moved(spark, roots, f"{root}/checked", gate)
    return found.withColumn("parts_read", F.lit(len(read)))


@query("i14_yield_warnings", f"""
WITH {MOVES_SQL}, g AS (SELECT territory, year, CAST(sum(quantity) AS DOUBLE) AS production, CAST(count(*) AS DOUBLE) AS area, CAST(sum(CASE WHEN sign = 1 THEN quantity END) AS DOUBLE) * 1000 / count(CASE WHEN sign = 1 THEN 1 END) AS y, CAST(count(CASE WHEN kind <> 'EXC' THEN 1 END) AS DOUBLE) AS planted FROM mov GROUP BY ALL)
SELECT 'yield' AS gate, territory || '|' || year AS key, 'yield off production/area' AS detail FROM g WHERE abs(y - production * 1000 / area) > greatest(1.0, production * 1000 / area * 0.03)
UNION ALL SELECT 'area', territory || '|' || year, 'harvested above planted' FROM g WHERE area > planted""")
def i14(spark, d):
    up = F.col("sign") == 1
    g = movements(spark, d).groupBy("territory", "year").agg(
        dbl(F.sum("quantity")).alias("production"), dbl(F.count(F.lit(1))).alias("area"),
        (dbl(F.sum(F.when(up, F.col("quantity")))) * 1000 / F.count_if(up)).alias("y"), dbl(F.count_if(F.col("kind") != "EXC")).alias("planted"))
    return quality.yield_warnings(g, ["territory", "year"], "production", "area", "y", "planted")


@query("i15_confirmed_zero", f"""
WITH {ORDERS_SQL} SELECT 'empty' AS gate, n_name AS key, 'absent from the scan' AS detail FROM nation WHERE n_name NOT IN (SELECT territory FROM ord WHERE price > 499000)""")
def i15(spark, d):
    return quality.confirmed_scan(orders_by_territory(spark, d).filter("price > 499000"), territories(spark, d), "territory")


@query("i16_schema", f"""
WITH {YEARLY_SQL} SELECT detail, (SELECT count(*) FROM yr) AS published_rows FROM (VALUES ('extra price'), ('missing note'), ('n: bigint is not int')) AS t(detail)""")
def i16(spark, d):
    y = yearly_prices(spark, d).select("territory", "year", "price", "n")
    wanted = T.StructType([T.StructField("territory", T.StringType()), T.StructField("year", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("note", T.StringType())])
    found = quality.schema_differences(y.schema, wanted)
    return y.agg(F.count(F.lit(1)).alias("published_rows"), F.array(*[F.lit(x) for x in found]).alias("f")).select(F.explode("f").alias("detail"), "published_rows")


@query("i17_export_contract", f"""
WITH {YEARLY_SQL} SELECT 'export' AS gate, territory || '|' || year || '|' || n AS key, '0/1' AS detail FROM yr WHERE state = 'ASIA' AND year = '1996'""")
def i17(spark, d):
    path = scratch_path(spark, "i17")
    y = materialize(yearly_prices(spark, d), "i17-base")
    cols = ["territory", "year", "n"]
    landing.export_csv(y.filter("NOT (state = 'ASIA' AND year = '1996')"), path, cols)
    back = delimited.read_contract(spark, path, delimited.Layout(tuple(cols)))
    return quality.export_matches(back, y.select(*cols))


@query("i18_revalidation", f"""
WITH {YEARLY_SQL} SELECT 'status' AS gate, count(*) AS violations FROM yr WHERE n < 80 AND state = 'ASIA' HAVING count(*) > 0""")
def i18(spark, d):
    y = yearly_prices(spark, d)
    value = F.when((F.col("n") >= 80), dbl("n"))
    status = F.when((F.col("n") < 80) & (F.col("state") != "ASIA"), "suppressed").otherwise("real")
    return _count(quality.revalidate(y.select("territory", "year", value.alias("value"), status.alias("status")), ["territory", "year"], "value", "status"))
