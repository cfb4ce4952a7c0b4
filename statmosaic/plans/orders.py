"""F: sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import disclosure, ranking, spatial
from .base import FLOWS_SQL, MOVES_SQL, ORDERS_SQL, YEARLY_SQL, dbl, dec, movements, orders_by_territory, table, territories, yearly_prices
from .registry import query


def _brands(spark, d):
    m = movements(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return m.groupBy("state", "p_brand").agg(F.sum("quantity").alias("value"), F.count(F.lit(1)).alias("n"))


BRANDS_SQL = MOVES_SQL + ", b AS (SELECT state, p_brand, sum(quantity) AS value, count(*) AS n FROM mov JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query("f01_rank_products", f"""
WITH {BRANDS_SQL} SELECT state, p_brand, CAST(CASE WHEN p_brand <> 'Brand#7' THEN value END AS DOUBLE) AS value,
 CAST(row_number() OVER (PARTITION BY state ORDER BY CASE WHEN p_brand <> 'Brand#7' THEN value END DESC NULLS LAST, lower(p_brand), p_brand) AS INT) AS position FROM b WHERE p_brand <> 'Brand#3'""")
def f01(spark, d):
    b = _brands(spark, d).withColumn("value", F.when(F.col("p_brand") != "Brand#7", F.col("value")))
    return ranking.rank_products(b, ["state"], "value", "p_brand", F.col("p_brand") != "Brand#3").select("state", "p_brand", dbl("value").alias("value"), "position")


@query("f02_topk_tail", f"""
WITH {BRANDS_SQL}, g AS (SELECT state, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'other' WHEN p_brand = 'Brand#3' THEN 'unknown' ELSE p_brand END AS code, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, code) AS k FROM g WHERE code NOT IN ('other', 'unknown'))
SELECT state, code, n, CAST(k AS INT) AS position FROM r WHERE k <= 10 UNION ALL SELECT state, code, n, CASE code WHEN 'other' THEN 11 ELSE 12 END FROM g WHERE code IN ('other', 'unknown')""")
def f02(spark, d):
    code = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "other").when(F.col("p_brand") == "Brand#3", "unknown").otherwise(F.col("p_brand"))
    g = _brands(spark, d).groupBy("state", code.alias("code")).agg(F.sum("n").alias("n"))
    return ranking.top_with_tail(g, ["state"], "code", [F.desc("n"), F.asc("code")], 10)


STATION_SQL = """st AS (SELECT s_suppkey AS id, s_nationkey, CAST(-26 AS DOUBLE) + (s_suppkey % 97) / CAST(64 AS DOUBLE) AS lat, CAST(-52 AS DOUBLE) + (s_suppkey % 89) / CAST(64 AS DOUBLE) AS lon FROM supplier),
ce AS (SELECT n_name AS territory, CAST(-26 AS DOUBLE) + (n_nationkey % 5) * CAST(0.25 AS DOUBLE) AS clat, CAST(-52 AS DOUBLE) + (n_nationkey // 5) * CAST(0.25 AS DOUBLE) AS clon FROM nation),
dist AS (SELECT territory, id, s_nationkey, 2 * CAST(6371 AS DOUBLE) * asin(least(1.0, sqrt(power(sin(radians(lat - clat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * power(sin(radians(lon - clon) / 2), 2)))) AS km FROM st, ce)"""


def _stations(spark, d):
    """Suppliers as gauge stations on a lattice of degrees."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"), "s_nationkey", (F.lit(-26.0) + k % 97 / 64.0).alias("lat"), (F.lit(-52.0) + k % 89 / 64.0).alias("lon"))


def _centers(spark, d):
    n = F.col("n_nationkey")
    return territories(spark, d).select(
        "territory", (F.lit(-26.0) + n % 5 * 0.25).alias("clat"), (F.lit(-52.0) + F.floor(n / 5) * 0.25).alias("clon"))


@query("f03_nearest_k", f"""
WITH {STATION_SQL} SELECT territory, id, CAST(position AS INT) AS position, CAST(round(km * 1000) AS BIGINT) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY territory ORDER BY km, id) AS position FROM dist WHERE km <= 50) WHERE position <= 10""")
def f03(spark, d):
    return spatial.nearest_within(_stations(spark, d), _centers(spark, d), ["territory"], "id", "lat", "lon", "clat", "clon", 50.0, 10).select(
        "territory", "id", "position", F.round(F.col("distance_km") * 1000).cast("bigint").alias("metres"))


@query("f04_catalog_order", f"WITH {YEARLY_SQL} SELECT state AS module, territory || '-' || year AS id, n FROM yr")
def f04(spark, d):
    return ranking.catalog_order(yearly_prices(spark, d).select(F.col("state").alias("module"), F.concat_ws("-", "territory", "year").alias("id"), "n"))


@query("f05_registry_order", "SELECT s_acctbal > 0 AS active, s_name AS name, s_suppkey AS code FROM supplier")
def f05(spark, d):
    return ranking.registry_order(table(spark, d, "supplier").select((F.col("s_acctbal") > 0).alias("active"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("code")), "active", "name", "code")


@query("f06_measure_order", f"WITH {MOVES_SQL} SELECT segment, {FLOWS_SQL} FROM mov GROUP BY 1")
def f06(spark, d):
    return ranking.by_measure(agg.ledger(movements(spark, d), ["segment"]), "balance", "segment")


@query("f07_priority_order", "SELECT o_orderpriority AS id, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS priority FROM orders GROUP BY 1")
def f07(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ranking.by_priority(g, "id", ["3-MEDIUM", "1-URGENT"])


@query("f08_first_matching", f"""
WITH {YEARLY_SQL}, s AS (SELECT territory, count(*) AS points, CAST(sum(n) AS BIGINT) AS n FROM yr WHERE n >= 85 GROUP BY 1) SELECT territory, points, n FROM s WHERE points > 1 ORDER BY n DESC, territory LIMIT 6""")
def f08(spark, d):
    s = yearly_prices(spark, d).filter("n >= 85").groupBy("territory").agg(F.count(F.lit(1)).alias("points"), F.sum("n").alias("n"))
    return ranking.first_matching(s, F.col("points") > 1, [F.desc("n"), F.asc("territory")], 6)


@query("f09_recent_years", f"""
WITH {ORDERS_SQL}, m AS (SELECT max(CAST(year AS INT)) AS y FROM ord) SELECT month, territory, count(*) AS n FROM ord, m WHERE CAST(year AS INT) > y - 2 GROUP BY ALL""")
def f09(spark, d):
    g = orders_by_territory(spark, d).groupBy("year", "month", "territory").agg(F.count(F.lit(1)).alias("n"))
    return ranking.recent_years(g, "year").select("month", "territory", "n").orderBy("month", "territory")


@query("f10_default_choice", f"""
WITH {BRANDS_SQL}, v AS (SELECT state, p_brand, coalesce(CASE WHEN state <> 'ASIA' THEN value END, CAST(n AS DECIMAL(20,2)), -1) AS v FROM b)
SELECT state, p_brand, CAST(v AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY v DESC, p_brand) AS k FROM v) WHERE k = 1""")
def f10(spark, d):
    b = _brands(spark, d).select("state", "p_brand", F.when(F.col("state") != "ASIA", F.col("value")).alias("value"), dec("n", 20).alias("herd"))
    return ranking.default_choice(b, ["state"], "p_brand", "value", "herd").withColumn("value", dbl("value"))


@query("f11_protected_order", f"WITH {MOVES_SQL} SELECT state, priority, {FLOWS_SQL} FROM mov GROUP BY ALL")
def f11(spark, d):
    return disclosure.display_order(agg.ledger(movements(spark, d), ["state", "priority"]), ["state"], "priority")
