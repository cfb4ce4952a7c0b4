"""J: disclosure control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import disclosure
from ..session import materialize
from .base import FLOWS_SQL, MOVES_SQL, ORDERS_SQL, dbl, movements, orders_by_territory, table
from .panels import MERGE_SQL
from .registry import query

CELLS_SQL = ORDERS_SQL + """, cells AS (SELECT territory, month, segment, count(*) AS value, CAST(sum(price) AS DOUBLE) AS money,
  CASE WHEN segment = 'MACHINERY' THEN 'unidades' ELSE 'pessoas' END AS unit FROM ord GROUP BY ALL)"""


def _cells(spark, d):
    unit = F.when(F.col("segment") == "MACHINERY", "unidades").otherwise("pessoas")
    return orders_by_territory(spark, d).groupBy("territory", "month", "segment").agg(
        F.count(F.lit(1)).alias("value"), dbl(F.sum("price")).alias("money")).withColumns({"unit": unit, "status": F.lit("real")})


def _primary(spark, d):
    return disclosure.suppress_primary(_cells(spark, d), "value", "unit", "status", ["pessoas", "famílias"])


PRIMARY_SQL = CELLS_SQL + """, prim AS (SELECT territory, month, segment, unit, money, CASE WHEN NOT (unit = 'pessoas' AND value BETWEEN 1 AND 2) THEN value END AS value,
  CASE WHEN unit = 'pessoas' AND value BETWEEN 1 AND 2 THEN 'suppressed' ELSE 'real' END AS status FROM cells)"""


@query("j01_primary_suppression", f"WITH {CELLS_SQL} SELECT territory, month, segment, unit, CASE WHEN NOT (unit = 'pessoas' AND value BETWEEN 1 AND 4) THEN value END AS value, CASE WHEN unit = 'pessoas' AND value BETWEEN 1 AND 4 THEN 'suppressed' ELSE 'real' END AS status FROM cells")
def j01(spark, d):
    return _primary(spark, d).select("territory", "month", "segment", "unit", "value", "status")


def _limit3(spark, d):
    """Same cells under a lower limit, so that some groups stay open."""
    return disclosure.suppress_primary(_cells(spark, d), "value", "unit", "status", ["pessoas"], limit=3)


@query("j02_sibling_suppression", f"""
WITH {PRIMARY_SQL}, f AS (SELECT *, bool_or(status = 'suppressed') OVER (PARTITION BY territory, month) AS hit FROM prim)
SELECT territory, month, segment, CASE WHEN NOT hit THEN value END AS value, CASE WHEN hit THEN 'suppressed' ELSE status END AS status FROM f""")
def j02(spark, d):
    return disclosure.suppress_siblings(_limit3(spark, d), ["territory", "month"], ["value"], "status").select("territory", "month", "segment", "value", "status")


@query("j02_sibling_null_groups", f"""
WITH {PRIMARY_SQL}, n AS (SELECT * REPLACE (CASE WHEN substr(month, 5, 2) IN ('01', '02') THEN NULL ELSE month END AS month) FROM prim),
f AS (SELECT *, bool_or(status = 'suppressed') OVER (PARTITION BY territory, month) AS hit FROM n)
SELECT territory, month, segment, CASE WHEN NOT hit THEN value END AS value, CASE WHEN hit THEN 'suppressed' ELSE status END AS status FROM f""")
def j02_null_groups(spark, d):
    """The form for groups of any length, on groups whose key is unknown."""
    cells = _limit3(spark, d).withColumn("month", F.when(~F.substring("month", 5, 2).isin("01", "02"), F.col("month")))
    return disclosure.suppress_siblings(materialize(cells, "cells"), ["territory", "month"], ["value"], "status", bounded=False).select(
        "territory", "month", "segment", "value", "status")


@query("j03_block_suppression", f"""
WITH {PRIMARY_SQL}, f AS (SELECT *, bool_or(status = 'suppressed' AND segment IN ('BUILDING', 'FURNITURE')) OVER (PARTITION BY territory, month) AS hit FROM prim)
SELECT territory, month, segment, CASE WHEN NOT hit THEN value END AS value, CASE WHEN NOT hit THEN money END AS money, CASE WHEN hit THEN 'suppressed' ELSE status END AS status FROM f""")
def j03(spark, d):
    return disclosure.suppress_siblings(
        _limit3(spark, d), ["territory", "month"], ["value", "money"], "status", F.col("segment").isin("BUILDING", "FURNITURE")
    ).select("territory", "month", "segment", "value", "money", "status")


@query("j04_merge_small", f"WITH {MOVES_SQL}, base AS (SELECT state, month, p_brand, {FLOWS_SQL} FROM mov JOIN part ON l_partkey = p_partkey GROUP BY ALL),"
       + MERGE_SQL.format(k="state, month", c="p_brand"))
def j04(spark, d):
    m = movements(spark, d).join(
        table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return disclosure.merge_small(agg.ledger(m, ["state", "month", "p_brand"]), ["state", "month"], "p_brand")


@query("j05_minimum_sample", f"""
WITH {ORDERS_SQL} SELECT territory, segment, month, CASE WHEN count(*) >= 5 THEN CAST(sum(price) AS DOUBLE) / count(*) END AS mean FROM ord GROUP BY ALL""")
def j05(spark, d):
    n = F.count(F.lit(1))
    return orders_by_territory(spark, d).groupBy("territory", "segment", "month").agg(
        disclosure.sampled(dbl(F.sum("price")) / n, n).alias("mean"))


@query("j06_field_allow_list", """
SELECT field, (SELECT count(*) FROM customer) AS rows_checked FROM (VALUES ('address.name'), ('c_acctbal'), ('c_custkey')) AS t(field)""")
def j06(spark, d):
    rows = table(spark, d, "customer").withColumn("address", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("code")))
    bad = disclosure.forbidden_fields(
        rows.schema, ["c_name", "c_nationkey", "c_mktsegment", "c_custkey", "address", "address.name", "address.code"], named=[], identifiers=["c_custkey"])
    return rows.agg(F.count("address").alias("rows_checked")).select(F.explode(F.array(*[F.lit(b) for b in bad])).alias("field"), "rows_checked")


@query("j07_leak_scan", """
WITH c AS (SELECT 'text' AS "column", text AS t FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'lang', lang FROM documents)
SELECT "column", count(*) AS rows FROM c WHERE regexp_matches(t, '[A-Za-z0-9._]+@[A-Za-z0-9.]+|\\d{3}[-. ]\\d{3}[-. ]\\d{3,4}') GROUP BY 1""")
def j07(spark, d):
    return disclosure.leaks(table(spark, d, "documents"), ["text", "source", "lang"], r"[A-Za-z0-9._]+@[A-Za-z0-9.]+|\d{3}[-. ]\d{3}[-. ]\d{3,4}")
