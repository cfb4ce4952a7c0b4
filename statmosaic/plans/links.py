"""C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, joins, mapping, spatial
from ..session import param_table
from .base import FLOWS_SQL, MOVES_SQL, ORDERS_SQL, YEARLY_SQL, dbl, movements, orders_by_territory, table, territories, yearly_prices
from .registry import query


@query("c01_table_merge", """
WITH a AS (SELECT c_custkey AS id, '1' AS active, c_mktsegment AS segment FROM customer),
b AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'OTHER' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer WHERE c_nationkey <> 3)
SELECT a.segment, count(*) AS n, CAST(count(b.id) AS BIGINT) AS in_both, CAST(count(CASE WHEN b.segment <> a.segment THEN 1 END) AS BIGINT) AS conflicting,
  CAST(count(CASE WHEN b.id IS NULL THEN 1 END) AS BIGINT) AS incomplete FROM a LEFT JOIN b ON a.id = b.id GROUP BY 1""")
def c01(spark, d):
    c = table(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("id"), F.lit("1").alias("active"), F.col("c_mktsegment").alias("segment"))
    b = c.filter("c_nationkey <> 3").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"))
    m = joins.merge_parts({"a": a, "b": b}, ["id"], "active").join(a.select("id", F.col("segment").alias("own")), "id")
    return m.groupBy(F.col("own").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("in_b").alias("in_both"),
        F.count_if(F.array_contains("conflicts", "segment")).alias("conflicting"), F.count_if("incomplete").alias("incomplete"))


@query("c02_lookup_unknown", """
WITH m AS (SELECT CASE WHEN p_size < 10 THEN 'S' || p_size ELSE CAST(p_size AS VARCHAR) END AS code FROM part)
SELECT CASE WHEN code BETWEEN '10' AND '19' THEN code WHEN starts_with(code, 'S') THEN code ELSE 'unknown' END AS code,
 CASE WHEN code BETWEEN '10' AND '19' THEN 'Class ' || code END AS label, CASE WHEN starts_with(code, 'S') THEN 'malformed' END AS code_problem, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def c02(spark, d):
    dictionary = param_table(spark, [(str(i), f"Class {i}") for i in range(10, 20)], "code string, label string")
    size = F.col("p_size").cast("string")
    rows = table(spark, d, "part").select(F.when(F.col("p_size") < 10, F.concat(F.lit("S"), size)).otherwise(size).alias("code"))
    return joins.lookup(rows, dictionary, "code", 2).groupBy("code", "label", "code_problem").agg(F.count(F.lit(1)).alias("n"))


@query("c03_label_strict", """
SELECT p_type AS type, 'labelled' AS outcome, CASE p_type WHEN 'SMALL' THEN 'Pequeno' WHEN 'LARGE' THEN 'Grande' WHEN 'MEDIUM' THEN 'Médio' END AS label, count(*) AS n FROM part GROUP BY ALL
UNION ALL SELECT DISTINCT p_type, 'no label', NULL, CAST(1 AS BIGINT) FROM part WHERE p_type NOT IN ('SMALL', 'LARGE', 'MEDIUM')""")
def c03(spark, d):
    legend = param_table(spark, [("SMALL", "Pequeno"), ("LARGE", "Grande"), ("MEDIUM", "Médio")], "code string, label string")
    rows = joins.label_strict(table(spark, d, "part").select(F.col("p_type").alias("type")), legend, "type")
    g = rows.groupBy("type", "label").agg(F.count(F.lit(1)).alias("n"))
    bad = mapping.unmapped(g, "type", "label")
    return g.withColumn("outcome", F.lit("labelled")).unionByName(
        bad.select("type", F.lit(None).cast("string").alias("label"), F.col("rows").alias("n"), F.lit("no label").alias("outcome")))


@query("c04_code_crosswalk", """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 7, '0') AS code, count(*) AS n FROM customer GROUP BY 1""")
def c04(spark, d):
    codes = territories(spark, d).select(F.substring("code", 2, 6).alias("short"), F.col("code").alias("full"))
    rows = table(spark, d, "customer").select(F.lpad(F.col("c_nationkey").cast("string"), 6, "0").alias("code6"))
    return joins.crosswalk(rows, codes, "code6", "code").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("c06_comparability", f"""
WITH {YEARLY_SQL}, p AS (SELECT territory, state, year, CASE WHEN state = 'ASIA' THEN 'US$' ELSE 'R$' END AS unit, CAST(price AS DOUBLE) AS value FROM yr),
l AS (SELECT year, unit, CASE WHEN year <> '1997' THEN value END AS value FROM p WHERE territory = 'NATION_0')
SELECT p.territory, p.year, p.unit, l.value AS local_value, l.value IS NOT NULL AS comparable, CASE WHEN l.value IS NOT NULL THEN p.value END AS peer_value,
  l.year IS NOT NULL AND l.value IS NULL AS local_repeated
FROM p LEFT JOIN l ON p.year = l.year AND p.unit = l.unit WHERE territory <> 'NATION_0'""")
def c06(spark, d):
    unit = F.when(F.col("state") == "ASIA", "US$").otherwise("R$")
    p = yearly_prices(spark, d).select("territory", "year", unit.alias("unit"), dbl("price").alias("value"))
    own = p.filter("territory = 'NATION_0'")
    twice = own.filter("year = '1997'").withColumn("value", F.col("value") + 1)  # two figures for one year are none
    return joins.comparable(own.unionByName(twice), p.filter("territory <> 'NATION_0'"), ["year", "unit"]).select(
        "territory", "year", "unit", "local_value", "comparable", "peer_value", "local_repeated")


PATH_SQL = """paths AS (SELECT DISTINCT 'R' || r_regionkey AS path FROM region UNION
  SELECT 'R' || n_regionkey || '.N' || n_nationkey FROM nation UNION
  SELECT 'R' || n_regionkey || '.N' || n_nationkey || '.' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _paths(spark, d):
    t = territories(spark, d)
    region, nation = F.concat(F.lit("R"), "r_regionkey"), F.concat(F.lit("R"), "r_regionkey", F.lit(".N"), "n_nationkey")
    c = table(spark, d, "customer").join(t, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.select(region.alias("path")).union(t.select(nation)).union(c.select(F.concat(nation, F.lit("."), "c_mktsegment"))).distinct()


@query("c07_leaf_selection", f"""
WITH {PATH_SQL} SELECT path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM paths q WHERE starts_with(q.path, p.path || '.'))""")
def c07(spark, d):
    return joins.leaves(_paths(spark, d), "path")


@query("c08_reconciliation", f"""
WITH {ORDERS_SQL}, a AS (SELECT territory, segment, count(*) AS computed FROM ord GROUP BY ALL),
b AS (SELECT territory, segment, computed + CASE WHEN segment = 'FURNITURE' THEN 1 ELSE 0 END AS official FROM a WHERE segment <> 'MACHINERY'
  UNION ALL SELECT DISTINCT territory, 'EXTRA', CAST(1 AS BIGINT) FROM ord)
SELECT territory, segment, computed, official, CASE WHEN official IS NULL THEN 'pending' WHEN computed IS NULL THEN 'missing' WHEN computed = official THEN 'matched' ELSE 'mismatch' END AS status
FROM a FULL JOIN b USING (territory, segment)""")
def c08(spark, d):
    a = orders_by_territory(spark, d).groupBy("territory", "segment").agg(F.count(F.lit(1)).alias("value"))
    b = a.filter("segment <> 'MACHINERY'").withColumn("value", F.col("value") + F.when(F.col("segment") == "FURNITURE", 1).otherwise(0))
    extra = a.select("territory").distinct().select("territory", F.lit("EXTRA").alias("segment"), F.lit(1).cast("bigint").alias("value"))
    return joins.reconcile(a, b.unionByName(extra), ["territory", "segment"])


@query("c09_snapshot_diff", f"""
WITH {MOVES_SQL}, cur AS (SELECT territory, year, {FLOWS_SQL} FROM mov GROUP BY ALL), prev AS (SELECT territory, year, {FLOWS_SQL} FROM mov WHERE declared <= '199912' GROUP BY ALL)
SELECT cur.*, prev.admissions AS previous_admissions, prev.dismissals AS previous_dismissals, prev.balance AS previous_balance
FROM cur JOIN prev USING (territory, year) WHERE (cur.admissions, cur.dismissals, cur.balance) <> (prev.admissions, prev.dismissals, prev.balance)""")
def c09(spark, d):
    m = movements(spark, d)
    prev = aggregates.ledger(m.filter("declared <= '199912'"), ["territory", "year"])
    return joins.changed_rows(prev, aggregates.ledger(m, ["territory", "year"]), ["territory", "year"], ["admissions", "dismissals", "balance"])


@query("c10_edition_fallback", f"""
WITH {YEARLY_SQL} SELECT territory, year, CAST(CASE WHEN n >= 85 THEN price WHEN year < '2000' THEN price + 1 END AS DOUBLE) AS price, n < 85 AND year < '2000' AS carried FROM yr""")
def c10(spark, d):
    y = yearly_prices(spark, d)
    current = y.select("territory", "year", F.when(F.col("n") >= 85, dbl("price")).alias("price"))
    previous = y.filter("year < '2000'").select("territory", "year", dbl(F.col("price") + 1).alias("price"))
    return joins.fallback(current, previous, ["territory", "year"], "price")


@query("c11_supersession", f"""
WITH {ORDERS_SQL}, a AS (SELECT DISTINCT year FROM ord WHERE price > 499950 AND year < '2000')
SELECT month, count(*) AS n FROM ord WHERE year NOT IN (SELECT year FROM a) GROUP BY 1""")
def c11(spark, d):
    o = orders_by_territory(spark, d)
    return joins.superseded(o, o.filter("price > 499950 AND year < '2000'").select("year")).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


def _points(spark, d):
    """Parts placed on a plane by their own measures."""
    return table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") * 0.9 + 0.0003).alias("x"), (F.col("p_retailprice") / 40.0 + 0.001).alias("y"))


def _shapes(spark, d):
    """One diamond with a square hole per territory, on a 5 by 5 lattice."""
    t = territories(spark, d)
    cx, cy = F.col("n_nationkey") % 5 * 10.0 + 4.0, F.floor(F.col("n_nationkey") / 5) * 10.0 + 24.0
    ring = lambda pts: F.array(*[F.array(cx + float(a), cy + float(b)) for a, b in pts])
    outer, hole = [(-6, 0), (0, -6), (6, 0), (0, 6), (-6, 0)], [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return t.select("territory", F.array(F.array(ring(outer), ring(hole))).alias("geometry"))


SHAPE_SQL = """pts AS (SELECT p_partkey, p_brand, p_size * CAST(0.9 AS DOUBLE) + CAST(0.0003 AS DOUBLE) AS x, p_retailprice / CAST(40.0 AS DOUBLE) + CAST(0.001 AS DOUBLE) AS y FROM part),
ctr AS (SELECT n_name AS territory, n_nationkey % 5 * CAST(10 AS DOUBLE) + 4 AS cx, (n_nationkey // 5) * CAST(10 AS DOUBLE) + 24 AS cy FROM nation)"""


@query("c12_point_in_polygon_join", f"""
WITH {SHAPE_SQL} SELECT territory, count(*) AS n, min(p_partkey) AS first_part FROM pts, ctr
WHERE abs(x - cx) + abs(y - cy) < 6 AND NOT (abs(x - cx) < 1 AND abs(y - cy) < 1) GROUP BY 1""")
def c12(spark, d):
    return spatial.points_in_shapes(_points(spark, d), _shapes(spark, d), "x", "y", "geometry", 4.0).groupBy("territory").agg(
        F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


@query("c13_export_provenance", f"""
WITH {YEARLY_SQL} SELECT territory, year, n, CASE WHEN state <> 'ASIA' THEN 'Title ' || state END AS title FROM yr""")
def c13(spark, d):
    sources = territories(spark, d).filter("state <> 'ASIA'").select(F.col("state").alias("source_id"), F.concat(F.lit("Title "), "state").alias("title")).distinct()
    rows = yearly_prices(spark, d).select("territory", "year", "n", F.col("state").alias("source_id"))
    return mapping.with_provenance(rows, sources).select("territory", "year", "n", "title")


@query("c14_cross_ratio", f"""
WITH {YEARLY_SQL}, st AS (SELECT state, year, sum(price) AS den FROM yr WHERE year <> '1997' GROUP BY ALL)
SELECT territory, year, CAST(price AS DOUBLE) AS numerator, CAST(den AS DOUBLE) AS denominator, CAST(price AS DOUBLE) / CAST(den AS DOUBLE) * 100 AS ratio FROM yr JOIN st USING (state, year)""")
def c14(spark, d):
    y = yearly_prices(spark, d)
    den = y.filter("year <> '1997'").groupBy("state", "year").agg(dbl(F.sum("price")).alias("denominator"))
    return joins.matched_ratio(y.select("territory", "state", "year", dbl("price").alias("numerator")), den, ["state", "year"], 100.0).drop("state")


@query("c15_region_membership", """
WITH m AS (SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' UNION ALL SELECT n_nationkey, 'MERGED' FROM nation WHERE n_nationkey < 3),
u AS (SELECT n_nationkey, min(region) AS region, count(DISTINCT region) AS k FROM m GROUP BY 1)
SELECT region, CASE WHEN k IS NULL THEN 'no region' WHEN k > 1 THEN 'ambiguous region' END AS problem, count(*) AS n FROM customer LEFT JOIN u ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def c15(spark, d):
    t = territories(spark, d)
    members = t.filter("state <> 'EUROPE'").select(F.col("n_nationkey").alias("c_nationkey"), F.col("state").alias("region")).unionByName(
        t.filter("n_nationkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("MERGED").alias("region")))
    return joins.one_membership(table(spark, d, "customer").select("c_custkey", "c_nationkey"), members, "c_nationkey", "region").groupBy(
        "region", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("c16_scope_and_missing", """
SELECT c_mktsegment AS segment, CAST(count(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 1 END) AS BIGINT) AS in_scope,
 CAST(count(CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 END) AS BIGINT) AS missing FROM customer GROUP BY 1""")
def c16(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    a = joins.in_scope(c, o.filter("o_totalprice > 400000"), ["c_custkey"]).select("c_mktsegment", F.lit(1).alias("a"), F.lit(0).alias("b"))
    gone = joins.missing_from(c, o, ["c_custkey"]).join(c, "c_custkey").select("c_mktsegment", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return a.unionByName(gone).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("a").alias("in_scope"), F.sum("b").alias("missing"))
