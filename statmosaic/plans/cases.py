"""Further subject areas on the given tables: domain functions with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domains import cubes, employment, environment, health, social
from ..session import materialize
from .base import FIRST_MONTH, FLOWS_SQL, LAST_MONTH, MONTHS_SQL, MOVES_SQL, ORDERS_SQL, YEARS, dbl, orders_by_territory, table, territories
from .registry import query
from .subjects import _accounts, _movements, environment_land

SECTOR_SQL = "CASE segment WHEN 'AUTOMOBILE' THEN 'agriculture' WHEN 'BUILDING' THEN 'industry' WHEN 'FURNITURE' THEN 'construction' WHEN 'HOUSEHOLD' THEN 'commerce' ELSE 'services' END"


@query("employment_sector_series", f"""
WITH {MOVES_SQL}, {MONTHS_SQL}, led AS (SELECT territory, month, {SECTOR_SQL} AS sector, {FLOWS_SQL} FROM mov GROUP BY ALL),
s AS (SELECT n_name AS territory, month, sector FROM nation, cal, (SELECT unnest(['agriculture', 'industry', 'construction', 'commerce', 'services']) AS sector))
SELECT territory, month, sector, coalesce(admissions, 0) AS admissions, coalesce(dismissals, 0) AS dismissals, coalesce(balance, 0) AS balance FROM s LEFT JOIN led USING (territory, month, sector)""")
def employment_sectors(spark, d):
    return employment.sector_series(_movements(spark, d), territories(spark, d), FIRST_MONTH, LAST_MONTH)


@query("employment_finalization_problems", f"""
WITH {MOVES_SQL}, b AS (SELECT territory, month, 'sector' AS dimension, {SECTOR_SQL} AS category, {FLOWS_SQL} FROM mov GROUP BY ALL)
SELECT territory, month, category, admissions, dismissals, balance FROM b WHERE admissions < 0 OR dismissals < 0""")
def employment_finalization(spark, d):
    """Cells of the sector axis that retractions left negative."""
    bad = employment.finalization_problems(_movements(spark, d), ["sector"])
    return bad.filter("axis = 'sector'").select("territory", "month", "category", "admissions", "dismissals", "balance")


@query("employment_national", f"""
WITH {MOVES_SQL} SELECT month, {FLOWS_SQL} FROM mov WHERE month = '199907' GROUP BY 1""")
def employment_national(spark, d):
    """Control figures of one month, which is the function's parameter."""
    return employment.national(_movements(spark, d), "199907")


@query("economy_tax_share", f"""
WITH {ORDERS_SQL} SELECT territory, year AS period, CAST(sum(CASE WHEN segment = 'BUILDING' THEN price END) AS DOUBLE) * 1000 AS numerator, CAST(sum(price) AS DOUBLE) * 1000 AS denominator,
  round(CAST(sum(CASE WHEN segment = 'BUILDING' THEN price END) AS DOUBLE) / CAST(sum(price) AS DOUBLE) * 100, 6) AS ratio FROM ord GROUP BY ALL""")
def economy_tax_share(spark, d):
    return cubes.tax_share(_accounts(spark, d), "vBUILDING", "37").withColumn("ratio", F.round("ratio", 6))


def _products(spark, d):
    """Orders as products: priority is the product, price its value."""
    return orders_by_territory(spark, d).groupBy("state", "territory", F.col("year").alias("period"), F.col("priority").alias("product")).agg(
        dbl(F.sum("price")).alias("value")).withColumns({"metric": F.lit("value"), "unit": F.lit("R$")})


@query("agriculture_state_share", f"""
WITH {ORDERS_SQL}, l AS (SELECT state, territory, priority AS product, year AS period, CAST(sum(price) AS DOUBLE) AS numerator FROM ord GROUP BY ALL),
s AS (SELECT state, priority AS product, year AS period, CAST(sum(price) AS DOUBLE) AS denominator FROM ord GROUP BY ALL)
SELECT state, territory, product, period, 'R$' AS unit, round(numerator / denominator * 100, 6) AS ratio FROM l JOIN s USING (state, product, period)""")
def agriculture_state_share(spark, d):
    """Share of every territory in its state, whose totals are published apart."""
    local = _products(spark, d)
    state = local.groupBy("state", "product", "metric", "unit", "period").agg(F.sum("value").alias("value"))
    return cubes.state_share(local, state).select("state", "territory", "product", "period", "unit", F.round("ratio", 6).alias("ratio"))


@query("agriculture_per_animal", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year AS period, CAST(sum(price) AS DOUBLE) AS numerator, CAST(count(*) AS DOUBLE) AS denominator FROM ord GROUP BY ALL)
SELECT territory, period, numerator, denominator, round(numerator / denominator * 1000, 4) AS ratio FROM g WHERE period <> '1997'""")
def agriculture_per_animal(spark, d):
    """Production and herd of the same period; the herd of one year was not published."""
    p = orders_by_territory(spark, d).groupBy("territory", F.col("year").alias("period")).agg(dbl(F.sum("price")).alias("value"), dbl(F.count(F.lit(1))).alias("animals"))
    herd = p.filter("period <> '1997'").select("territory", "period", F.col("animals").alias("value"))
    return cubes.per_animal(p.select("territory", "period", "value"), herd).withColumn("ratio", F.round("ratio", 4))


def _population(spark, d):
    """Yearly customers with orders as population cells: total, per segment, and the change that was published."""
    o = orders_by_territory(spark, d).withColumnRenamed("year", "period")
    by = o.groupBy("territory", "period", "segment").agg(dbl(F.count(F.lit(1))).alias("value"))
    part = by.select("territory", "period", F.lit("93").alias("variable"), F.create_map(F.lit("s"), F.col("segment")).alias("dims"), "value")
    all_ = o.groupBy("territory", "period").agg(dbl(F.count(F.lit(1))).alias("n"), dbl(F.count_if(F.col("status_code") == "F")).alias("closed"))
    whole = all_.select("territory", "period", F.lit("93").alias("variable"), F.create_map(F.lit("s"), F.lit("T")).alias("dims"), F.col("n").alias("value"))
    change = all_.select("territory", "period", F.lit("95").alias("variable"), F.create_map(F.lit("s"), F.lit("T")).alias("dims"), F.col("closed").alias("value"))
    return part, whole, change


@query("population_shares", f"""
WITH {ORDERS_SQL}, p AS (SELECT territory, year AS period, segment AS category, CAST(count(*) AS DOUBLE) AS value FROM ord GROUP BY ALL), t AS (SELECT territory, year AS period, CAST(count(*) AS DOUBLE) AS total FROM ord GROUP BY ALL)
SELECT territory, period, category, value, total, round(value / total * 100, 9) AS percent, TRUE AS balanced FROM p JOIN t USING (territory, period)""")
def population_shares(spark, d):
    part, whole, _ = _population(spark, d)
    return cubes.shares(part.unionByName(whole), "s", "T").withColumn("percent", F.round("percent", 9))


@query("population_growth", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year AS period, CAST(count(*) AS DOUBLE) AS population, CAST(count(CASE WHEN status_code = 'F' THEN 1 END) AS DOUBLE) AS change FROM ord GROUP BY ALL)
SELECT territory, period, population, change, population - change AS base, CASE WHEN population > change THEN round(change / (population - change) * 100, 6) END AS growth FROM g""")
def population_growth(spark, d):
    _, whole, change = _population(spark, d)
    return cubes.growth(whole.unionByName(change), "93", "95").withColumn("growth", F.round("growth", 6))


@query("environment_land_change", """
WITH x AS (SELECT r_name AS territory, year(l_shipdate) AS y, CAST(sum(CASE WHEN p_size <= 8 THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS forest
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT territory, max(CASE WHEN y = 1996 THEN forest END) AS start_value, max(CASE WHEN y = 2000 THEN forest END) AS end_value,
  max(CASE WHEN y = 2000 THEN forest END) - max(CASE WHEN y = 1996 THEN forest END) AS difference FROM x WHERE y IN (1996, 2000) GROUP BY 1""")
def environment_change(spark, d):
    """Change of one group between two chosen years, both parameters."""
    return environment.land_change(environment_land(spark, d), "forest", "1996", "2000")


@query("health_bed_series", f"""
WITH {ORDERS_SQL}, b AS (SELECT DISTINCT territory, month, o_custkey AS unit FROM ord WHERE status_code <> 'O'),
v AS (SELECT b.*, CAST(unit % 50 AS BIGINT) AS existing, CAST(unit % 20 % (unit % 50 + 1) AS BIGINT) AS sus FROM b), m AS (SELECT DISTINCT month FROM ord),
s AS (SELECT n_name AS territory, month FROM nation, m), g AS (SELECT territory, month, sum(existing) AS existing, sum(sus) AS sus, count(*) AS units FROM v GROUP BY ALL)
SELECT territory, month, CAST(coalesce(existing, 0) AS BIGINT) AS existing, CAST(coalesce(sus, 0) AS BIGINT) AS sus, coalesce(units, 0) AS units, units IS NULL AS zero_confirmed FROM s LEFT JOIN g USING (territory, month)""")
def health_bed_series(spark, d):
    """Customers as hospitals reporting in the months of their orders; open orders are disabled units."""
    o = orders_by_territory(spark, d)
    k = F.col("o_custkey")
    text = lambda c: c.cast("string")
    raw = o.select(
        F.col("code").alias("CO_IBGE"), F.col("state").alias("UF"), F.col("month").alias("COMP"), text(k).alias("CNES"),
        F.when(F.col("status_code") == "O", "03").otherwise("").alias("MOTIVO_DESABILITACAO"), text(k % 50).alias("LEITOS_EXISTENTES"),
        text(k % 20 % (k % 50 + 1)).alias("LEITOS_SUS"), F.lit("0").alias("UTI_TOTAL_EXIST"), F.lit("0").alias("UTI_TOTAL_SUS"))
    raw = materialize(raw, "beds")
    walk = territories(spark, d).select(F.col("code").alias("source_code"), F.col("state").alias("state_code"), F.col("territory").alias("code"))
    rows = health.beds(raw, walk)
    return health.bed_series(rows, health.months_in(raw), territories(spark, d)).select("territory", "month", "existing", "sus", "units", "zero_confirmed")


@query("economy_account_violations", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year, count(*) AS n, CAST(sum(price) AS DOUBLE) AS added, CAST(coalesce(sum(CASE WHEN segment = 'BUILDING' THEN price END), 0) AS DOUBLE) AS tax FROM ord GROUP BY ALL)
SELECT 'product' AS gate, territory || '|' || year AS key FROM g WHERE n % 3 = 0
UNION ALL SELECT 'value added', territory || '|' || year FROM g WHERE n % 5 = 0""")
def economy_account_violations(spark, d):
    """Accounts of every territory and year: each third product is 2,500 too high, each fifth sector sum 4,500."""
    price, tax = F.sum("price"), F.coalesce(F.sum(F.when(F.col("segment") == "BUILDING", F.col("price"))), F.lit(0))
    n = F.count(F.lit(1))
    half = price * 0.5
    cell = lambda name, v: F.struct(F.lit(name).alias("variable"), v.cast("double").alias("value"))
    g = orders_by_territory(spark, d).groupBy("territory", F.col("year").alias("period")).agg(F.array(
        cell("product", price + tax + F.when(n % 3 == 0, 2500).otherwise(0)), cell("added", price), cell("tax", tax),
        cell("first", half), cell("second", price - half + F.when(n % 5 == 0, 4500).otherwise(0))).alias("cells"))
    cells = g.select("territory", "period", F.explode("cells").alias("c")).select("territory", "period", "c.*")
    return cubes.account_violations(cells, "product", "added", "tax", ["first", "second"]).select("gate", "key")


@query("economy_compared", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year AS period, CASE WHEN year = '1998' THEN 't' ELSE 'R$' END AS unit, count(*) AS value FROM ord GROUP BY ALL),
own AS (SELECT * FROM g WHERE territory = (SELECT min(territory) FROM g) AND period = (SELECT max(period) FROM g WHERE territory = (SELECT min(territory) FROM g)))
SELECT g.territory, g.period, g.unit, g.value, own.value AS local_value, own.value IS NOT NULL AS comparable
FROM g LEFT JOIN own ON g.period = own.period AND g.unit = own.unit WHERE g.territory <> (SELECT min(territory) FROM g)""")
def economy_compared(spark, d):
    """All territories beside the first one's latest figure; other years and units show nothing."""
    o = orders_by_territory(spark, d)
    series = materialize(o.groupBy("territory", F.col("year").alias("period")).agg(F.count(F.lit(1)).alias("value")).withColumns({
        "indicator": F.lit("orders"), "methodology": F.lit("m"), "unit": F.when(F.col("period") == "1998", "t").otherwise("R$")}), "series")
    first = series.agg(F.min("territory")).first()[0]
    return cubes.compared(series, first).select("territory", "period", "unit", "value", "local_value", "comparable")


@query("agriculture_typology_violations", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year, count(*) AS n, count(CASE WHEN segment = 'BUILDING' THEN 1 END) AS part FROM ord GROUP BY ALL)
SELECT 'typology' AS gate, territory || '|183|' || year AS key FROM g WHERE n % 4 = 1""")
def agriculture_typology(spark, d):
    """Orders by builders and by others against all: each fourth total is three too high, the others one."""
    n, part = F.count(F.lit(1)), F.count_if(F.col("segment") == "BUILDING")
    cell = lambda c, v: F.struct(F.create_map(F.lit("829"), F.lit(c)).alias("dims"), v.cast("double").alias("value"))
    g = orders_by_territory(spark, d).groupBy("territory", F.col("year").alias("period")).agg(F.array(
        cell("T", n + F.when(n % 4 == 1, 3).otherwise(1)), cell("F", part), cell("N", n - part)).alias("cells"))
    cells = g.select("territory", F.lit("183").alias("variable"), "period", F.explode("cells").alias("c")).select("territory", "variable", "period", "c.*")
    return cubes.typology_violations(cells, "829", "T", ["F", "N"]).select("gate", "key")


@query("employment_stock_shares", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year, segment AS sector, count(*) AS stock FROM ord GROUP BY ALL), t AS (SELECT territory, year, sum(stock) AS total FROM g GROUP BY ALL)
SELECT territory, year, sector, stock, CAST(total + CASE WHEN year = '1996' THEN 1 ELSE 0 END AS BIGINT) AS total, round(CAST(stock AS DOUBLE) / CAST(total + CASE WHEN year = '1996' THEN 1 ELSE 0 END AS DOUBLE) * 100, 6) AS percent, year <> '1996' AS balanced FROM g JOIN t USING (territory, year)""")
def employment_stock_shares(spark, d):
    """Sectors of every year against its published total, which is one too high in 1996."""
    g = orders_by_territory(spark, d).groupBy("territory", "year", F.col("segment").alias("sector")).agg(F.count(F.lit(1)).alias("stock"))
    total = g.groupBy("territory", "year").agg((F.sum("stock") + F.when(F.col("year") == "1996", 1).otherwise(0)).alias("stock")).withColumn("sector", F.lit("total"))
    shares = employment.stock_shares(g.unionByName(total))
    return shares.select("territory", "year", "sector", F.col("value").alias("stock"), "total", F.round(F.col("percent").cast("double"), 6).alias("percent"), "balanced")


@query("social_per_hundred", f"""
WITH {ORDERS_SQL}, p AS (SELECT territory, month, count(*) AS value FROM ord GROUP BY ALL), y AS (SELECT territory, year, count(*) AS population FROM ord WHERE year <> '1997' GROUP BY ALL)
SELECT p.territory, month, value, population, round(CAST(value AS DOUBLE) / population * 100, 6) AS per_100 FROM p LEFT JOIN y ON p.territory = y.territory AND substr(month, 1, 4) = y.year""")
def social_per_hundred(spark, d):
    """Orders of every month per hundred of the same year; one year has no estimate."""
    o = orders_by_territory(spark, d)
    people = o.groupBy("territory", "month").agg(F.count(F.lit(1)).alias("value"))
    population = o.groupBy("territory", "year").agg(F.count(F.lit(1)).alias("population")).filter("year <> '1997'")
    return social.per_hundred(people, population).select("territory", "month", "value", "population", F.round("per_100", 6).alias("per_100"))


@query("social_service_months", f"""
WITH {ORDERS_SQL}, f AS (SELECT territory, CAST(right(month, 2) AS INT) AS mes, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey % 10 END AS a1, o_custkey % 5 AS a2, 1 AS c1 FROM ord),
g AS (SELECT territory, '2025' || lpad(CAST(mes AS VARCHAR), 2, '0') AS month, count(*) AS reporting_units, CAST(CASE WHEN count(*) = count(a1) THEN sum(a1) END AS BIGINT) AS a1, CAST(sum(a2) AS BIGINT) AS a2, CAST(sum(c1) AS BIGINT) AS c1 FROM f GROUP BY ALL),
s AS (SELECT n_name AS territory, '2025' || lpad(CAST(m AS VARCHAR), 2, '0') AS month FROM nation, range(1, 13) AS r(m))
SELECT territory, month, coalesce(reporting_units, 0) AS reporting_units, a1, a2, c1 FROM s LEFT JOIN g USING (territory, month)""")
def social_service_months(spark, d):
    """Orders as forms of their calendar month; one unanswered form leaves its month without that total."""
    text = lambda c: c.cast("string")
    k = F.col("o_orderkey")
    forms = orders_by_territory(spark, d).select(
        "territory", F.substring("month", 5, 2).cast("int").cast("string").alias("mes"), F.when(k % 97 == 0, "").otherwise(text(k % 10)).alias("a1"),
        text(F.col("o_custkey") % 5).alias("a2"), F.lit("1").alias("c1"))
    return social.service_months(forms, territories(spark, d), "2025")


@query("health_mappable", """
WITH u AS (SELECT n_name AS territory, c_custkey AS unit, c_acctbal > 0 AS active, (c_nationkey % 5) * 4 + c_custkey % 6 + 0.5 AS x, (c_nationkey // 5) * 4 + c_custkey % 5 + 0.5 AS y, (c_nationkey % 5) * 4 AS x0, (c_nationkey // 5) * 4 AS y0
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT territory, unit FROM u WHERE active AND unit % 11 <> 0 AND x < x0 + 4 AND y < y0 + 4""")
def health_mappable(spark, d):
    """Active units inside their own territory's square; some lie beyond it, some have no place."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    units = table(spark, d, "customer").join(territories(spark, d), n == F.col("n_nationkey")).select(
        "territory", k.alias("unit"), (F.col("c_acctbal") > 0).alias("active"), F.when(k % 11 != 0, F.floor(n / 5) * 4 + k % 5 + 0.5).cast("double").alias("latitude"),
        (n % 5 * 4 + k % 6 + 0.5).cast("double").alias("longitude"))
    x, y = F.col("n_nationkey") % 5 * 4.0, F.floor(F.col("n_nationkey") / 5) * 4.0
    corners = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    square = F.array(F.array(F.array(*[F.array(x + float(a), y + float(b)) for a, b in corners])))
    return health.mappable(units, territories(spark, d).select("territory", square.alias("geometry")), 1.0)
