"""Subject areas on the given tables: whole jobs of the domain modules with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domains import cubes, education, employment, environment, health, social
from ..operators import mapping, quality, refresh
from ..session import materialize, param_table, scratch_path
from ..sources.delimited import write_contract
from .base import FIRST_MONTH, LAST_MONTH, MONTHS_SQL, MOVES_SQL, ORDERS_SQL, YEARS, dbl, dec, movements, orders_by_territory, table, territories
from .panels import MERGE_SQL, TRAILING_SQL, W_SQL, Y_SQL, YTD_SQL
from .registry import query

SECTION = {"AUTOMOBILE": "A", "BUILDING": "C", "FURNITURE": "F", "HOUSEHOLD": "G", "MACHINERY": "H"}


def _movement_texts(spark, d, months=None):
    """Lines as the text columns of the movement publication."""
    m = movements(spark, d, months)
    exc, late = F.col("kind") == "EXC", F.col("kind") == "FOR"
    pub = F.when(F.col("kind") == "MOV", F.col("month")).otherwise(F.col("declared"))
    return m.select(
        "kind", F.col("month").alias("competenciamov"), pub.alias("publication"), pub.alias("competenciadec"), F.when(exc, pub).alias("competenciaexc"),
        F.when(exc, "1").alias("indicadordeexclusao"), F.when(late, "1").otherwise("0").alias("indicadordeforadoprazo"), F.col("code").alias("municipio"),
        F.col("state").alias("uf"), mapping.classify(F.col("segment"), SECTION).alias("secao"), F.col("l_linenumber").cast("string").alias("subclasse"),
        F.substring("priority", 1, 1).alias("cbo2002ocupacao"), F.col("sign").cast("string").alias("saldomovimentacao"),
        F.when(F.col("sign") == 1, "10").otherwise("31").alias("tipomovimentacao"), F.translate(F.col("salary").cast("string"), ".", ",").alias("salario"),
        F.when(F.col("l_linenumber") == 6, "1").otherwise("0").alias("indtrabintermitente"))


def _movements(spark, d, months=None):
    acts = param_table(spark, [(f"{i:07}", f"Activity {i}") for i in range(1, 7)], "code string, label string")
    jobs = param_table(spark, [(f"{i:06}", f"Job {i}") for i in range(1, 5)], "code string, label string")
    wages = param_table(spark, [(y, 200.0) for y in YEARS], "year string, minimum double")
    typed = employment.movements(_movement_texts(spark, d, months), acts, jobs, wages)
    walk = territories(spark, d).select(F.col("code").alias("source_code"), F.col("state").alias("state_code"), F.col("territory").alias("code"))
    return mapping.in_territory(typed.filter("problem IS NULL"), walk, "source_code", "state_code")


PUBLISHED_SQL = MOVES_SQL + f""", {MONTHS_SQL}, led AS (SELECT territory, month, CAST(sum(CASE WHEN sign = 1 THEN weight ELSE 0 END) AS BIGINT) AS admissions,
  CAST(sum(CASE WHEN sign = -1 THEN weight ELSE 0 END) AS BIGINT) AS dismissals, CAST(sum(sign * weight) AS BIGINT) AS balance,
  sum(CASE WHEN sign = 1 AND l_linenumber <> 6 AND salary BETWEEN 60 AND 30000 THEN weight END) AS wn, sum(CASE WHEN sign = 1 AND l_linenumber <> 6 AND salary BETWEEN 60 AND 30000 THEN salary * weight END) AS ws
  FROM mov GROUP BY ALL),
dense AS (SELECT n_name AS territory, cal.month, coalesce(admissions, 0) AS admissions, coalesce(dismissals, 0) AS dismissals, coalesce(balance, 0) AS balance,
  CASE WHEN wn >= 5 THEN CAST(ws AS DOUBLE) / CAST(wn AS DOUBLE) END AS admission_salary, CAST(CASE WHEN wn >= 5 THEN wn END AS BIGINT) AS salary_sample
  FROM nation CROSS JOIN cal LEFT JOIN led ON led.territory = n_name AND led.month = cal.month)"""


@query("employment_monthly", f"WITH {PUBLISHED_SQL} SELECT *, {TRAILING_SQL}, {YTD_SQL} FROM dense WINDOW {W_SQL}, {Y_SQL}")
def employment_monthly(spark, d):
    return employment.monthly(_movements(spark, d), territories(spark, d).select("territory"), FIRST_MONTH, LAST_MONTH)


@query("employment_protected_occupations", f"""
WITH {MOVES_SQL}, base AS (SELECT territory, month, CASE WHEN priority = '5-LOW' THEN 'unknown' ELSE '00000' || substr(priority, 1, 1) END AS occupation,
  CAST(sum(CASE WHEN sign = 1 THEN weight ELSE 0 END) AS BIGINT) AS admissions, CAST(sum(CASE WHEN sign = -1 THEN weight ELSE 0 END) AS BIGINT) AS dismissals
  FROM mov GROUP BY ALL),""" + MERGE_SQL.format(k="territory, month", c="occupation"))
def employment_protected(spark, d):
    return employment.protected_breakdown(_movements(spark, d), "occupation")


@query("education_network_series", """
WITH n AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), s AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 7, '0') AS territory, CASE c_custkey % 4 WHEN 0 THEN 'Federal' WHEN 1 THEN 'Estadual' WHEN 2 THEN 'Municipal' ELSE 'Privada' END AS network,
    c_nationkey % 2 = 1 AS rural, k AS total, CASE WHEN c_acctbal <= 9000 THEN CAST(floor(abs(c_acctbal) / 1000) AS BIGINT) END AS classes
  FROM customer JOIN n ON c_custkey = o_custkey WHERE c_acctbal > 0)
SELECT territory, CASE WHEN grouping(network) = 1 THEN 'Total' ELSE network END AS network, count(*) AS active_schools, CAST(sum(total) AS BIGINT) AS total,
  CAST(CASE WHEN count(*) = count(classes) THEN sum(classes) END AS BIGINT) AS classes, CAST(count(CASE WHEN rural THEN 1 END) AS BIGINT) AS schools_rural
FROM s GROUP BY GROUPING SETS ((territory), (territory, network))""")
def education_series(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    c = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    raw = c.select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("CO_ENTIDADE"), F.lpad(F.col("c_nationkey").cast("string"), 7, "0").alias("CO_MUNICIPIO"),
        F.lit("2025").alias("NU_ANO_CENSO"), (F.col("c_custkey") % 4 + 1).cast("string").alias("TP_DEPENDENCIA"), (F.col("c_nationkey") % 2 + 1).cast("string").alias("TP_LOCALIZACAO"),
        F.when(F.col("c_acctbal") > 0, "1").otherwise("2").alias("TP_SITUACAO_FUNCIONAMENTO"), F.col("k").cast("string").alias("QT_MAT_BAS"),
        F.when(F.col("c_acctbal") <= 9000, F.floor(F.abs("c_acctbal") / 1000)).cast("string").alias("QT_TUR_BAS"))
    return education.series(education.schools(raw)).select("territory", "network", "active_schools", "total", "classes", "schools_rural")


@query("health_registry_summary", """
WITH u AS (SELECT n_name AS territory, c_acctbal >= 0 AS active, c_custkey % 4 AS t, c_custkey % 3 AS s, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT territory, count(*) AS registered, CAST(count(CASE WHEN active THEN 1 END) AS BIGINT) AS active, CAST(count(CASE WHEN active AND seg IN ('AUTOMOBILE', 'BUILDING') THEN 1 END) AS BIGINT) AS public,
  CAST(count(CASE WHEN active AND t IN (0, 3) THEN 1 END) AS BIGINT) AS hospitals, CAST(count(CASE WHEN active AND t = 1 THEN 1 END) AS BIGINT) AS urgent, CAST(count(CASE WHEN active AND s = 0 THEN 1 END) AS BIGINT) AS ambulatory,
  CASE WHEN count(CASE WHEN active AND s < 2 THEN 1 END) > 0 THEN CAST(count(CASE WHEN active AND s = 0 THEN 1 END) AS DOUBLE) / count(CASE WHEN active AND s < 2 THEN 1 END) * 100 END AS ambulatory_percent
FROM u GROUP BY 1""")
def health_summary(spark, d):
    k = F.col("c_custkey")
    pick = lambda c, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (c + 1).cast("int"))
    c = table(spark, d, "customer").join(territories(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = c.select(
        F.col("code").alias("CO_IBGE"), F.col("state").alias("CO_UF"), (k + 1).cast("string").alias("CO_CNES"), F.col("c_name").alias("NO_FANTASIA"),
        pick(k % 4, "5", "20.0", "2", "7").alias("TP_UNIDADE"), F.lit("M").alias("TP_GESTAO"),
        mapping.classify(F.col("c_mktsegment"), {"AUTOMOBILE": "1244", "BUILDING": "2011", "FURNITURE": "2038", "HOUSEHOLD": "2062", "MACHINERY": ""}).alias("CO_NATUREZA_JUR"),
        F.when(F.col("c_acctbal") < 0, "03").otherwise("").alias("CO_MOTIVO_DESAB"), pick(k % 3, "SIM", "NAO", "").alias("CO_AMBULATORIAL_SUS"),
        F.lit("1.0").alias("NU_LATITUDE"), F.lit("").alias("NU_LONGITUDE"))
    walk = territories(spark, d).select(F.col("code").alias("source_code"), F.col("state").alias("state_code"), F.col("territory").alias("code"))
    types = param_table(spark, [("05", "Hospital"), ("20", "Pronto"), ("02", "Posto"), ("07", "Especializado")], "code string, label string")
    return health.summary(health.registry(raw, walk, types))


@query("population_age_bands", """
WITH x AS (SELECT r_name AS territory, CAST(year(l_shipdate) AS VARCHAR) AS period, CASE WHEN p_size <= 10 THEN '0-10' WHEN p_size <= 20 THEN '11-20' END AS band, l_linestatus AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT territory, period, band, CAST(count(CASE WHEN s = 'F' THEN 1 END) AS DOUBLE) AS male, CAST(count(CASE WHEN s = 'O' THEN 1 END) AS DOUBLE) AS female, CAST(count(*) AS DOUBLE) AS total, TRUE AS balanced
FROM x WHERE band IS NOT NULL GROUP BY ALL""")
def population_bands(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", F.year("l_shipdate").cast("string").alias("period")).join(
        table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        territories(spark, d).select("n_nationkey", F.col("state").alias("territory")), F.col("s_nationkey") == F.col("n_nationkey"))
    size = F.col("p_size").cast("string")
    counted = rows.groupingSets(
        [[F.col("territory"), F.col("period"), F.col("p_size"), F.col("l_linestatus")], [F.col("territory"), F.col("period"), F.col("p_size")]],
        F.col("territory"), F.col("period"), F.col("p_size"), F.col("l_linestatus")).agg(dbl(F.count(F.lit(1))).alias("value"))
    cells = counted.select("territory", F.lit("93").alias("variable"), "period", F.create_map(F.lit("age"), size, F.lit("sex"), F.coalesce("l_linestatus", F.lit("T"))).alias("dims"), "value")
    bands = param_table(spark, [(str(i), "0-10" if i <= 10 else "11-20") for i in range(1, 21)], "category string, band string")
    return cubes.age_bands(cells, "age", "sex", bands, "F", "O", "T")


def _accounts(spark, d):
    """Yearly accounts per territory in thousands: product, sector values and their shares."""
    o = orders_by_territory(spark, d).groupBy("territory", "year", "segment").agg(F.sum("price").alias("v"))
    wide = o.groupBy("territory", "year").pivot("segment", list(SECTION)).agg(F.first("v"))
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in SECTION), F.lit(0))
    cells = [F.struct(F.lit("37").alias("variable"), F.lit("Mil Reais").alias("unit"), dbl(total).alias("value"))]
    for s in SECTION:
        cells.append(F.struct(F.lit(f"v{s}").alias("variable"), F.lit("Mil Reais").alias("unit"), dbl(s).alias("value")))
        cells.append(F.struct(F.lit(f"s{s}").alias("variable"), F.lit("%").alias("unit"), (dbl(s) / dbl(total) * 100).alias("value")))
    long = wide.select("territory", F.col("year").alias("period"), F.explode(F.array(*cells)).alias("c")).select("territory", "period", "c.*")
    factors = {"Mil Reais": ("R$", 1000)}
    return cubes.base_currency(long, factors)


@query("economy_product_series", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year AS period, CAST(sum(price) AS DOUBLE) * 1000 AS value FROM ord GROUP BY ALL), w AS (SELECT *, lag(value) OVER o AS previous, lag(period) OVER o AS from_period FROM g WINDOW o AS (PARTITION BY territory ORDER BY period))
SELECT territory, period, value, from_period, previous, CASE WHEN previous > 0 THEN (value / previous - 1) * 100 END AS change, coalesce(CAST(period AS INT) - CAST(from_period AS INT) = 1, FALSE) AS annual FROM w""")
def economy_product(spark, d):
    return cubes.product_series(_accounts(spark, d), "37")


@query("economy_leading_sector", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, year AS period, segment AS sector, CAST(sum(price) AS DOUBLE) AS v FROM ord GROUP BY ALL), t AS (SELECT territory, year AS period, CAST(sum(price) AS DOUBLE) AS w FROM ord GROUP BY ALL),
r AS (SELECT territory, period, sector, v / w * 100 AS share, row_number() OVER (PARTITION BY territory, period ORDER BY v / w * 100 DESC, sector) AS k FROM g JOIN t USING (territory, period))
SELECT territory, period, sector, share FROM r WHERE k = 1""")
def economy_leader(spark, d):
    return cubes.leading_sector(cubes.composition(_accounts(spark, d), {s: (f"v{s}", f"s{s}") for s in SECTION}))


@query("agriculture_ranking", """
WITH x AS (SELECT r_name AS territory, p_brand AS product, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 1000 AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(l_shipdate) = 2000 GROUP BY ALL)
SELECT territory, product, value, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY territory ORDER BY value DESC, product) AS position FROM x WHERE product <> 'Brand#9') WHERE position <= 8""")
def agriculture_ranking(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", dec("l_extendedprice").alias("v"), F.year("l_shipdate").cast("string").alias("period")).join(
        table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        territories(spark, d).select("n_nationkey", F.col("state").alias("territory")), F.col("s_nationkey") == F.col("n_nationkey"))
    cells = rows.groupBy("territory", "p_brand", "period").agg(dbl(F.sum("v")).alias("value")).select(
        "territory", F.lit("215").alias("variable"), "period", F.create_map(F.lit("81"), F.col("p_brand")).alias("dims"), F.lit("Mil Reais").alias("unit"), "value", F.lit("real").alias("status"))
    factors = {"Mil Reais": ("R$", 1000)}
    names = param_table(spark, [(f"Brand#{i}", f"Brand#{i}") for i in range(1, 26)], "product string, name string")
    products = cubes.products(cells, "81", {"215": "value"}, factors)
    return cubes.ranked(products, names, "value", "2000", ["Brand#9"], 8).select("territory", "product", "value", "position")


@query("social_income_bands", f"""
WITH {ORDERS_SQL}, m AS (SELECT code AS territory, month, count(*) AS families, count(CASE WHEN priority = '1-URGENT' THEN 1 END) AS a, count(CASE WHEN priority = '2-HIGH' THEN 1 END) AS b, count(CASE WHEN priority > '3' THEN 1 END) AS c FROM ord GROUP BY ALL),
r AS (SELECT territory, max(month) AS reference FROM m GROUP BY 1),
k AS (SELECT m.*, CAST(substr(reference, 1, 4) AS INT) * 12 + CAST(substr(reference, 5, 2) AS INT) - CAST(substr(month, 1, 4) AS INT) * 12 - CAST(substr(month, 5, 2) AS INT) AS age, (a BETWEEN 1 AND 4) OR (b BETWEEN 1 AND 4) OR (c BETWEEN 1 AND 4) AS hit FROM m JOIN r USING (territory)),
l AS (SELECT month, 'families' AS measure, CASE WHEN families NOT BETWEEN 1 AND 4 THEN families END AS value FROM k WHERE age < 24
  UNION ALL SELECT month, 'povertyFamilies', CASE WHEN NOT hit THEN a END FROM k WHERE age < 24 UNION ALL SELECT month, 'lowIncomeFamilies', CASE WHEN NOT hit THEN b END FROM k WHERE age < 24
  UNION ALL SELECT month, 'aboveHalfFamilies', CASE WHEN NOT hit THEN c END FROM k WHERE age < 24)
SELECT month, measure, CASE WHEN value IS NULL THEN 'suppressed' ELSE 'real' END AS status, count(*) AS cells, CAST(sum(value) AS DOUBLE) AS total FROM l GROUP BY ALL""")
def social_income(spark, d):
    p = F.col("priority")
    text = lambda c: c.cast("string")
    fields = {k: social.REGISTRY[k] for k in ("families", "povertyFamilies", "lowIncomeFamilies", "aboveHalfFamilies")}
    raw = orders_by_territory(spark, d).groupBy(F.col("code").alias("codigo_ibge"), F.col("month").alias("anomes_s")).agg(
        text(F.count(F.lit(1))).alias(fields["families"]), text(F.count_if(p == "1-URGENT")).alias(fields["povertyFamilies"]),
        text(F.count_if(p == "2-HIGH")).alias(fields["lowIncomeFamilies"]), text(F.count_if(p > "3")).alias(fields["aboveHalfFamilies"]))
    shown = social.protect_income(social.block(raw, fields, earliest="199501"))
    return shown.groupBy("month", "measure", "status").agg(F.count(F.lit(1)).alias("cells"), dbl(F.sum("value")).alias("total"))


@query("environment_fire_years", """
WITH e AS (SELECT event_type AS territory, strftime(ts, '%Y%m') AS month FROM events), c AS (SELECT territory, count(*) AS n FROM e GROUP BY 1), t AS (SELECT DISTINCT territory FROM e)
SELECT territory, y AS year, CAST(CASE WHEN y = '2024' THEN n ELSE 0 END AS BIGINT) AS count, CAST(CASE WHEN y = '2024' THEN 1 ELSE 12 END AS BIGINT) AS coverage_months, y = '2023' AS complete,
  CAST(CASE WHEN y = '2024' THEN n ELSE 0 END AS DOUBLE) / 500 * 1000 AS per_1000_km2 FROM t JOIN c USING (territory), (SELECT unnest(['2023', '2024']) AS y)""")
def environment_fires(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("territory"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("observed_at"))
    obs = e.withColumn("reference", F.lit("202401")).unionByName(e.filter("territory = 'error'").withColumn("reference", F.lit("202401")))
    covered = environment.coverage(obs.select("reference").distinct().unionByName(param_table(spark, [("2023",)], "reference string")))
    terr = e.select("territory").distinct()
    months = environment.fire_months(environment.detections(obs).filter("NOT conflict"), covered, terr, "202301", "202412")
    return environment.fire_years(months, terr.withColumn("km2", F.lit(500.0)), "2024")


@query("environment_land_history", """
WITH x AS (SELECT r_name AS territory, CAST(year(l_shipdate) AS VARCHAR) AS year, p_size AS c, sum(CAST(l_quantity AS DECIMAL(18,2))) AS ha
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT territory, year, CAST(sum(CASE WHEN c IN (3, 4, 5, 6, 7, 49, 11, 12, 50) THEN ha ELSE 0 END) AS DOUBLE) AS native, CAST(sum(CASE WHEN c <= 8 THEN ha ELSE 0 END) AS DOUBLE) AS forest,
  CAST(sum(CASE WHEN c BETWEEN 9 AND 30 THEN ha ELSE 0 END) AS DOUBLE) AS farming, CAST(sum(CASE WHEN c BETWEEN 10 AND 30 THEN ha ELSE 0 END) AS DOUBLE) AS farming_without_plantation,
  CAST(sum(CASE WHEN c BETWEEN 16 AND 30 THEN ha ELSE 0 END) AS DOUBLE) AS agriculture FROM x GROUP BY ALL""")
def environment_land(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", dec("l_quantity").alias("ha"), F.concat(F.lit("y"), F.year("l_shipdate")).alias("y")).join(
        table(spark, d, "part").select("p_partkey", F.col("p_size").alias("class")), F.col("l_partkey") == F.col("p_partkey")).join(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        territories(spark, d).select("n_nationkey", "territory", "state"), F.col("s_nationkey") == F.col("n_nationkey"))
    # nations play the sub-areas (biomes) of their region
    wide = rows.groupBy(F.col("state").alias("territory"), F.col("territory").alias("biome"), "class").pivot("y", [f"y{y}" for y in YEARS]).agg(F.sum("ha"))
    stem = lambda i: "1." if i <= 8 else "3.3." if i == 9 else "3.1." if i <= 15 else "3.2." if i <= 30 else "4."
    legend = param_table(spark, [(i, f"{stem(i)}{i}.", f"Class {i}") for i in range(1, 51)], "class int, path string, label string")
    area = territories(spark, d).select(F.col("state").alias("territory"), F.lit(1.0).alias("km2")).distinct()
    h = environment.land_history(environment.land_cover(wide, legend, area))
    return h.select("territory", "year", *[dbl(c).alias(c) for c in ("native", "forest", "farming", "farming_without_plantation", "agriculture")])


def _stock_file(spark, d):
    """Customers as stock records in the layout of an edition: 62 columns, comma, Windows code page."""
    k = F.col("c_custkey")
    filled = {
        "Município - Código": F.lpad(F.col("c_nationkey").cast("string"), 6, "0"), "Ind Vínculo Ativo 31/12 - Código": F.when(k % 10 == 0, "0").otherwise("1"),
        "Ind Vínculo Abandonado - Código": F.when(k % 7 == 0, "1").otherwise("0"), "Vl Rem Dezembro Nom": F.translate(F.greatest(dec("c_acctbal"), F.lit(0).cast("decimal(18,2)")).cast("string"), ".", ","),
        "CNAE 2.0 Classe - Código": F.element_at(F.array(*[F.lit(x) for x in ("02113", "10112", "41204", "46818", "60101")]), (k % 5 + 1).cast("int"))}
    layout = employment.STOCK_LAYOUTS["2025"]
    path = scratch_path(spark, "stock")
    c = table(spark, d, "customer").select(*[filled.get(n, F.lit("")).alias(n) for n in layout.columns])
    write_contract(c, path, layout)
    return path


STOCK_SQL = """s AS (SELECT n_name AS territory, CASE c_custkey % 5 WHEN 0 THEN 'agriculture' WHEN 1 THEN 'industry' WHEN 2 THEN 'construction' WHEN 3 THEN 'commerce' ELSE 'services' END AS sector,
  greatest(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS wage FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0 AND c_custkey % 7 <> 0)"""


def _stock(spark, d):
    walk = territories(spark, d).select(F.substring("code", 2, 6).alias("source_code"), "territory")
    return employment.stock_records(employment.read_stock(spark, _stock_file(spark, d), "2025")).join(walk, "source_code")


@query("employment_stock_edition", f"""
WITH {STOCK_SQL} SELECT territory, coalesce(sector, 'total') AS sector, count(*) AS stock, CAST(CASE WHEN count(CASE WHEN wage > 0 THEN 1 END) >= 5 THEN count(CASE WHEN wage > 0 THEN 1 END) END AS BIGINT) AS sample,
  CASE WHEN count(CASE WHEN wage > 0 THEN 1 END) >= 5 THEN round(CAST(sum(wage) AS DOUBLE) / count(CASE WHEN wage > 0 THEN 1 END), 4) END AS mean
FROM s GROUP BY territory, ROLLUP (sector)""")
def employment_stock(spark, d):
    """Stock microdata of an edition: layout by edition, typed, refused where a record has a problem, then stock and mean."""
    records = materialize(_stock(spark, d), "stock")
    quality.require(quality.violations(records.filter("problem IS NOT NULL"), "record", ["source_code"], F.col("problem")))
    out = employment.stock_remuneration(records, "active", "abandoned", F.col("division"), F.col("wage"))
    # rounded on the binary value as the SQL does, not on its shortest decimal writing (4411.20775 is below the half)
    return out.select("territory", F.lower("sector").alias("sector"), "stock", "sample", (F.round(F.col("mean") * 10000) / 10000).alias("mean"))


@query("employment_stock_control", f"""
WITH {STOCK_SQL}, c AS (SELECT territory, sector, count(*) AS n FROM s GROUP BY ALL)
SELECT 'stock' AS gate, territory || '|' || sector AS key, 'mismatch ' || n || ' ' || (n + 1) AS detail FROM c WHERE n % 3 = 0""")
def employment_stock_control(spark, d):
    """Every sector's stock by records against a published table in which each third figure is one too high."""
    records = _stock(spark, d)
    kept = records.filter("active = '1' AND abandoned = '0'").withColumn("sector", mapping.classify_range(F.col("division"), employment.DIVISION_SECTOR))
    computed = materialize(kept.groupBy("territory", "sector").agg(F.count(F.lit(1)).alias("stock")), "stock")
    return employment.stock_disagreements(computed, computed.withColumn("stock", F.col("stock") + (F.col("stock") % 3 == 0).cast("int")))


def _units(spark, d):
    """Customers as answers: two share an identifier, some have none, some give another state or only six digits."""
    k, code = F.col("c_custkey"), F.lpad(F.col("c_nationkey").cast("string"), 7, "0")
    answers = table(spark, d, "customer").select(
        F.when(k % 40 == 11, "").otherwise(code).alias("ibge7"), F.substring(code, 1, 6).alias("ibge"), F.when(k % 50 == 7, "XX").otherwise("PR").alias("uf"),
        F.when(k % 6 == 0, "").otherwise(F.floor(k / 2).cast("string")).alias("nu_identificador"), F.col("c_name").alias("q0_1"), F.col("c_mktsegment").alias("q0_2"),
        F.lit(" ").alias("q0_3"), F.lit(None).cast("string").alias("q0_4"), F.col("c_nationkey").cast("string").alias("q0_6"), F.when(k % 4 == 1, "Sim").otherwise("Não").alias("q12_13"))
    places = territories(spark, d).select(F.col("code").alias("territory"), F.array(F.lit("PR"), F.lit("Paraná")).alias("states"))
    return social.institutional_units(answers.unionByName(answers), places, "cras", "2025")


UNITS_SQL = """u AS (SELECT CASE WHEN c_custkey % 40 = 11 THEN '' ELSE lpad(CAST(c_nationkey AS VARCHAR), 7, '0') END AS territory, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE CAST(c_custkey // 2 AS VARCHAR) END AS unit,
  c_name AS name, c_mktsegment || ', ' || c_nationkey AS address, c_custkey % 4 = 1 AS offers,
  CASE WHEN c_custkey % 40 = 11 THEN 'no confirmed code' WHEN c_custkey % 50 = 7 THEN 'codes or state disagree' WHEN c_custkey % 6 = 0 THEN 'no identifier' END AS problem FROM customer),
v AS (SELECT *, count(*) OVER (PARTITION BY territory, unit) AS variants,
  row_number() OVER (PARTITION BY territory, unit ORDER BY name, address, offers, problem NULLS FIRST) AS pos FROM u),
one AS (SELECT territory, unit, name, address, offers, coalesce(problem, CASE WHEN variants > 1 THEN 'differing answers' END) AS problem FROM v WHERE pos = 1)"""


@query("social_institutional_units", f"WITH {UNITS_SQL} SELECT territory, unit, name, address, CASE WHEN offers THEN 'PAIF' ELSE '' END AS services FROM one WHERE problem IS NULL")
def social_units(spark, d):
    return _units(spark, d).filter("problem IS NULL").select("territory", "unit", "name", "address", F.array_join("services", "|").alias("services"))


@query("social_unit_violations", f"WITH {UNITS_SQL} SELECT 'unit' AS gate, territory || '|' || unit AS key, problem AS detail FROM one WHERE problem IS NOT NULL")
def social_unit_violations(spark, d):
    return social.unit_violations(_units(spark, d))


def _movement_files(spark, d):
    """The movement publication as files: one layout a kind, one folder a publication month."""
    texts, paths = materialize(_movement_texts(spark, d), "movement-texts"), {}
    for kind, layout in employment.LAYOUTS.items():
        paths[kind] = scratch_path(spark, kind)
        # rows meet by file before they are widened; fields without a value are empty, not quoted
        own = texts.filter(F.col("kind") == kind).select("publication", *[c for c in layout.columns if c in texts.columns]).repartition("publication")
        rows = own.select("publication", *[(F.col(c) if c in own.columns else F.lit(None).cast("string")).alias(c) for c in layout.columns])
        rows.write.partitionBy("publication").option("header", "true").option("sep", layout.sep).csv(paths[kind])
    return paths


@query("employment_refresh", f"""
WITH {MOVES_SQL}, {MONTHS_SQL}, pub AS (SELECT *, CASE WHEN kind = 'MOV' THEN month ELSE declared END AS publication FROM mov),
cur AS (SELECT territory, month, CAST(sum(CASE WHEN sign = 1 THEN weight ELSE 0 END) AS BIGINT) AS admissions, CAST(sum(CASE WHEN sign = -1 THEN weight ELSE 0 END) AS BIGINT) AS dismissals FROM pub GROUP BY ALL),
prev AS (SELECT territory, month, CAST(sum(CASE WHEN sign = 1 THEN weight ELSE 0 END) AS BIGINT) AS admissions, CAST(sum(CASE WHEN sign = -1 THEN weight ELSE 0 END) AS BIGINT) AS dismissals FROM pub WHERE publication <= '199706' GROUP BY ALL),
g AS (SELECT n_name AS territory, cal.month, coalesce(cur.admissions, 0) AS admissions, coalesce(cur.dismissals, 0) AS dismissals, coalesce(prev.admissions, 0) AS previous_admissions, coalesce(prev.dismissals, 0) AS previous_dismissals
  FROM nation CROSS JOIN cal LEFT JOIN cur ON cur.territory = n_name AND cur.month = cal.month LEFT JOIN prev ON prev.territory = n_name AND prev.month = cal.month)
SELECT *, '2' AS detected_at, 'FOR 1|MOV 1' AS dates FROM g WHERE admissions <> previous_admissions OR dismissals <> previous_dismissals""")
def employment_refresh(spark, d):
    """A whole module, three times: what was known in 1997, all of it, and a version whose gate refuses every table.

    Contracted scan, typed records, gates, stage, publish together, revision log, kept dates.
    """
    acts = param_table(spark, [(f"{i:07}", f"Activity {i}") for i in range(1, 7)], "code string, label string")
    jobs = param_table(spark, [(f"{i:06}", f"Job {i}") for i in range(1, 5)], "code string, label string")
    wages = param_table(spark, [(y, 200.0) for y in YEARS], "year string, minimum double")
    raw = employment.read_movements(spark, _movement_files(spark, d), r"publication=(\d{6})/")
    typed = employment.movements(raw, acts, jobs, wages)
    # records are read once: gates and every version are sums over these keys
    ledger = materialize(employment.additive_ledger(typed, ["source_code", "state_code", "kind", "publication", "month", "sector", "problem"]), "movements")
    quality.require(quality.violations(ledger.filter("problem IS NOT NULL"), "record", ["kind", "publication"], F.col("problem")))
    walk = territories(spark, d).select(F.col("code").alias("source_code"), F.col("state").alias("state_code"), F.col("territory").alias("code"))
    here = mapping.in_territory(ledger, walk, "source_code", "state_code")
    root, places = scratch_path(spark, "employment"), territories(spark, d).select("territory")
    series = {"monthly": (["territory", "month"], ["admissions", "dismissals"])}

    def gates(t):
        return [quality.unique_keys(t["monthly"], ["territory", "month"]), quality.volume_floor(t["monthly"], 1), quality.unique_keys(t["sectors"], ["territory", "month", "sector"])]

    for version, cutoff in (("1", "199706"), ("2", "999999"), ("3", "999999")):
        known = refresh.as_of(here, "publication", cutoff)
        monthly = employment.monthly(known, places, FIRST_MONTH, LAST_MONTH, additive=True)
        tables = {"monthly": monthly if version != "3" else monthly.unionByName(monthly), "sectors": employment.sector_series(known, places, FIRST_MONTH, LAST_MONTH, additive=True)}
        sources = param_table(spark, [("MOV", "a", "1"), ("FOR", "a", "1")], "source string, url string, hash string")
        try:
            refresh.refresh_group(spark, root, version, tables, gates, series, sources, ["source", "url", "hash"], F.lit(version))
        except quality.GateFailure:
            pass
    now = refresh.published_group(spark, root)
    dates = now["sources"].agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "source", "collected_at"))), "|").alias("dates"))
    return now["revisions_monthly"].select("territory", "month", "admissions", "dismissals", "previous_admissions", "previous_dismissals", "detected_at", F.lit(dates.first()[0]).alias("dates"))
