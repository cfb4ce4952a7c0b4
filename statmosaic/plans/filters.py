"""B: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, text
from ..operators import mapping, sets
from ..session import param_table, scratch_path
from ..sources import delimited
from .base import MONTHS_SQL, MOVES_SQL, ORDERS_SQL, PRIORITIES, SEGMENTS, YEARLY_SQL, YEARS, dbl, dec, movements, orders_by_territory, table, territories, yearly_prices
from .registry import query

RAW_SQL = """CASE WHEN l_linenumber = 1 THEN '-' WHEN l_linenumber = 2 THEN 'X' WHEN l_linenumber = 3 THEN '..'
  WHEN l_linenumber = 4 THEN '...' WHEN l_returnflag = 'R' THEN 'NaN' ELSE 'n' END"""


def _raw():
    n = F.col("l_linenumber")
    return (F.when(n == 1, "-").when(n == 2, "X").when(n == 3, "..").when(n == 4, "...")
            .when(F.col("l_returnflag") == "R", "NaN").otherwise(dec("l_quantity").cast("string")))


@query("b01_symbol_decode", f"""
WITH r AS (SELECT {RAW_SQL} AS raw, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem)
SELECT CASE raw WHEN '-' THEN 'real' WHEN 'X' THEN 'suppressed' WHEN '..' THEN 'notApplicable' WHEN '...' THEN 'unavailable'
  WHEN 'NaN' THEN 'invalid' ELSE 'real' END AS status, CASE WHEN raw IN ('-','X','..','...') THEN raw END AS raw,
  count(*) AS n, CAST(sum(CASE raw WHEN '-' THEN 0 WHEN 'n' THEN q END) AS DOUBLE) AS total FROM r GROUP BY 1, 2""")
def b01(spark, d):
    cell = cells.decode_symbol(_raw(), type_="decimal(18,2)")
    return table(spark, d, "lineitem").select(cell.alias("c")).groupBy(F.col("c.status").alias("status"), F.col("c.raw").alias("raw")).agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum("c.value")).alias("total"))


@query("b02_number_rules", """
WITH r AS (SELECT CASE WHEN l_linenumber = 1 THEN 'ND' WHEN l_linenumber = 2 THEN 'x1' WHEN l_linenumber = 3 THEN 'neg' ELSE 'n' END AS kind,
  CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_discount * 10 AS DECIMAL(18,2)) AS dd FROM lineitem),
v AS (SELECT kind, q + dd AS x FROM r),
e AS (SELECT kind, x, CASE WHEN kind = 'x1' THEN 'not a number' WHEN kind = 'neg' AND x > 0 THEN 'negative' WHEN kind = 'n' AND x > 45 THEN 'above limit'
  WHEN kind = 'n' AND x <> floor(x) THEN 'not whole' END AS error FROM v)
SELECT error, count(*) AS n, CAST(sum(CASE WHEN kind = 'n' AND error IS NULL THEN x END) AS BIGINT) AS total FROM e GROUP BY 1""")
def b02(spark, d):
    x = (dec("l_quantity") + dec(F.col("l_discount") * 10)).cast("decimal(18,2)")
    comma = F.translate(x.cast("string"), ".", ",")
    n = F.col("l_linenumber")
    raw = F.when(n == 1, "ND").when(n == 2, F.concat(F.lit("x"), comma)).when(n == 3, F.concat(F.lit("-"), comma)).otherwise(comma)
    rows = cells.with_number(table(spark, d, "lineitem").select(raw.alias("raw")), "raw", missing=["-", "ND"], comma=True, upper=45.0, whole=True)
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("bigint").alias("total"))


CODED_SQL = """coded AS (
  SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 7, '0') AS code, CASE WHEN c_acctbal < 0 THEN 'OTHER' ELSE r_name END AS state, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _coded(spark, d):
    t = territories(spark, d)
    return table(spark, d, "customer").join(t, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "code", "territory", F.when(F.col("c_acctbal") < 0, "OTHER").otherwise(F.col("state")).alias("state"))


def _walk(spark, d):
    return territories(spark, d).select(F.col("code").alias("source_code"), F.col("state").alias("state_code"), "code")


@query("b03_territory_filter", f"""
WITH {CODED_SQL} SELECT code AS territory, CAST(count(CASE WHEN state = r_name THEN 1 END) AS BIGINT) AS kept,
  CAST(count(CASE WHEN state <> r_name THEN 1 END) AS BIGINT) AS mismatched FROM coded GROUP BY 1""")
def b03(spark, d):
    rows = _coded(spark, d).drop("territory")
    return mapping.located(rows, _walk(spark, d), "code", "state").groupBy("territory").agg(
        F.count_if("state_ok").alias("kept"), F.count_if(~F.col("state_ok")).alias("mismatched"))


@query("b04_name_filter", f"""
WITH {CODED_SQL} SELECT code AS territory, count(*) AS n FROM coded WHERE state = r_name GROUP BY 1""")
def b04(spark, d):
    rows = _coded(spark, d).select("c_custkey", F.concat(F.lit(" "), F.replace(F.lower("territory"), F.lit("nation"), F.lit("nâtiön"))).alias("name"),
                                   F.lower("state").alias("state"))
    named = territories(spark, d).select("code", F.col("territory").alias("name"), "state")
    return mapping.in_named_territory(rows, named, "name", "state").groupBy("territory").agg(F.count(F.lit(1)).alias("n"))


@query("b05_field_allow_list", """
SELECT l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1""")
def b05(spark, d):
    return mapping.allow_fields(table(spark, d, "lineitem"), ["l_linestatus", "l_quantity"]).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum(dec("l_quantity"))).alias("quantity"))


@query("b06_one_cell", """
WITH g AS (SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 END) AS k,
  count(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice < 300000 THEN 1 END) AS f FROM orders GROUP BY 1)
SELECT CASE WHEN k = 0 THEN 'missing' WHEN k > 1 THEN 'repeated' WHEN f = 0 THEN 'no value' END AS problem, count(*) AS customers, CAST(sum(k) AS BIGINT) AS found FROM g GROUP BY 1""")
def b06(spark, d):
    frame = table(spark, d, "orders").select(
        "o_custkey", F.col("o_orderstatus").alias("variable"), F.lit("all").alias("period"),
        F.create_map(F.lit("p"), F.col("o_orderpriority")).alias("dims"),
        F.when(F.col("o_totalprice") < 300000, dec("o_totalprice")).alias("value"))
    return mapping.one_cell(frame, "F", "all", {"p": "1-URGENT"}, ["o_custkey"]).groupBy("problem").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("found").alias("found"))


@query("b07_unit_resolution", f"""
WITH {MOVES_SQL},
u AS (SELECT year, p_brand, p_size, CASE p_type WHEN 'STANDARD' THEN 'Vide categorias' WHEN 'PROMO' THEN 'Mil Reais [1996 a 1999]' ELSE p_type END AS pub, p_type
  FROM mov JOIN part ON l_partkey = p_partkey)
SELECT CASE WHEN p_size = 1 THEN 'Toneladas' WHEN p_type = 'STANDARD' THEN CASE WHEN p_size > 40 THEN 'Não aplicável' ELSE p_brand END
   WHEN p_type = 'PROMO' THEN CASE WHEN year BETWEEN '1996' AND '1999' THEN 'Mil Reais' END ELSE p_type END AS unit,
  CASE WHEN p_type = 'PROMO' AND year NOT BETWEEN '1996' AND '1999' THEN 'period outside currency interval' END AS error, count(*) AS n
FROM u GROUP BY 1, 2""")
def b07(spark, d):
    p = table(spark, d, "part")
    published = F.when(F.col("p_type") == "STANDARD", "Vide categorias").when(F.col("p_type") == "PROMO", "Mil Reais [1996 a 1999]").otherwise(F.col("p_type"))
    got = cells.resolve_unit(published, F.when(F.col("p_size") <= 40, F.col("p_brand")), F.when(F.col("p_size") == 1, "Toneladas"),
                             F.col("year"), "Mil Reais", "Mil Reais")
    return movements(spark, d).join(p, F.col("l_partkey") == F.col("p_partkey")).select(got.alias("u")).groupBy(
        F.col("u.unit").alias("unit"), F.col("u.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("b08_unit_scaling", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'R$' ELSE o_orderstatus END AS unit, CASE WHEN o_orderstatus = 'F' THEN 'Mil Reais' ELSE o_orderstatus END AS original_unit,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE 1 END) AS DOUBLE) AS total FROM orders GROUP BY 1, 2""")
def b08(spark, d):
    factors = {"Mil Reais": ("R$", 1000), "Mil litros": ("litros", 1000)}
    rows = table(spark, d, "orders").select(dec("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", "Mil Reais").otherwise(F.col("o_orderstatus")).alias("unit"))
    return cells.scale_units(rows, factors).groupBy("unit", "original_unit").agg(dbl(F.sum("value")).alias("total"))


@query("b09_provenance", f"""
WITH {YEARLY_SQL} SELECT territory, year, CAST(price AS DOUBLE) AS value, 'R$' AS unit, state AS source_id, 'Agency of ' || state AS agency FROM yr""")
def b09(spark, d):
    sources = territories(spark, d).select(F.col("state").alias("source_id"), F.concat(F.lit("Agency of "), "state").alias("agency")).distinct()
    rows = yearly_prices(spark, d).select("territory", "year", dbl("price").alias("value"), F.lit("R$").alias("unit"), F.col("state").alias("source_id"))
    return mapping.with_provenance(rows, sources)


@query("b10_derived_cell", f"""
WITH {YEARLY_SQL} SELECT territory, year, CASE WHEN n >= 90 THEN CAST(price AS DOUBLE) / n END AS value, CASE WHEN n >= 90 THEN 'derived' ELSE 'unavailable' END AS status,
 '{{"n":' || n || '}}' AS inputs, CASE WHEN n < 90 THEN 'too few orders' END AS reason FROM yr""")
def b10(spark, d):
    y = yearly_prices(spark, d)
    cell = cells.derived_cell(F.when(F.col("n") >= 90, dbl("price") / F.col("n")), "R$", "price / orders", {"n": F.col("n")}, "too few orders")
    return y.select("territory", "year", cell.alias("c")).select("territory", "year", "c.value", "c.status", "c.inputs", "c.reason")


@query("b11_unavailable_rows", f"""
WITH {ORDERS_SQL}, seen AS (SELECT DISTINCT territory, month, segment FROM ord), {MONTHS_SQL},
t AS (SELECT n_name AS territory, month, segment FROM nation, cal, (SELECT DISTINCT c_mktsegment AS segment FROM customer))
SELECT territory, month, segment, 'Orders' AS title, CAST(NULL AS DOUBLE) AS value, 'unavailable' AS status, 'not published' AS reason
FROM t ANTI JOIN seen USING (territory, month, segment)""")
def b11(spark, d):
    months = [f"{y}{m:02}" for y in YEARS for m in range(1, 13)]
    expected = sets.expected_cells(territories(spark, d).select("territory"), {"month": months, "segment": SEGMENTS})
    seen = orders_by_territory(spark, d).select("territory", "month", "segment")
    return mapping.unavailable_rows(expected.join(seen, ["territory", "month", "segment"], "left_anti"), "Orders", "not published")


@query("b12_presence", f"""
WITH {MOVES_SQL}, s AS (SELECT territory, p_brand, year, sum(CASE WHEN weight = 1 AND sign = 1 THEN quantity ELSE 0 END) AS v, count(*) AS n
  FROM mov JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT *, n < 5 AS sup FROM s)
SELECT p_brand, CAST(count(CASE WHEN ever THEN 1 END) AS BIGINT) AS ever_present, CAST(count(CASE WHEN late THEN 1 END) AS BIGINT) AS present_latest FROM (
 SELECT territory, p_brand, bool_or(coalesce(CASE WHEN NOT sup THEN v END > 0, FALSE) OR sup) AS ever,
   bool_or((coalesce(CASE WHEN NOT sup THEN v END > 0, FALSE) OR sup) AND year = '2001') AS late FROM c GROUP BY ALL) GROUP BY 1""")
def b12(spark, d):
    counted = (F.col("weight") == 1) & (F.col("sign") == 1)
    s = movements(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("territory", "p_brand", "year").agg(
        F.sum(F.when(counted, F.col("quantity")).otherwise(0)).alias("v"), F.count(F.lit(1)).alias("n"))
    c = s.select("territory", "p_brand", "year", F.when(F.col("n") >= 5, F.col("v")).alias("value"), F.when(F.col("n") < 5, "suppressed").otherwise("real").alias("status"))
    return mapping.presence(c, ["territory", "p_brand"], "year", "value", "status", F.lit("2001")).groupBy("p_brand").agg(
        F.count_if("ever_present").alias("ever_present"), F.count_if("present_latest").alias("present_latest"))


@query("b13_code_classes", """
SELECT CASE WHEN p_size BETWEEN 1 AND 3 THEN 'agriculture' WHEN p_size BETWEEN 5 AND 39 THEN 'industry' WHEN p_size BETWEEN 41 AND 43 THEN 'construction' END AS sector,
  CASE WHEN p_brand = 'Brand#2' THEN 'exact' WHEN starts_with(p_brand, 'Brand#2') THEN 'twenties' WHEN starts_with(p_brand, 'Brand#1') THEN 'tens' ELSE 'other' END AS owner,
  count(*) AS n FROM part GROUP BY 1, 2""")
def b13(spark, d):
    return table(spark, d, "part").select(
        mapping.classify_range(F.col("p_size"), [(1, 3, "agriculture"), (5, 39, "industry"), (41, 43, "construction")]).alias("sector"),
        mapping.classify(F.col("p_brand"), {"Brand#2": "exact"}, [("Brand#2", "twenties"), ("Brand#1", "tens")], "other").alias("owner"),
    ).groupBy("sector", "owner").agg(F.count(F.lit(1)).alias("n"))


# records come damaged on purpose: a field is missing or unreadable where the order's number says so
@query("b14_movement_rules", f"""
WITH {MOVES_SQL}, m AS (SELECT CASE l_orderkey % 97 WHEN 0 THEN NULL WHEN 1 THEN 'XXX' ELSE kind END AS kind, l_linenumber AS ln,
  CASE WHEN l_orderkey % 97 = 2 THEN NULL WHEN l_orderkey % 97 = 3 THEN '202413' ELSE month END AS month, CASE WHEN l_orderkey % 97 = 4 THEN NULL ELSE declared END AS declared,
  declared AS publication, CASE WHEN l_orderkey % 97 = 5 THEN NULL WHEN kind = 'MOV' THEN '0' WHEN l_linenumber <= 5 THEN '1' ELSE '0' END AS late,
  CASE WHEN l_orderkey % 97 = 6 THEN NULL WHEN l_linenumber = 1 THEN '1' ELSE '0' END AS excluded, CASE WHEN l_orderkey % 97 = 7 THEN NULL ELSE sign END AS sign,
  CASE WHEN l_orderkey % 97 = 8 THEN NULL ELSE l_linenumber END AS type FROM mov)
SELECT kind, CASE WHEN kind IS NULL OR kind = 'XXX' THEN 'unknown file kind' WHEN month IS NULL OR month = '202413' THEN 'unreadable month'
  WHEN kind = 'EXC' AND (excluded IS NULL OR excluded <> '1') THEN 'wrong exclusion month' WHEN kind <> 'EXC' AND declared IS NULL THEN 'wrong declaration month'
  WHEN kind = 'MOV' AND (month <> publication OR late IS NULL) THEN 'not on time' WHEN kind = 'FOR' AND (late IS NULL OR late <> '1') THEN 'not flagged late'
  WHEN sign IS NULL THEN 'unknown sign' WHEN type IS NULL OR type = 7 THEN 'unknown movement type' WHEN (sign = 1) <> (type NOT IN (2, 4)) THEN 'sign against movement type' END AS problem, count(*) AS n
FROM m GROUP BY 1, 2""")
def b14(spark, d):
    ln, lost = F.col("l_linenumber"), F.col("l_orderkey") % 97
    gone = lambda k, c: F.when(lost == k, None).otherwise(c)
    kind = F.when(lost == 1, "XXX").otherwise(gone(0, F.col("kind")))
    problem = mapping.movement_problem(
        kind, F.when(lost == 3, "202413").otherwise(gone(2, F.col("month"))), gone(4, F.col("declared")), F.col("declared"),
        gone(5, F.when(F.col("kind") == "MOV", "0").when(ln <= 5, "1").otherwise("0")), gone(6, F.when(ln == 1, "1").otherwise("0")),
        gone(7, F.col("sign")), gone(8, F.lpad(ln.cast("string"), 2, "0")), F.col("declared"), ["01", "03", "05", "06"], ["02", "04"])
    return movements(spark, d).select(kind.alias("kind"), problem.alias("problem")).groupBy("kind", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("b15_wage_eligibility", f"""
WITH {MOVES_SQL}, w(year, minimum) AS (VALUES ('1996', 1000.00), ('1997', 1100.00), ('1998', 120.00))
SELECT mov.year, coalesce(sign = 1 AND l_linenumber <> 7 AND salary BETWEEN minimum * 0.3 AND minimum * 50, FALSE) AS wage_eligible, count(*) AS n,
  CAST(sum(salary) AS DOUBLE) AS total FROM mov LEFT JOIN w ON mov.year = w.year GROUP BY 1, 2""")
def b15(spark, d):
    minimum = param_table(spark, [("1996", 1000.0), ("1997", 1100.0), ("1998", 120.0)], "year string, minimum double")
    rows = mapping.wage_eligible(movements(spark, d), minimum, "year", F.col("salary"), F.col("sign") == 1, F.col("l_linenumber") == 7, 0.3, 50.0)
    return rows.groupBy("year", "wage_eligible").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum("salary")).alias("total"))


@query("b16_active_stock", f"""
WITH {MOVES_SQL} SELECT territory, count(*) AS stock FROM mov WHERE l_linestatus = 'F' AND l_linenumber <> 1 GROUP BY 1""")
def b16(spark, d):
    bit = lambda c: F.when(c, "1").otherwise("0")
    return movements(spark, d).filter(mapping.active_stock(bit(F.col("l_linestatus") == "F"), bit(F.col("l_linenumber") == 1))).groupBy(
        "territory").agg(F.count(F.lit(1)).alias("stock"))


@query("b17_universe", f"""
WITH {ORDERS_SQL} SELECT territory, CAST(count(CASE WHEN status_code = 'F' AND priority <> '5-LOW' THEN 1 END) AS BIGINT) AS in_universe,
 CAST(count(CASE WHEN status_code = 'F' AND priority = '5-LOW' AND price > 300000 THEN 1 END) AS BIGINT) AS problems FROM ord GROUP BY 1""")
def b17(spark, d):
    active, measure = F.col("status_code") == "F", F.when(F.col("priority") != "5-LOW", F.col("price"))
    return orders_by_territory(spark, d).groupBy("territory").agg(
        F.count_if(mapping.universe(active, measure)).alias("in_universe"),
        F.count(mapping.universe_problem(active, measure, F.col("price") > 300000)).alias("problems"))


@query("b18_tristate", """
WITH l AS (SELECT lang, quality = 1 AS q, CASE WHEN toxic = 1 THEN TRUE WHEN source < 'src5' THEN FALSE END AS t FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT lang, q OR t AS a FROM l)
SELECT lang, CAST(count(CASE WHEN a THEN 1 END) AS BIGINT) AS yes, CAST(count(CASE WHEN NOT a THEN 1 END) AS BIGINT) AS no,
 CAST(count(CASE WHEN a IS NULL THEN 1 END) AS BIGINT) AS unknown FROM v GROUP BY 1""")
def b18(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    any_ = cells.tri_any(F.col("quality") == 1, F.when(F.col("toxic") == 1, F.lit(True)).when(F.col("source") < "src5", F.lit(False)))
    return docs.groupBy("lang").agg(F.count_if(any_).alias("yes"), F.count_if(~any_).alias("no"), F.count_if(any_.isNull()).alias("unknown"))


@query("b19_text_search", """
SELECT doc_id, lang, source FROM documents WHERE contains(lower(strip_accents(concat_ws(' ', source, text))), 'etion ouan') AND lang IN ('fr', 'es')""")
def b19(spark, d):
    hit = text.search_match([F.col("source"), F.col("text")], " ÉTION ouân")
    return table(spark, d, "documents").filter(hit & F.col("lang").isin("fr", "es")).select("doc_id", "lang", "source")


@query("b20_row_shape", """
SELECT o_orderpriority AS priority, CAST(count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS BIGINT) AS whole, CAST(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS ragged
FROM orders GROUP BY 1""")
def b20(spark, d):
    path = scratch_path(spark, "b20")
    short = F.concat_ws(";", "o_orderpriority", F.col("o_orderkey").cast("string"))
    line = F.when(F.col("o_orderstatus") == "P", short).otherwise(F.concat_ws(";", short, "o_orderstatus"))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    rows = delimited.read_with_rejects(spark, path, ["priority", "id", "status"])
    return rows.groupBy("priority").agg(F.count_if(F.col("rejected").isNull()).alias("whole"), F.count("rejected").alias("ragged"))


@query("b21_column_family", f"""
WITH {ORDERS_SQL} SELECT territory, 'P' || substr(priority, 1, 1) AS stage, status_code AS grp, count(*) AS value FROM ord GROUP BY ALL""")
def b21(spark, d):
    name = F.concat(F.lit("P"), F.substring("priority", 1, 1), F.lit("_CAT_"), F.col("status_code"))
    names = [f"P{p[0]}_CAT_{s}" for p in PRIORITIES for s in ("F", "O", "P")]
    wide = orders_by_territory(spark, d).withColumn("name", name).groupBy("territory").pivot("name", names).agg(F.count(F.lit(1)))
    long = delimited.family_to_rows(wide, ["territory"], r"(P\d)_CAT_([A-Z])", ["stage", "grp"])
    return long.filter(F.col("value").isNotNull()).select("territory", "stage", "grp", "value")


@query("b22_rank_eligibility", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, segment AS category, CAST(sum(price) AS DOUBLE) AS value FROM ord GROUP BY ALL
  UNION ALL SELECT territory, '0', CAST(sum(price) AS DOUBLE) FROM ord GROUP BY 1)
SELECT territory, category, value, category NOT IN ('0', 'BUILDING') AS eligible FROM g""")
def b22(spark, d):
    o = orders_by_territory(spark, d)
    parts = o.groupBy("territory", F.col("segment").alias("category")).agg(dbl(F.sum("price")).alias("value"))
    total = o.groupBy("territory").agg(dbl(F.sum("price")).alias("value")).withColumn("category", F.lit("0"))
    return sets.with_peers(parts, total).withColumn("eligible", mapping.rank_eligible(F.col("category"), ["BUILDING"]))


@query("b23_backcast_growth", f"""
WITH {YEARLY_SQL}, p AS (SELECT territory, max(CASE WHEN year = '2000' THEN price END) AS total, max(CASE WHEN year = '2000' THEN price END) - max(CASE WHEN year = '1999' THEN price END) AS change FROM yr GROUP BY 1)
SELECT territory, CAST(total AS DOUBLE) AS total, CAST(total - change AS DOUBLE) AS base, CASE WHEN total - change > 0 THEN CAST(change AS DOUBLE) / CAST(total - change AS DOUBLE) * 100 END AS growth FROM p""")
def b23(spark, d):
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("price")))
    two = yearly_prices(spark, d).groupBy("territory").agg(at("2000").alias("total"), (at("2000") - at("1999")).alias("change"))
    g = mapping.backcast_growth(two, ["territory"], "total", "change")
    return g.select("territory", dbl("total").alias("total"), dbl("base").alias("base"),
                    F.when(F.col("base") > 0, dbl("change") / dbl("base") * 100).alias("growth"))


@query("b24_complement", """
WITH g AS (SELECT lang, count(*) AS whole, CASE WHEN lang <> 'es' THEN count(quality) END AS part FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT lang, whole, part, whole - part AS unlabelled, CASE WHEN part IS NULL THEN 'unavailable' ELSE 'derived' END AS unlabelled_status FROM g""")
def b24(spark, d):
    g = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("whole"), F.when(F.col("lang") != "es", F.count("quality")).alias("part"))
    return mapping.complement(g, "whole", "part", "unlabelled")


@query("b25_mapped_measures", """
WITH m AS (
 SELECT l_returnflag, 'families' AS measure, 'famílias' AS unit, CAST(l_quantity AS DECIMAL(18,2)) AS v, CASE WHEN l_linenumber = 2 THEN 'negative' END AS error FROM lineitem
 UNION ALL SELECT l_returnflag, 'updatedPercent', '%', CAST(l_discount * 2000 AS DECIMAL(18,2)), CASE WHEN CAST(l_discount * 2000 AS DECIMAL(18,2)) > 100 THEN 'above limit' END FROM lineitem
 UNION ALL SELECT l_returnflag, 'transferredValue', 'R$', CAST(l_extendedprice AS DECIMAL(18,2)), NULL FROM lineitem)
SELECT l_returnflag, measure, unit, error, count(*) AS n, CAST(sum(CASE WHEN error IS NULL THEN v END) AS DOUBLE) AS total FROM m GROUP BY ALL""")
def b25(spark, d):
    q = F.col("l_quantity").cast("bigint").cast("string")
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", F.when(F.col("l_linenumber") == 2, F.concat(F.lit("-"), q)).otherwise(q).alias("cadun_f"),
        dec(F.abs(F.col("l_discount") * 2000)).cast("string").alias("cadun_p"), dec("l_extendedprice").cast("string").alias("bf_v"))
    long = mapping.mapped_measures(
        rows, ["l_returnflag"], {"families": "cadun_f", "updatedPercent": "cadun_p", "transferredValue": "bf_v"},
        {"families": ("famílias", "count"), "updatedPercent": ("%", "percent"), "transferredValue": ("R$", "money")})
    return long.groupBy("l_returnflag", "measure", "unit", "error").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum("value")).alias("total"))
