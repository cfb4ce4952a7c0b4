"""C05 and E: dense panels and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import disclosure, windows
from .base import FIRST_MONTH, FLOWS_SQL, LAST_MONTH, MONTHS_SQL, MOVES_SQL, ORDERS_SQL, YEARLY_SQL, dbl, movements, orders_by_territory, table, territories, yearly_prices
from .registry import query

MEASURES = ["admissions", "dismissals", "balance"]

DENSE_SQL = f"""{MOVES_SQL}, {MONTHS_SQL}, led AS (SELECT territory, month, {FLOWS_SQL} FROM mov GROUP BY ALL),
dense AS (SELECT n_name AS territory, cal.month,
    CASE WHEN cal.month BETWEEN '199504' AND '200111' THEN coalesce(admissions, 0) ELSE admissions END AS admissions,
    CASE WHEN cal.month BETWEEN '199504' AND '200111' THEN coalesce(dismissals, 0) ELSE dismissals END AS dismissals,
    CASE WHEN cal.month BETWEEN '199504' AND '200111' THEN coalesce(balance, 0) ELSE balance END AS balance
  FROM nation CROSS JOIN cal LEFT JOIN led ON led.territory = n_name AND led.month = cal.month)"""


def dense_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger on the full calendar; only covered months turn a gap into zero."""
    spine = windows.month_spine(territories(spark, d).select("territory"), FIRST_MONTH, LAST_MONTH)
    led = agg.ledger(movements(spark, d), ["territory", "month"])
    return windows.densify(spine, led, ["territory", "month"], MEASURES, F.col("month").between("199504", "200111"))


@query("c05_dense_spine", f"WITH {DENSE_SQL} SELECT * FROM dense")
def c05(spark, d):
    return dense_ledger(spark, d)


TRAILING_SQL = ", ".join(
    f"CAST(CASE WHEN count({m}) OVER w = 12 THEN sum({m}) OVER w END AS BIGINT) AS {m}_12m" for m in MEASURES)
YTD_SQL = ", ".join(
    f"CAST(CASE WHEN count({m}) OVER y = CAST(substr(month, 5, 2) AS INT) THEN sum({m}) OVER y END AS BIGINT) AS {m}_ytd" for m in MEASURES)
W_SQL = "w AS (PARTITION BY territory ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
Y_SQL = "y AS (PARTITION BY territory, substr(month, 1, 4) ORDER BY month ROWS UNBOUNDED PRECEDING)"


@query("e04_rolling12", f"WITH {DENSE_SQL} SELECT *, {TRAILING_SQL} FROM dense WINDOW {W_SQL}")
def e04(spark, d):
    return windows.complete_trailing(dense_ledger(spark, d), ["territory"], "month", MEASURES)


@query("e05_ytd", f"WITH {DENSE_SQL} SELECT *, {YTD_SQL} FROM dense WINDOW {Y_SQL}")
def e05(spark, d):
    return windows.complete_year_to_date(dense_ledger(spark, d), ["territory"], "month", MEASURES)


def complete_windows(spark: SparkSession, d: str) -> DataFrame:
    dense = windows.complete_trailing(dense_ledger(spark, d), ["territory"], "month", MEASURES)
    return windows.complete_year_to_date(dense, ["territory"], "month", MEASURES)


query("ledger_windows", f"WITH {DENSE_SQL} SELECT *, {TRAILING_SQL}, {YTD_SQL} FROM dense WINDOW {W_SQL}, {Y_SQL}")(complete_windows)

SPARSE_SQL = f"""{YEARLY_SQL}, s AS (SELECT territory, year, CAST(price AS DOUBLE) AS value, CASE WHEN year < '1998' THEN 'old' ELSE 'R$' END AS unit FROM yr WHERE n >= 80)"""


def _sparse(spark, d):
    """Yearly values with gaps and one change of unit."""
    return yearly_prices(spark, d).filter("n >= 80").select(
        "territory", "year", dbl("price").alias("value"), F.when(F.col("year") < "1998", "old").otherwise("R$").alias("unit"))


@query("e01_change", f"""
WITH {SPARSE_SQL}, w AS (SELECT territory, year, value, lag(value) OVER o AS previous FROM s WINDOW o AS (PARTITION BY territory ORDER BY year))
SELECT territory, year, value, previous, CASE WHEN previous > 0 THEN (value / previous - 1) * 100 END AS change FROM w""")
def e01(spark, d):
    return windows.changes(_sparse(spark, d), ["territory"], "year", "value").select("territory", "year", "value", "previous", "change")


@query("e02_annual_change", f"""
WITH {SPARSE_SQL}, w AS (SELECT *, lag(value) OVER o AS p, lag(year) OVER o AS py, lag(unit) OVER o AS pu FROM s WINDOW o AS (PARTITION BY territory ORDER BY year))
SELECT territory, year, unit, CASE WHEN CAST(year AS INT) - CAST(py AS INT) = 1 AND unit = pu AND p > 0 THEN (value / p - 1) * 100 END AS annual_change FROM w""")
def e02(spark, d):
    return windows.annual_changes(_sparse(spark, d), ["territory"], "year", "value", "unit").select("territory", "year", "unit", "annual_change")


@query("e03_base_period", f"""
WITH {SPARSE_SQL} SELECT territory, year, lag(year) OVER o AS from_period, coalesce(CAST(year AS INT) - CAST(lag(year) OVER o AS INT) = 1, FALSE) AS annual
FROM s WINDOW o AS (PARTITION BY territory ORDER BY year)""")
def e03(spark, d):
    return windows.changes(_sparse(spark, d), ["territory"], "year", "value").select("territory", "year", "from_period", "annual")


@query("e06_last_calendar_months", f"WITH {ORDERS_SQL} SELECT month, count(*) AS n FROM ord WHERE month BETWEEN '199808' AND '200007' GROUP BY 1")
def e06(spark, d):
    return windows.last_calendar_months(orders_by_territory(spark, d, ("199808", "200007")), "month", F.lit("200007"), 24).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("e06_last_published", f"""
WITH {ORDERS_SQL}, p AS (SELECT DISTINCT territory, segment, priority, month FROM ord),
r AS (SELECT *, row_number() OVER (PARTITION BY territory, segment, priority ORDER BY month DESC) AS k FROM p)
SELECT territory, segment, priority, month, count(*) AS n FROM ord JOIN r USING (territory, segment, priority, month) WHERE k <= 10 GROUP BY ALL""")
def e06_published(spark, d):
    keys = ["territory", "segment", "priority"]
    return windows.last_published(orders_by_territory(spark, d), keys, "month", 10).groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("n"))


@query("e07_latest_complete", """
WITH r AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS period, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price FROM orders)
SELECT o_custkey, o_orderkey, period, price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY period DESC, o_orderkey DESC) AS k FROM r WHERE price IS NOT NULL AND period >= '1996-01-01') WHERE k = 1""")
def e07(spark, d):
    r = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"))
    return windows.latest_complete(r, ["o_custkey"], "period", ["price"], "1996-01-01", ["o_orderkey"])


@query("e08_latest_reference", f"""
WITH {ORDERS_SQL}, m AS (SELECT territory, segment, max(month) AS month FROM ord GROUP BY ALL)
SELECT territory, segment, month, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM ord JOIN m USING (territory, segment, month) GROUP BY ALL""")
def e08(spark, d):
    rows = windows.latest_reference_rows(orders_by_territory(spark, d), ["territory", "segment"], "month")
    return rows.groupBy("territory", "segment", "month").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum("price")).alias("total"))


@query("e09_between_years", f"""
WITH {YEARLY_SQL}, g AS (SELECT territory, max(CASE WHEN year = '1996' THEN n END) AS start_value, max(CASE WHEN year = '2000' THEN n END) AS end_value FROM yr WHERE year IN ('1996', '2000') GROUP BY 1)
SELECT *, end_value - start_value AS difference FROM g""")
def e09(spark, d):
    return windows.between_periods(yearly_prices(spark, d), ["territory"], "year", "n", "1996", "2000")


@query("e10_group_share", f"""
WITH {ORDERS_SQL}, g AS (SELECT territory, segment, count(*) AS stock FROM ord GROUP BY ALL)
SELECT *, CAST(stock AS DOUBLE) / sum(stock) OVER (PARTITION BY territory) * 100 AS share FROM g""")
def e10(spark, d):
    return windows.group_share(orders_by_territory(spark, d).groupBy("territory", "segment").agg(F.count(F.lit(1)).alias("stock")), ["territory"], "stock")


# The rule stated step by step, for one group at a time: small ones first, then by size and code.
MERGE_SQL = """
rows_ AS (SELECT *, (admissions > 0 AND admissions < 5) OR (dismissals > 0 AND dismissals < 5) AS small FROM base WHERE admissions <> 0 OR dismissals <> 0),
run AS (SELECT *, coalesce(sum(admissions) OVER w, 0) AS a0, coalesce(sum(dismissals) OVER w, 0) AS d0, bool_or(small) OVER (PARTITION BY {k}) AS anysmall
  FROM rows_ WINDOW w AS (PARTITION BY {k} ORDER BY small DESC, admissions + dismissals, {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT *, CASE WHEN NOT small THEN anysmall AND ((a0 > 0 AND a0 < 5) OR (d0 > 0 AND d0 < 5)) END AS open FROM run),
folded AS (SELECT {k}, CASE WHEN small OR coalesce(bool_and(open) OVER w2, FALSE) THEN 'other' ELSE {c} END AS code, admissions, dismissals
  FROM opened WINDOW w2 AS (PARTITION BY {k} ORDER BY small DESC, admissions + dismissals, {c} ROWS UNBOUNDED PRECEDING)),
merged AS (SELECT {k}, code, CAST(sum(admissions) AS BIGINT) AS admissions, CAST(sum(dismissals) AS BIGINT) AS dismissals FROM folded GROUP BY {k}, code),
stat AS (SELECT *, bool_or(code = 'other' AND ((admissions > 0 AND admissions < 5) OR (dismissals > 0 AND dismissals < 5))) OVER (PARTITION BY {k}) AS bad,
  bool_or(code = 'other') OVER (PARTITION BY {k}) AS agg FROM merged)
SELECT {k}, CASE WHEN NOT bad THEN code END AS {c}, CASE WHEN NOT bad THEN admissions END AS admissions, CASE WHEN NOT bad THEN dismissals END AS dismissals,
  CASE WHEN NOT bad THEN admissions - dismissals END AS balance, CASE WHEN bad THEN 'suppressed' WHEN agg THEN 'aggregated' ELSE 'complete' END AS privacy
FROM stat WHERE NOT bad OR code = 'other'"""


@query("e11_absorb_smallest", f"WITH {MOVES_SQL}, base AS (SELECT territory, month, p_type, {FLOWS_SQL} FROM mov JOIN part ON l_partkey = p_partkey GROUP BY ALL),"
       + MERGE_SQL.format(k="territory, month", c="p_type"))
def e11(spark, d):
    m = movements(spark, d).join(
        table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return disclosure.merge_small(agg.ledger(m, ["territory", "month", "p_type"]), ["territory", "month"], "p_type")


@query("e12_regime_break", f"""
WITH {YEARLY_SQL} SELECT territory, year, CASE WHEN year NOT IN ('1997', '2000') THEN n END AS n,
 CAST(sum(CASE WHEN year IN ('1997', '2000') THEN 1 ELSE 0 END) OVER (PARTITION BY territory ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM yr""")
def e12(spark, d):
    return windows.regime_segments(yearly_prices(spark, d).select("territory", "year", "n"), ["territory"], "year", "n", ["1997", "2000"])


@query("e13_first_last_label", f"""
WITH {ORDERS_SQL} SELECT territory, segment, priority, CASE WHEN min(year) = max(year) THEN min(year) ELSE min(year) || '–' || max(year) END AS years FROM ord GROUP BY ALL""")
def e13(spark, d):
    return windows.first_last_label(orders_by_territory(spark, d), ["territory", "segment", "priority"], "year")
