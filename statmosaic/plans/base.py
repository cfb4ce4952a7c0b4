"""Stand-in frames: the given tables read as official statistics.

Lines are movements (returned lines are dismissals, the first line of an accepted return
is a retraction), nations are territories, regions are states, order priorities are
occupations, market segments are sectors.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import year_month
from ..session import scratch_path
from ..sources.landing import listing
from ..sources.opening import write_file

FIRST_MONTH, LAST_MONTH = "199501", "200112"
YEARS = [str(y) for y in range(1995, 2002)]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once, not before every query."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def dec(c: Column | str, p: int = 18, s: int = 2) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({p},{s})")


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def territories(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.lpad(F.col("n_nationkey").cast("string"), 7, "0").alias("code"), F.col("n_name").alias("territory"),
        F.col("r_name").alias("state"), "n_nationkey", "r_regionkey",
    )


def in_months(df: DataFrame, ts: str, months: tuple[str, str] | None) -> DataFrame:
    """Inclusive month window as a range on the stored timestamp, so that files can be skipped."""
    if months is None:
        return df
    bound = lambda ym: F.to_timestamp_ntz(F.lit(f"{ym[:4]}-{ym[4:]}-01 00:00:00"))
    last = int(months[1][:4]) * 12 + int(months[1][4:])
    return df.filter((F.col(ts) >= bound(months[0])) & (F.col(ts) < bound(f"{last // 12:04}{last % 12 + 1:02}")))


def orders_by_territory(spark: SparkSession, d: str, months: tuple[str, str] | None = None) -> DataFrame:
    o, c, t = in_months(table(spark, d, "orders"), "o_orderdate", months), table(spark, d, "customer"), territories(spark, d)
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(t, c.c_nationkey == t.n_nationkey)
        .select(
            "o_orderkey", "o_custkey", "territory", "state", "code", F.year("o_orderdate").cast("string").alias("year"),
            year_month(F.col("o_orderdate")).alias("month"), F.col("o_orderstatus").alias("status_code"),
            F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
            dec("o_totalprice").alias("price"),
        )
    )


ORDERS_SQL = """ord AS (
  SELECT o_orderkey, o_custkey, n_name AS territory, r_name AS state, lpad(CAST(n_nationkey AS VARCHAR), 7, '0') AS code,
         CAST(year(o_orderdate) AS VARCHAR) AS year, strftime(o_orderdate, '%Y%m') AS month, o_orderstatus AS status_code,
         o_orderpriority AS priority, c_mktsegment AS segment, CAST(o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def movements(spark: SparkSession, d: str, months: tuple[str, str] | None = None) -> DataFrame:
    li = in_months(table(spark, d, "lineitem"), "l_shipdate", months)
    exclusion = (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)
    lines = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", year_month(F.col("l_shipdate")).alias("month"),
        F.year("l_shipdate").cast("string").alias("year"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign"),
        F.when(exclusion, -1).otherwise(1).alias("weight"),
        F.when(exclusion, "EXC").when(F.col("l_linestatus") == "O", "FOR").otherwise("MOV").alias("kind"),
        dec("l_extendedprice").alias("salary"), dec("l_quantity").alias("quantity"),
    )
    o = orders_by_territory(spark, d).select(
        "o_orderkey", "o_custkey", "territory", "state", "code", "segment", "priority", F.col("month").alias("declared"))
    return lines.join(o, lines.l_orderkey == o.o_orderkey)


MOVES_SQL = ORDERS_SQL + """, mov AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, strftime(l_shipdate, '%Y%m') AS month,
         CAST(year(l_shipdate) AS VARCHAR) AS year,
         CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN -1 ELSE 1 END AS weight,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'EXC' WHEN l_linestatus = 'O' THEN 'FOR' ELSE 'MOV' END AS kind,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS salary, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
         o_custkey, territory, state, code, segment, priority, ord.month AS declared
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey)"""

FLOWS_SQL = """CAST(sum(CASE WHEN sign = 1 THEN weight ELSE 0 END) AS BIGINT) AS admissions,
  CAST(sum(CASE WHEN sign = -1 THEN weight ELSE 0 END) AS BIGINT) AS dismissals,
  CAST(sum(sign * weight) AS BIGINT) AS balance"""

MONTHS_SQL = """cal AS (
  SELECT strftime(m, '%Y%m') AS month FROM
  (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m))"""


def damaged_pages(spark: SparkSession, d: str) -> DataFrame:
    """Response pages of customers: each seventh declares one more than it holds, each eleventh cannot be read."""
    page = F.floor(F.col("c_custkey") / 200)
    docs = table(spark, d, "customer").groupBy(page.alias("page")).agg(F.to_json(F.struct(
        (F.count(F.lit(1)) + F.when(page % 7 == 3, 1).otherwise(0)).alias("numFound"),
        F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("docs"))).alias("body"))
    return docs.withColumn("body", F.when(F.col("page") % 11 == 5, F.lit("<html>busy</html>")).otherwise(F.col("body")))


def yearly_prices(spark: SparkSession, d: str) -> DataFrame:
    return orders_by_territory(spark, d).groupBy("territory", "state", "year").agg(
        F.sum("price").alias("price"), F.count(F.lit(1)).alias("n"))


YEARLY_SQL = ORDERS_SQL + """, yr AS (
  SELECT territory, state, year, sum(price) AS price, count(*) AS n FROM ord GROUP BY ALL)"""


def _sheet_xml(rows: list[tuple]) -> str:
    out = []
    for i, row in enumerate(rows, 1):
        cells = "".join(
            f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for j, v in enumerate(row)
        )
        out.append(f'<row r="{i}">{cells}</row>')
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook_bytes(rows: list[tuple], sheet: str = "T1") -> bytes:
    """A minimal workbook with one sheet (stand-in for a published file)."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml",
                   '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/'
                   f'officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
                   'Target="worksheets/sheet1.xml" Type="worksheet"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", _sheet_xml(rows))
    return buffer.getvalue()


def archive_bytes(rows: list[tuple]) -> bytes:
    """An archive with two delimited members, each with the header and half of the rows."""
    header, *body = [";".join(str(v) for v in row) + "\r\n" for row in rows]
    buffer, half = io.BytesIO(), len(body) // 2
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.csv", header + "".join(body[:half]))
        z.writestr("second.CSV", header + "".join(body[half:]))
    return buffer.getvalue()


def packed_files(df: DataFrame, kind: str) -> DataFrame:
    """Paths of files written below the shared folder: each Arrow batch of rows becomes one workbook or archive."""
    header, folder, spark = tuple(df.columns), scratch_path(df.sparkSession, kind), df.sparkSession
    pack = workbook_bytes if kind == "xlsx" else archive_bytes

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                write_file(f"{folder}/{b.iloc[0, 0]}.{kind}", pack([header, *b.itertuples(index=False, name=None)]))
                yield pd.DataFrame({"rows": [len(b)]})

    df.mapInPandas(build, "rows long").agg(F.sum("rows")).collect()
    return listing(spark, folder, f"*.{kind}")
