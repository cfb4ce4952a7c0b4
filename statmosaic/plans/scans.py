"""A: scans and sinks.  Files are written from the given tables, then read under contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cells import strict_number
from ..operators.aggregates import grand_total
from ..operators.mapping import with_provenance
from ..operators.quality import declared_total, export_matches, key_text
from ..session import materialize, param_table, scratch_path
from ..sources import archives, delimited, landing, nested
from ..sources.delimited import Layout
from .base import ORDERS_SQL, YEARLY_SQL, YEARS, damaged_pages, dbl, dec, orders_by_territory, packed_files, table, territories, yearly_prices
from .registry import query


def _comma(c):
    return F.translate(c.cast("string"), ".", ",")


def _status_files(spark, d):
    """Orders of each status under a header of its own; those of the rarest lack a column."""
    o = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("Prioridade"), _comma(dec("o_totalprice")).alias("Valor Total"),
        F.col("o_orderkey").cast("string").alias("Código do Pedido"), F.col("o_orderstatus").alias("Situação"))
    orders_of = {"F": ["Prioridade", "Valor Total", "Código do Pedido", "Situação"], "O": ["Situação", "Código do Pedido", "Prioridade", "Valor Total"],
                 "P": ["Código do Pedido", "Valor Total", "Situação", "Prioridade"]}
    root = scratch_path(spark, "a01")
    for status, columns in orders_of.items():
        landing.export_csv(o.filter(F.col("Situação") == status), f"{root}/{status}", columns)
    landing.export_csv(o.filter(F.col("Situação") == "P"), f"{root}/short", orders_of["P"][:3])
    return root, list(orders_of)


A01_LAYOUT = Layout(("codigodopedido", "valortotal", "situacao", "prioridade"))


@query("a01_header_contract", """
SELECT o_orderstatus AS situacao, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1""")
def a01(spark, d):
    root, parts = _status_files(spark, d)
    value = strict_number(F.col("valortotal"), comma=True, type_="decimal(18,2)")
    return delimited.read_contract(spark, [f"{root}/{p}" for p in parts], A01_LAYOUT).groupBy("situacao").agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum(value)).alias("total"))


@query("a01_header_violations", """
SELECT DISTINCT 'short' AS part, 'missing columns [''prioridade''], unexpected columns []' AS problem FROM orders WHERE o_orderstatus = 'P'""")
def a01_violations(spark, d):
    root, parts = _status_files(spark, d)
    headers = delimited.file_headers(spark, [f"{root}/{p}" for p in (*parts, "short")], A01_LAYOUT)
    return delimited.header_violations(headers).select(F.regexp_extract("key", r"/(\w+)/[^/]+$", 1).alias("part"), F.col("detail").alias("problem")).distinct()


@query("a02_edition_layout", """
SELECT CASE WHEN year(o_orderdate) < 1998 THEN '1997' ELSE '1998' END AS edition, o_orderpriority AS prioridade, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY ALL""")
def a02(spark, d):
    layouts = {
        "1997": Layout(("prioridade", "valor"), sep=",", encoding="ISO-8859-1"),
        "1998": Layout(("valor", "prioridade", "pedido"), sep=";"),
    }
    o = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("prioridade"),
        dec("o_totalprice").cast("string").alias("valor"), F.col("o_orderkey").cast("string").alias("pedido"))
    old, new = scratch_path(spark, "a02"), scratch_path(spark, "a02")
    landing.export_csv(o.filter("y < 1998"), old, ["prioridade", "valor"], sep=",")
    landing.export_csv(o.filter("y >= 1998"), new, ["pedido", "valor", "prioridade"])
    rows = delimited.same_schema([
        delimited.read_edition(spark, p, e, layouts, ["prioridade", "valor"]) for e, p in (("1997", old), ("1998", new))])
    return rows.groupBy("edition", "prioridade").agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum(F.col("valor").cast("decimal(18,2)"))).alias("total"))


@query("a03_counted_scan", """
SELECT coalesce(c_mktsegment, 'Total') AS segment, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def a03(spark, d):
    path = scratch_path(spark, "a03")
    landing.export_csv(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")),
                       path, ["id", "segment"])
    rows, _ = delimited.counted(delimited.read_contract(spark, path, Layout(("id", "segment"))))
    return grand_total(rows, "segment", [F.count(F.lit(1)).alias("n")])


@query("a04_adaptive_layout", """
SELECT c_mktsegment AS segment, CASE WHEN c_nationkey < 10 THEN 'wide' ELSE 'split' END AS layout, count(*) AS n,
  CAST(count(CASE WHEN c_acctbal > 0 THEN 1 END) AS BIGINT) AS positive, CAST(0 AS BIGINT) AS conflicts
FROM customer GROUP BY ALL""")
def a04(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.lit("1").alias("active"), F.col("c_mktsegment").alias("segment"),
        dec("c_acctbal").cast("string").alias("balance"), "c_nationkey")
    layouts = {"unit": Layout(("id", "active", "segment", "balance")), "base": Layout(("id", "active", "segment")),
               "money": Layout(("id", "active", "balance"))}
    wide, base, money = (scratch_path(spark, "a04") for _ in range(3))
    landing.export_csv(c.filter("c_nationkey < 10"), wide, ["id", "active", "segment", "balance"])
    landing.export_csv(c.filter("c_nationkey >= 10"), base, ["id", "active", "segment"])
    landing.export_csv(c.filter("c_nationkey >= 10"), money, ["id", "active", "balance"])
    out = None
    for label, tables in (("wide", {"unit": wide}), ("split", {"base": base, "money": money})):
        m = delimited.read_adaptive(spark, tables, "unit", ["id"], layouts, "active").select(
            F.lit(label).alias("layout"), "segment", "balance", "conflicts")
        out = m if out is None else out.unionByName(m)
    return out.groupBy("segment", "layout").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("balance").cast("decimal(18,2)") > 0).alias("positive"),
        F.count_if(F.size("conflicts") > 0).alias("conflicts"))


@query("a05_vintage_dialects", """
SELECT n_name AS name, count(*) AS n, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_seen
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def a05(spark, d):
    t = territories(spark, d).select("code", F.col("territory").alias("name"), "state")
    e = table(spark, d, "events").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).join(
        territories(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.col("value").cast("string").alias("lat"), F.col("value").cast("string").alias("lon"), "code", "territory", "state")
    annual_path, monthly_path = scratch_path(spark, "a05"), scratch_path(spark, "a05")
    landing.export_csv(
        e.filter(F.col("at") < "2024-01-16").select(F.col("id").alias("foco_id"), F.col("at").alias("data_pas"), "lat", "lon",
            F.replace(F.lower("territory"), F.lit("nation"), F.lit("nátion")).alias("municipio"), F.lower("state").alias("estado")),
        annual_path, ["foco_id", "data_pas", "lat", "lon", "municipio", "estado"], sep=",")
    landing.export_csv(
        e.filter(F.col("at") >= "2024-01-16").select("id", F.col("at").alias("data_hora_gmt"), "lat", "lon",
            F.col("code").alias("municipio_id")),
        monthly_path, ["id", "data_hora_gmt", "lat", "lon", "municipio_id"])
    named = lambda df, names: df.toDF(*names)
    annual_cols, monthly_cols = ["foco_id", "data_pas", "lat", "lon", "municipio", "estado"], ["id", "data_hora_gmt", "lat", "lon", "municipio_id"]
    annual = named(delimited.read_contract(spark, annual_path, Layout(tuple(annual_cols), sep=",")), annual_cols)
    monthly = named(delimited.read_contract(spark, monthly_path, Layout(tuple(monthly_cols))), monthly_cols)
    return delimited.observation_dialects(annual, monthly, t).join(t, "code").groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("first_seen"))


PART_SQL = """
SELECT p_brand AS brand, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM part GROUP BY 1"""


def _part_rows(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand"), dec("p_retailprice").cast("string").alias("price"))


def _by_brand(rows):
    return rows.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum(F.col("price").cast("decimal(18,2)"))).alias("total"))


@query("a06_workbook_cells", PART_SQL)
def a06(spark, d):
    cells = archives.workbook_cells(packed_files(_part_rows(spark, d), "xlsx"))
    wide = cells.filter("row > 1").groupBy("path", "sheet", "row").pivot("col", [2, 3]).agg(F.max("text"))
    return _by_brand(wide.select(F.col("2").alias("brand"), F.col("3").alias("price")))


@query("a07_archive_rows", PART_SQL)
def a07(spark, d):
    return _by_brand(archives.archive_rows(packed_files(_part_rows(spark, d), "zip"), ["brand", "id", "price"], members=2))


@query("a08_merged_headers", f"""
WITH {ORDERS_SQL}
SELECT territory, CASE status_code WHEN 'F' THEN 'Fechado' WHEN 'O' THEN 'Aberto' ELSE 'Pendente' END AS sector, year, count(*) AS n
FROM ord GROUP BY ALL""")
def a08(spark, d):
    groups = [("Aberto", "O"), ("Fechado", "F"), ("Pendente", "P")]
    at = {code: i for i, (_, code) in enumerate(groups)}
    counts = orders_by_territory(spark, d).groupBy("state", "territory", "code", "status_code", "year").agg(F.count(F.lit(1)).alias("n"))
    offset = F.when(F.col("status_code") == "O", at["O"]).when(F.col("status_code") == "F", at["F"]).otherwise(at["P"])
    row = F.col("code").cast("int") + 10
    body = counts.select(F.col("state").alias("path"), F.lit("T4").alias("sheet"), row.alias("row"),
                         (F.lit(3) + offset * len(YEARS) + F.col("year").cast("int") - int(YEARS[0])).alias("col"),
                         F.col("n").cast("string").alias("text"))
    names = territories(spark, d).select(F.col("state").alias("path"), F.lit("T4").alias("sheet"), row.alias("row"),
                                         F.lit(1).alias("col"), F.col("territory").alias("text"))
    heads = [(4, 1, "Código"), (4, 2, "UF")] + [(4, 3 + g * len(YEARS), label) for g, (label, _) in enumerate(groups)]
    heads += [(5, 3 + g * len(YEARS) + i, y) for g in range(len(groups)) for i, y in enumerate(YEARS)]
    head = territories(spark, d).select(F.col("state").alias("path")).distinct().select("path", F.lit("T4").alias("sheet"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in heads])).alias("h")).select("path", "sheet", "h.*")
    cells = materialize(body.unionByName(names).unionByName(head), "a08")
    bound = archives.bind_headers(cells, ["Código", "UF"], depth=2)
    who = bound.filter(F.col("name") == "Código").select("path", "sheet", "row", F.col("text").alias("territory"))
    return bound.filter(F.col("name").rlike(r"^\d{4}$")).join(who, ["path", "sheet", "row"]).select(
        "territory", F.col("group").alias("sector"), F.col("name").alias("year"), F.col("text").cast("bigint").alias("n"))


def _cube_docs(spark, d):
    """Cube responses, one per territory: seven years by five categories each."""
    cell = orders_by_territory(spark, d).groupBy("territory", "code", "priority", "year").agg(
        F.when(F.count(F.lit(1)) < 5, "X").otherwise(F.sum("price").cast("string")).alias("raw"))
    series = cell.groupBy("territory", "code", "priority").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "raw"))).alias("serie"))
    result = series.select("territory", "code", F.struct(
        F.array(F.struct(F.lit("81").alias("id"), F.lit("Produto").alias("nome"),
                         F.create_map(F.substring("priority", 1, 1), F.col("priority")).alias("categoria"))).alias("classificacoes"),
        F.array(F.struct(F.struct(F.col("code").alias("id"), F.struct(F.lit("N6").alias("id"), F.lit("Município").alias("nome")).alias("nivel"),
                                  F.col("territory").alias("nome")).alias("localidade"), "serie")).alias("series")).alias("r"))
    return result.groupBy(F.col("territory").alias("response")).agg(F.to_json(F.array(F.struct(
        F.lit("215").alias("id"), F.lit("Valor da produção").alias("variavel"), F.lit("R$").alias("unidade"),
        F.collect_list("r").alias("resultados")))).alias("body"))


@query("a09_cube_cells", f"""
WITH {ORDERS_SQL}
SELECT code AS territory, '81=' || substr(priority, 1, 1) AS dims, year AS period, CASE WHEN count(*) < 5 THEN 'suppressed' ELSE 'real' END AS status,
  CASE WHEN count(*) >= 5 THEN CAST(sum(price) AS DOUBLE) END AS value
FROM ord GROUP BY code, priority, year""")
def a09(spark, d):
    return nested.cube_cells(_cube_docs(spark, d)).select(
        "territory", nested.dims_key(F.col("dims")).alias("dims"), "period", "status", "value")


@query("a09_cube_violations", """
SELECT 'cube' AS gate, n_name AS key, CASE n_nationkey % 4 WHEN 1 THEN 'unreadable response' WHEN 2 THEN '1 results of several categories' ELSE 'unreadable response' END AS detail
FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey)""")
def a09_violations(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("response"), "n_nationkey")
    two = '"categoria":{"1":"1-URGENT","9":"'
    kind = F.col("n_nationkey") % 4
    damaged = _cube_docs(spark, d).join(n, "response").withColumn("body", F.when(kind == 1, F.lit("<html>error</html>")).when(kind == 3, F.lit(None)).when(
        kind == 2, F.regexp_replace("body", r'"categoria":\{"1":"', two)).otherwise(F.col("body")))
    return nested.cube_violations(damaged, ["response"])


@query("a10_header_record", """
SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY 1""")
def a10(spark, d):
    rows = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("row_index"), F.col("c_mktsegment").alias("D1C"),
                                              dec("c_acctbal").cast("string").alias("V"))
    head = param_table(spark, [(0, "Segmento (Código)", "Valor")], "row_index bigint, D1C string, V string")
    return delimited.drop_header_record(rows.unionByName(head)).groupBy(F.col("D1C").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), dbl(F.sum(F.col("V").cast("decimal(18,2)"))).alias("total"))


# pages come damaged on purpose: each seventh declares one more, each eleventh is no document at all
@query("a11_paged_documents", """
WITH c AS (SELECT c_custkey, c_mktsegment, c_custkey // 200 AS page FROM customer),
good AS (SELECT * FROM c WHERE page % 11 <> 5)
SELECT c_mktsegment AS segment, count(*) AS n, CAST(count(DISTINCT page) AS BIGINT) AS pages, CAST(count(CASE WHEN page % 7 = 3 THEN 1 END) AS BIGINT) AS truncated FROM good GROUP BY 1
UNION ALL SELECT NULL, count(*), count(*), count(*) FROM (SELECT DISTINCT page FROM c WHERE page % 11 = 5) HAVING count(*) > 0""")
def a11(spark, d):
    rows = nested.paged_documents(damaged_pages(spark, d), "struct<id: bigint, segment: string>")
    bad = declared_total(rows, ["page"], "declared", "received").select(F.col("key").cast("bigint").alias("page"), F.lit(1).alias("bad"))
    return rows.join(bad, "page", "left").groupBy(F.col("doc.segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"), F.count("bad").alias("truncated"))


def _features(spark, d):
    c = table(spark, d, "customer")
    lon, lat = F.lit(-60.0) + F.col("c_custkey") / 1024.0, F.lit(-30.0) + F.col("c_nationkey") / 8.0
    return c.select(
        "c_custkey", "c_mktsegment", F.lit("Point").alias("kind"), F.array(lon, lat).alias("coordinates"),
        F.struct(F.col("c_custkey").cast("string").alias("code"), F.col("c_mktsegment").alias("segment")).alias("properties"))


FEATURE_SQL = """
SELECT c_mktsegment AS segment, count(*) AS n, min(-60.0 + c_custkey / 1024.0) AS min_lon, max(-30.0 + c_nationkey / 8.0) AS max_lat
FROM customer GROUP BY 1"""


def _by_segment(points):
    return points.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("p.x").alias("min_lon"), F.max("p.y").alias("max_lat"))


@query("a12_geojson_features", FEATURE_SQL.replace("-60.0", "CAST(-60.0 AS DOUBLE)").replace("-30.0", "CAST(-30.0 AS DOUBLE)"))
def a12(spark, d):
    f = nested.geojson_features(_collections(spark, d), "struct<code: string, segment: string>").filter(F.col("geometry_type").isNotNull())
    return _by_segment(f.select(F.col("properties.segment").alias("segment"), nested.point_of(F.col("coordinates")).alias("p")))


def _collections(spark, d):
    """Pages of features; some say that they were cut, or declare more, and page -1 is an error."""
    page = F.floor(F.col("c_custkey") / 500)
    whole = _features(spark, d).groupBy(page.alias("page")).agg(F.to_json(F.struct(
        (page % 5 == 2).alias("exceededTransferLimit"),
        (F.count(F.lit(1)) + F.when(page % 7 == 3, 1).otherwise(0)).alias("numberMatched"),
        F.collect_list(F.struct(F.struct(F.col("kind").alias("type"), "coordinates").alias("geometry"), "properties")).alias("features"))).alias("body"))
    return whole.unionByName(param_table(spark, [(-1, '{"error":"busy"}')], "page bigint, body string"))


@query("a12_incomplete_collections", """
SELECT 'transfer' AS gate, CAST(page AS VARCHAR) AS key, 'incomplete collection' AS detail FROM (SELECT DISTINCT c_custkey // 500 AS page FROM customer) WHERE page % 5 = 2 OR page % 7 = 3
UNION ALL SELECT 'transfer', '-1', 'incomplete collection'""")
def a12_incomplete(spark, d):
    return nested.feature_violations(nested.geojson_features(_collections(spark, d), "struct<code: string, segment: string>"), ["page"])


@query("a13_page_links", """
WITH links AS (
  SELECT page_id, url AS page_url, replace(unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)), '&amp;', '&') AS href FROM pages),
abs AS (
  SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href
    WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^(https?://[^/?#]+)', 1) || href END AS url FROM links)
SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, count(*) AS links, count(DISTINCT url) AS distinct_links, count(DISTINCT page_id) AS pages
FROM abs WHERE url IS NOT NULL GROUP BY 1""")
def a13(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("page_url"), "html")
    links = landing.page_links(p).withColumn("url", landing.absolute(F.col("page_url"), F.col("href"))).filter(F.col("url").isNotNull())
    return links.groupBy(F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme")).agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("url").alias("distinct_links"), F.count_distinct("page_id").alias("pages"))


@query("a13_newest_edition", """
WITH u AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
e AS (SELECT url, regexp_extract(path, '^/[a-z]{2}/(\\d+)', 1) AS edition, regexp_extract(path, '^/([a-z]{2})/', 1) AS lang
      FROM u WHERE regexp_matches(host, 'example\\.(com|org|net)$') AND regexp_matches(path, '^/[a-z]{2}/(\\d+)'))
SELECT lang, edition, min(url) AS url FROM e WHERE (lang, edition) IN (SELECT (lang, max(edition)) FROM e GROUP BY lang) GROUP BY ALL""")
def a13_newest(spark, d):
    offered = landing.official_links(table(spark, d, "pages").select("url"), r"example\.(com|org|net)$", r"^/[a-z]{2}/(\d+)", ("http", "https"))
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return landing.newest_edition(offered.withColumn("lang", F.regexp_extract(path, "^/([a-z]{2})/", 1)), ["lang"])


@query("a14_file_inventory", """
WITH v AS (
  SELECT c_custkey // 500 AS page, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS before,
    string_agg(CASE WHEN c_acctbal < -900 THEN c_name || '*' ELSE c_name END, chr(10) ORDER BY c_custkey) || chr(10) AS body
  FROM customer GROUP BY 1)
SELECT CAST(page AS BIGINT) AS page, sha256(body) AS sha256, CAST(length(body) AS BIGINT) AS size, CAST(sha256(body) <> before AS BIGINT) AS changed FROM v""")
def a14(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.floor(F.col("c_custkey") / 500).alias("page"))

    def landed(name):
        path = scratch_path(spark, "a14")
        c.select("page", "c_custkey", name.alias("value")).repartition("page").sortWithinPartitions("page", "c_custkey").select(
            "page", "value").write.partitionBy("page").text(path)
        at = F.regexp_extract("path", r"page=(\d+)/", 1)
        return landing.inventory(spark, path, "*.txt").withColumn("path", at)

    before = landed(F.col("c_name"))
    after = landed(F.when(F.col("c_acctbal") < -900, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    moved = landing.changed_files(after, before).select("path", F.lit(1).alias("moved"))
    return after.join(moved, "path", "left").select(
        F.col("path").cast("bigint").alias("page"), "sha256", F.col("size").cast("bigint").alias("size"),
        F.coalesce("moved", F.lit(0)).cast("bigint").alias("changed"))


@query("a14_incremental_manifest", """
SELECT CAST(c_custkey // 500 AS BIGINT) AS page, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256,
  CAST(sum(length(c_name) + 1) AS BIGINT) AS size, CAST(1 + (c_custkey // 500) % 2 AS BIGINT) AS opened_in
FROM customer GROUP BY c_custkey // 500""")
def a14_incremental(spark, d):
    """A folder that grows: the second run opens the files of odd pages only and takes the others from the manifest."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("value"), F.floor(F.col("c_custkey") / 500).alias("page"))
    path, manifest = scratch_path(spark, "a14"), spark.createDataFrame([], f"{landing.MANIFEST}, opened_in long")
    for run in (1, 2):
        c.where(F.col("page") % 2 == run - 1).repartition("page").sortWithinPartitions("page", "c_custkey").select("page", "value").write.mode("append").partitionBy("page").text(path)
        seen = landing.refreshed_manifest(spark, path, manifest, "*.txt").join(manifest.select("path", "opened_in"), "path", "left")
        manifest = materialize(seen.withColumn("opened_in", F.when(F.col("opened"), F.lit(run)).otherwise(F.col("opened_in"))).drop("opened"), "a14")
    return manifest.select(F.regexp_extract("path", r"page=(\d+)/", 1).cast("bigint").alias("page"), "sha256", "size", F.col("opened_in").cast("bigint").alias("opened_in"))


@query("a15_tidy_export", f"""
WITH {YEARLY_SQL}
SELECT territory, year, CAST(price AS VARCHAR) AS value, state AS source_id, 'https://stats.example.org/' || state AS url, CAST(0 AS BIGINT) AS differences FROM yr""")
def a15(spark, d):
    sources = territories(spark, d).select(F.col("state").alias("source_id"), F.concat(F.lit("https://stats.example.org/"), "state").alias("url")).distinct()
    rows = with_provenance(yearly_prices(spark, d).select(
        "territory", "year", F.col("price").cast("string").alias("value"), F.col("state").alias("source_id")), sources)
    cols = ["territory", "year", "value", "source_id", "url"]
    path = scratch_path(spark, "a15")
    landing.export_csv(rows, path, cols)
    back = delimited.read_contract(spark, path, Layout(tuple(c for c in cols))).toDF(*cols)
    bad = export_matches(back, rows.select(*cols)).groupBy("key").agg(F.count(F.lit(1)).alias("differences"))
    return back.withColumn("key", key_text(cols)).join(bad, "key", "left").select(*cols, F.coalesce("differences", F.lit(0)).alias("differences"))


@query("a16_snapshot", f"""
WITH {YEARLY_SQL} SELECT territory, year, CAST(price AS DOUBLE) AS price, n FROM yr""")
def a16(spark, d):
    path = scratch_path(spark, "a16")
    landing.write_snapshot(yearly_prices(spark, d), f"{path}/parquet", ["state"])
    canonical = spark.read.parquet(f"{path}/parquet")
    landing.write_snapshot(canonical, f"{path}/json", fmt="json")
    return spark.read.schema(canonical.schema).json(f"{path}/json").select("territory", "year", dbl("price").alias("price"), "n")


@query("a17_raw_landing", """
SELECT c_mktsegment AS source_id, count(DISTINCT substr(sha256(c_name || '|' || c_mktsegment), 1, 12)) AS landed,
  min(substr(sha256(c_name || '|' || c_mktsegment), 1, 12)) AS first_digest FROM customer GROUP BY 1""")
def a17(spark, d):
    path = scratch_path(spark, "a17")
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source_id"), F.concat_ws("|", "c_name", "c_mktsegment").alias("payload"))
    landing.land_raw(c.unionByName(c), path)
    return spark.read.parquet(path).groupBy("source_id").agg(F.count(F.lit(1)).alias("landed"), F.min("digest").alias("first_digest"))


@query("a18_boundary_export", FEATURE_SQL.replace("-60.0", "CAST(-60.0 AS DOUBLE)").replace("-30.0", "CAST(-30.0 AS DOUBLE)"))
def a18(spark, d):
    path = scratch_path(spark, "a18")
    landing.write_features(_features(spark, d).select(
        nested.feature_text(F.col("kind"), F.col("coordinates"), F.col("properties")).alias("feature")), path)
    lines = spark.read.text(path).select(F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("body"))
    f = nested.geojson_features(lines, "struct<code: string, segment: string>")
    return _by_segment(f.select(F.col("properties.segment").alias("segment"), nested.point_of(F.col("coordinates")).alias("p")))


@query("a19_keyed_indicator", f"""
WITH {YEARLY_SQL}
SELECT territory, max(year) AS reference, CAST(arg_max(price, year) AS DOUBLE) AS value FROM yr GROUP BY 1""")
def a19(spark, d):
    y = yearly_prices(spark, d)
    docs = y.groupBy("territory").agg(F.map_from_entries(F.collect_list(F.struct("year", F.col("price").cast("string")))).alias("res")).select(
        F.to_json(F.array(F.struct(F.lit(47001).cast("bigint").alias("id"), F.array(F.struct(F.col("territory").alias("localidade"), "res")).alias("res")))).alias("body"))
    tree = param_table(spark, [(
        '[{"id":47000,"indicador":"Per capita","unidade":{"id":"R$","multiplicador":1},"children":[{"id":47001,"indicador":"Série revisada","unidade":{"id":"R$","multiplicador":1}}]},'
        '{"id":5,"indicador":"Outro","children":[{"id":6,"indicador":"Série revisada","unidade":{"id":"R$","multiplicador":1}}]}]',)], "body string")
    rows = nested.confirmed_by_parent(nested.keyed_series(docs), tree, "Per capita", "R$")
    return nested.latest_published(rows, F.col("published").cast("double")).select("territory", "reference", "value")
