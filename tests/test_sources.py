import gzip
import hashlib
import io
import json
import os
import zipfile
from urllib.parse import unquote

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statmosaic.functions.cells import strict_number
from statmosaic.plans.base import workbook_bytes
from statmosaic.sources import archives, delimited, landing, nested
from statmosaic.sources.delimited import ContractError, Layout

LAYOUT = Layout(("código", "valor", "uf"))


def put(tmp_path, name, text, encoding="utf-8"):
    (tmp_path / name).write_bytes(text.encode(encoding))
    return str(tmp_path / name)


def test_header_order_accents_and_bom_do_not_matter(spark, tmp_path, rows):
    p = put(tmp_path, "a.csv", "﻿UF;Código;VALOR\n41;001;1,5\n42;002;2,0\n")
    assert rows(delimited.read_contract(spark, p, LAYOUT)) == [("001", "1,5", "41"), ("002", "2,0", "42")]


@pytest.mark.parametrize("header,why", [
    ("codigo;valor;uf;codigo", "duplicate"), ("codigo;valor", "missing"), ("codigo;valor;uf;extra", "unexpected")])
def test_broken_headers_fail(spark, tmp_path, header, why):
    p = put(tmp_path, "a.csv", header + "\n" + ";".join("1" * len(header.split(";"))) + "\n")
    with pytest.raises(ContractError, match=why):
        delimited.read_contract(spark, p, LAYOUT)


def test_subset_contract_allows_extra_columns(spark, tmp_path, rows):
    p = put(tmp_path, "a.csv", "codigo;valor;uf;extra\n1;2;3;4\n")
    assert rows(delimited.read_contract(spark, p, Layout(LAYOUT.columns, exact=False))) == [("1", "2", "3")]


@pytest.mark.parametrize("line", ["1;2", "1;2;3;4"])
def test_ragged_rows_fail_even_when_pruned(spark, tmp_path, line):
    p = put(tmp_path, "a.csv", f"codigo;valor;uf\n{line}\n")
    df = delimited.read_contract(spark, p, LAYOUT)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        df.select("codigo").collect()
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        df.count()


def test_files_of_one_load_may_order_their_columns_differently(spark, tmp_path, rows):
    put(tmp_path, "a.csv", "codigo;valor;uf\n1;2;3\n")
    put(tmp_path, "b {1}*.csv", "\ufeffVALOR;Código;UF\n20;10;30\n21;11;31\n")
    put(tmp_path, "c d.csv", '"uf";"codigo";"valor"\n300;100;200\n')
    put(tmp_path, "e.csv", "codigo;valor;uf\n4;5;6\n")
    got = delimited.read_contract(spark, str(tmp_path), LAYOUT, with_path=True)
    assert rows(got, "codigo", "valor", "uf") == sorted([("1", "2", "3"), ("10", "20", "30"), ("11", "21", "31"), ("100", "200", "300"), ("4", "5", "6")], key=repr)
    assert {unquote(r["file_path"]).rsplit("/", 1)[1] for r in got.where("length(codigo) > 1").collect()} == {"b {1}*.csv", "c d.csv"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 3  # one scan for each way of writing the header


def test_files_that_break_the_contract_are_named(spark, tmp_path, rows):
    put(tmp_path, "a.csv", "codigo;valor;uf\n1;2;3\n")
    put(tmp_path, "bad.csv", "codigo;valor\n1;2\n")
    put(tmp_path, "none.csv", "\n")
    headers = delimited.file_headers(spark, str(tmp_path), LAYOUT)
    assert [(r["gate"], r["key"].rsplit("/", 1)[1], r["detail"]) for r in delimited.header_violations(headers).orderBy("key").collect()] == [
        ("header", "bad.csv", "missing columns ['uf'], unexpected columns []"), ("header", "none.csv", "empty file")]
    with pytest.raises(ContractError, match="bad.csv: missing"):
        delimited.read_contract(spark, str(tmp_path), LAYOUT)
    good = [r["path"] for r in headers.where("problem IS NULL").collect()]
    assert rows(delimited.read_contract(spark, good, LAYOUT)) == [("1", "2", "3")]


def test_only_first_lines_are_read_for_headers(spark, tmp_path):
    """Bytes after the first lines are no text at all, and packed files are unpacked."""
    (tmp_path / "a.csv").write_bytes(b"codigo;valor;uf\n" + b"1;2;3\n" * 100_000 + b"\xff\xff")
    with gzip.open(tmp_path / "b.csv.gz", "wb") as f:
        f.write(b"uf;valor;codigo\n3;2;1\n")
    got = delimited.file_headers(spark, str(tmp_path), LAYOUT).orderBy("path").collect()
    assert [(r["header"], r["problem"]) for r in got] == [(["codigo", "valor", "uf"], None), (["uf", "valor", "codigo"], None)]


def test_cp1252_bytes(spark, tmp_path, rows):
    p = put(tmp_path, "a.csv", "Código;Valor;UF\n1;R€ – ção;3\n", "cp1252")
    got = delimited.read_contract(spark, p, Layout(LAYOUT.columns, encoding="cp1252"))
    assert rows(got) == [("1", "R€ – ção", "3")]


@pytest.fixture
def default_charsets(spark):
    """A session as Spark starts it, which takes no code page by itself."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    yield
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def test_code_pages_need_no_session_setting(spark, tmp_path, rows, default_charsets):
    (tmp_path / "a.csv").write_bytes("Código€;Valor;UF\n1;R€ – ção;3\n2;".encode("cp1252") + b"\xff\x85 x;4\n")
    layout = Layout(("código€", "valor", "uf"), encoding="cp1252")
    assert rows(delimited.read_contract(spark, str(tmp_path), layout), "valor") == [("R€ – ção",), ("ÿ… x",)]
    for encoding, text in (("cp1252", "R€ – ção"), ("iso-8859-15", "€uro Ž"), ("cp1251", "Я Россия")):
        own = Layout(("id", text.split(" ")[0]), sep=",", encoding=encoding)
        df = spark.createDataFrame([("1", text), ("2", "a,\"b\""), ("3", "\x80中")], own.columns)
        delimited.write_contract(df, str(tmp_path / encoding), own)
        assert b"".join(p.read_bytes() for p in (tmp_path / encoding).glob("*.csv")).decode(encoding).count(f"1,{text}") == 1
        lost = "\x80?" if encoding == "iso-8859-15" else "??"
        read = delimited.read_contract(spark, str(tmp_path / encoding), own)
        assert rows(read) == [("1", text), ("2", "a,\"b\""), ("3", lost)]


def test_stock_queries_need_no_session_setting(spark, tmp_path, rows, default_charsets):
    from statmosaic.plans import QUERIES

    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(str(tmp_path / "region.parquet"))
    spark.createDataFrame([(3, "Território", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    # kept: 1 (industry), 2 (construction), 3 (commerce) and 11, 16 (industry); not active: 10; abandoned: 7
    spark.createDataFrame([(k, 3, 10.0 * k) for k in (1, 2, 3, 7, 10, 11, 16)], "c_custkey int, c_nationkey int, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    edition = QUERIES["employment_stock_edition"](spark, str(tmp_path))
    assert rows(edition, "territory", "sector", "stock", "sample", "mean") == sorted([
        ("Território", "industry", 3, None, None), ("Território", "construction", 1, None, None), ("Território", "commerce", 1, None, None),
        ("Território", "total", 5, 5, 66.0)], key=repr)
    control = QUERIES["employment_stock_control"](spark, str(tmp_path))
    assert rows(control) == [("stock", "Território|industry", "mismatch 3 4")]


def test_unknown_edition_fails(spark, tmp_path):
    with pytest.raises(ContractError, match="no layout"):
        delimited.read_edition(spark, str(tmp_path), "2031", {"2025": LAYOUT})


def test_counted_scan_reports_every_row(spark, tmp_path):
    p = put(tmp_path, "a.csv", "codigo;valor;uf\n1;2;3\n4;5;6\n")
    df, seen = delimited.counted(delimited.read_contract(spark, p, LAYOUT))
    assert df.filter("codigo = '1'").count() == 1
    assert seen.get["rows"] == 2


def test_adaptive_layout_refuses_a_mixture(spark, tmp_path, rows):
    layouts = {"wide": Layout(("id", "active", "a", "b")), "p": Layout(("id", "active", "a")), "q": Layout(("id", "active", "b"))}
    wide = put(tmp_path, "w.csv", "id;active;a;b\n1;1;x;y\n")
    p, q = put(tmp_path, "p.csv", "id;active;a\n1;1;x\n2;1;z\n"), put(tmp_path, "q.csv", "id;active;b\n1;1;y\n")
    one = delimited.read_adaptive(spark, {"wide": wide}, "wide", ["id"], layouts, "active")
    two = delimited.read_adaptive(spark, {"p": p, "q": q}, "wide", ["id"], layouts, "active")
    assert rows(one, "id", "a", "b") == [("1", "x", "y")]
    assert rows(two, "id", "a", "b", "incomplete") == [("1", "x", "y", False), ("2", "z", None, True)]
    with pytest.raises(ContractError):
        delimited.read_adaptive(spark, {"wide": wide, "p": p}, "wide", ["id"], layouts, "active")


def test_exports_come_back_as_they_were(spark, tmp_path, rows):
    data = [(' lead "quoted"; semi ', "1"), ("plain", None), ('""', "ção")]
    df = spark.createDataFrame(data, "name string, v string")
    landing.export_csv(df, str(tmp_path / "x"), ["name", "v"])
    assert rows(delimited.read_contract(spark, str(tmp_path / "x"), Layout(("name", "v")))) == sorted(data, key=repr)


def test_rejects_keep_the_raw_line(spark, tmp_path, rows):
    p = put(tmp_path, "a.csv", "1;2\n3\n4;5;6\n")
    got = delimited.read_with_rejects(spark, p, ["a", "b"])
    assert sorted(r["rejected"] for r in got.filter("rejected IS NOT NULL").collect()) == ["3", "4;5;6"]


def test_observation_vintages(spark, rows):
    terr = spark.createDataFrame([("4100009", "Lagoa", "Paraná"), ("4200000", "Lagoa", "Santa Catarina")], "code string, name string, state string")
    annual = spark.createDataFrame([("f1", "2020-01-01 00:00:00", "1", "2", "LAGOA", "PARANA"), ("f2", "x", "1", "2", "Lagoa", "Bahia")],
                                   "foco_id string, data_pas string, lat string, lon string, municipio string, estado string")
    monthly = spark.createDataFrame([("m1", "2021-01-01 00:00:00", "1", "2", "4200000"), ("m2", "x", "1", "2", "999")],
                                    "id string, data_hora_gmt string, lat string, lon string, municipio_id string")
    assert rows(delimited.observation_dialects(annual, monthly, terr), "id", "code") == [("f1", "4100009"), ("m1", "4200000")]


def test_column_family(spark, rows):
    df = spark.createDataFrame([("t", 1, 2, 9)], "id string, FUN_CAT_1 int, MED_CAT_2 int, other int")
    assert rows(delimited.family_to_rows(df, ["id"], r"([A-Z]+)_CAT_(\d)", ["stage", "grp"])) == [
        ("t", "FUN_CAT_1", "FUN", "1", 1), ("t", "MED_CAT_2", "MED", "2", 2)]
    with pytest.raises(ContractError):
        delimited.family_to_rows(df, ["id"], r"ABS_(\d)", ["x"])


@pytest.fixture
def frame(tmp_path):
    """Files written to a folder, as Spark lists them."""
    def written(spark, files):
        for name, content in files.items():
            (tmp_path / name).write_bytes(content)
        return landing.listing(spark, str(tmp_path))
    return written


def test_workbook_with_merged_headers(spark, rows, frame):
    book = workbook_bytes([("Título",), ("Código", "UF", "Total", "", "Indústria", ""), ("", "", "2023", "2024", "2023", "2024"),
                           ("410940", "PR", "10", "11", "4", "5"), ("410001", "PR", "7", "8", "", "3")])
    cells = archives.workbook_cells(frame(spark, {"r.xlsx": book})).cache()
    got = archives.bind_headers(cells, ["Código", "UF"], depth=2).filter("name RLIKE '^[0-9]{4}$'")
    assert rows(got, "row", "group", "name", "text") == [
        (4, "Indústria", "2023", "4"), (4, "Indústria", "2024", "5"), (4, "Total", "2023", "10"), (4, "Total", "2024", "11"),
        (5, "Indústria", "2024", "3"), (5, "Total", "2023", "7"), (5, "Total", "2024", "8")]
    assert archives.locate_header(cells, ["Código", "Absent"]).count() == 0


def shared_workbook(sheets, texts):
    """A workbook of several sheets whose cells point into one table of texts."""
    b = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in texts) + "</sst>")
        for i, n in enumerate(sheets):
            body = "".join(f'<row r="{r}"><c r="AB{r}" t="s"><v>{k}</v></c><c r="AC{r}"><v>{r}</v></c></row>' for r, k in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return b.getvalue()


def test_every_sheet_is_a_unit_of_work(spark, frame):
    book = shared_workbook({"one": [0, 1], "two": [1] * 30_000, "none": []}, ["abc", "de"])
    got = archives.workbook_cells(frame(spark, {"r.xlsx": book})).withColumn("task", F.spark_partition_id()).where("col = 28").collect()
    assert sorted((r["sheet"], r["row"], r["text"]) for r in got if r["sheet"] == "one") == [("one", 1, "abc"), ("one", 2, "de")]
    assert sum(r["sheet"] == "two" for r in got) == 30_000
    assert len({(r["sheet"], r["task"]) for r in got}) == len({r["task"] for r in got}) == 2


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("_", "."), body)
    return b.getvalue()


def test_archive_rows_bind_by_name(spark, rows, frame):
    a, b = zipped(a_csv="x;y\r\n1;2\r\n"), zipped(b_csv="\ufeffy;x\r\n4;\"3;3\"\r\n")
    got = archives.archive_rows(frame(spark, {"a.zip": a, "b.zip": b}), ["x", "y"])
    assert rows(got, F.substring_index("path", "/", -1), "line", "x", "y") == [("a.zip", 1, "1", "2"), ("b.zip", 1, "3;3", "4")]


@pytest.mark.parametrize("content,why", [
    (zipped(a_csv="x;y\r\n1;2\r\n", b_csv="x;y\r\n1;2\r\n"), "2 members"), (zipped(a_txt="x;y"), "0 members"), (zipped(a_csv="x;z\r\n1;2\r\n"), "contract"),
    (zipped(a_csv="x;y;x\r\n1;2;3\r\n"), "contract"), (zipped(a_csv="x;y\r\n1\r\n"), "ragged"), (zipped(a_csv=""), "empty")])
def test_bad_archives_fail(spark, frame, content, why):
    with pytest.raises(Exception, match=why):
        archives.archive_rows(frame(spark, {"a.zip": content}), ["x", "y"]).collect()


def test_members_of_one_archive_are_read_by_several_tasks(spark, frame):
    body = "x;y\r\n" + "".join(f"{i};ção\r\n" for i in range(5000))
    archive = zipped(**{f"m{i}_csv": body.encode("cp1252") for i in range(4)})
    got = archives.archive_rows(frame(spark, {"a.zip": archive}), ["x", "y"], encoding="cp1252", members=None).withColumn("task", F.spark_partition_id())
    tasks = got.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"), F.min("task").alias("task"), F.max("y").alias("y")).collect()
    assert {(r["n"], r["last"], r["y"]) for r in tasks} == {(5000, 5000, "ção")} and len({r["task"] for r in tasks}) == 4


def test_an_archive_above_two_gigabytes_opens(spark, tmp_path, rows):
    """The archive starts behind a hole of 2.2 GB, which takes no disk; only its end is read."""
    with open(tmp_path / "a.zip", "wb") as f:
        f.truncate(2_200_000_000)
    with zipfile.ZipFile(tmp_path / "a.zip", "a") as z:
        z.writestr("a.csv", "x;y\r\n1;2\r\n")
    assert rows(archives.archive_rows(landing.listing(spark, str(tmp_path)), ["y", "x"]), "y", "x") == [("2", "1")]


def test_memory_for_a_member_does_not_grow_with_it(tmp_path):
    peaks = []
    for lines in (100_000, 1_000_000):
        with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.csv", "x;y\r\n" + "some words;others\r\n" * lines)
        most = seen = 0
        for batch in archives.member_batches(str(tmp_path / "a.zip"), "a.csv", ["x", "y"], ";", "utf8"):
            most, seen = max(most, pa.total_allocated_bytes()), seen + batch.num_rows
        assert seen == lines
        peaks.append(most)
    assert peaks[1] < 2 * peaks[0] + 10_000_000


CUBE = [{"id": "214", "variavel": "Produção", "unidade": "t", "resultados": [{
    "classificacoes": [{"id": "81", "nome": "Produto", "categoria": {"2713": "Soja"}}],
    "series": [{"localidade": {"id": "41", "nivel": {"id": "N3", "nome": "UF"}, "nome": "Paraná"},
                "serie": {"2019": "10", "2020": "-", "2021": "X", "2022": "..", "2023": "..."}}]}]}]


def test_cube_cells_keep_symbols(spark, rows):
    docs = spark.createDataFrame([(json.dumps(CUBE),)], "body string")
    got = nested.cube_cells(docs)
    assert rows(got, "period", "value", "status", "raw") == [
        ("2019", 10.0, "real", None), ("2020", 0.0, "real", "-"), ("2021", None, "suppressed", "X"),
        ("2022", None, "notApplicable", ".."), ("2023", None, "unavailable", "...")]
    assert got.select(nested.dims_key(F.col("dims"))).first()[0] == "81=2713"


def test_keyed_indicator_is_confirmed_by_its_parent(spark, rows):
    docs = spark.createDataFrame([(json.dumps([{"id": i, "res": [{"localidade": "410001", "res": {"2019": "5.5", "2020": "6.5", "2021": "..."}}]}]),) for i in (47001, 6)], "body string")
    unit = {"id": "R$", "multiplicador": 1}
    tree = spark.createDataFrame([(json.dumps([
        {"id": 47000, "indicador": "Per capita", "unidade": unit, "children": [{"id": 47001, "indicador": "Série revisada", "unidade": unit}]},
        {"id": 5, "indicador": "Outro", "children": [{"id": 6, "indicador": "Série revisada", "unidade": unit}]}]),)], "body string")
    ok = nested.confirmed_by_parent(nested.keyed_series(docs), tree, "Per capita", "R$")
    v = ok.withColumn("v", strict_number(F.col("published"))).filter("v IS NOT NULL")
    assert rows(nested.latest_published(v, F.col("v"))) == [(47001, "410001", "2020", 6.5)]


def test_geojson_incomplete_responses_are_marked(spark):
    f = {"geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"code": "a"}}
    bodies = [json.dumps({"features": [f]}), json.dumps({"features": [f], "exceededTransferLimit": True}), json.dumps({"error": "x"})]
    got = nested.geojson_features(spark.createDataFrame([(b,) for b in bodies], "body string"), "struct<code: string>")
    assert sorted(r["complete"] for r in got.collect()) == [False, False, True]
    p = got.filter("complete").select(nested.point_of(F.col("coordinates")).alias("p")).first()["p"]
    assert (p["x"], p["y"]) == (1.5, 2.5)


def test_links_of_official_hosts_newest_edition(spark, rows):
    html = ('<p><a href="/dados/censo_2022.zip">Censo 2022</a> <A class="x" HREF=\'https://other.org/dados/censo_2030.zip\'><b>Fake</b></A>'
            '<a href="/dados/censo_2023.zip?a=1&amp;b=2">Censo &amp; 2023</a></p>')
    links = landing.page_links(spark.createDataFrame([("https://stats.gov.br/p", html)], "page string, html string"))
    assert rows(links, "href", "label") == sorted([("/dados/censo_2022.zip", "Censo 2022"), ("https://other.org/dados/censo_2030.zip", "Fake"),
                                                   ("/dados/censo_2023.zip?a=1&b=2", "Censo & 2023")])
    full = links.withColumn("url", landing.absolute(F.col("page"), F.col("href")))
    ok = landing.official_links(full, r"^stats\.gov\.br$", r"censo_(20\d\d)\.zip$")
    assert rows(landing.newest_edition(ok.withColumn("k", F.lit("censo")), ["k"])) == [("censo", "2023", "https://stats.gov.br/dados/censo_2023.zip?a=1&b=2")]


def test_inventory_lists_only_changed_files(spark, tmp_path, rows):
    for n in ("a", "b"):
        (tmp_path / f"{n}.txt").write_text(n)
    before = landing.inventory(spark, str(tmp_path), "*.txt").collect()
    manifest = spark.createDataFrame(before)
    assert landing.changed_files(landing.inventory(spark, str(tmp_path), "*.txt"), manifest).isEmpty()
    assert landing.refreshed_manifest(spark, str(tmp_path), manifest, "*.txt").where("opened").isEmpty()
    # a new time alone opens the file again, but equal content is no change
    os.utime(tmp_path / "a.txt", (1, 1))
    again = landing.refreshed_manifest(spark, str(tmp_path), manifest, "*.txt").where("opened")
    assert again.count() == 1 and landing.changed_files(again, manifest).isEmpty()
    (tmp_path / "b.txt").write_text("B")
    changed = landing.changed_files(landing.inventory(spark, str(tmp_path), "*.txt"), manifest)
    assert [r["path"].rsplit("/", 1)[1] for r in changed.collect()] == ["b.txt"]


def test_a_manifest_refresh_opens_new_files_only(spark, tmp_path):
    """A known file whose bytes were exchanged under the same size and time keeps its hash: it was not opened."""
    folder = tmp_path / "in"
    folder.mkdir()
    for n in ("a", "b"):
        (folder / f"{n}.txt").write_text(n * 3_000_000)
    none = spark.createDataFrame([], landing.MANIFEST)
    first = landing.refreshed_manifest(spark, str(folder), none).cache()
    assert {(r["path"][-5:], r["sha256"], r["opened"]) for r in first.collect()} == {
        (f"{n}.txt", hashlib.sha256(n.encode() * 3_000_000).hexdigest(), True) for n in "ab"}
    at = os.stat(folder / "a.txt")
    (folder / "a.txt").write_text("x" * 3_000_000)
    os.utime(folder / "a.txt", ns=(at.st_atime_ns, at.st_mtime_ns))
    (folder / "c d.txt").write_text("new")
    (folder / "b.txt").unlink()
    again = landing.refreshed_manifest(spark, str(folder), first)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan  # the listing reads no content, and no list of paths goes back to the driver
    assert {(r["path"].rsplit("/", 1)[1], r["sha256"], r["opened"]) for r in again.collect()} == {
        ("a.txt", hashlib.sha256(b"a" * 3_000_000).hexdigest(), False), ("c d.txt", hashlib.sha256(b"new").hexdigest(), True)}
