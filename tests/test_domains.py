"""Subject areas on small authored inputs shaped like the publications."""

import csv
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from statmosaic.domains import cubes, education, employment, environment, health, social
from statmosaic.operators import mapping
from statmosaic.plans.base import workbook_bytes
from statmosaic.session import param_table
from statmosaic.sources import archives, landing, nested
from statmosaic.sources.delimited import ContractError

TERR = [("4100001", "A"), ("4100002", "B")]


@pytest.fixture
def terr(spark):
    return spark.createDataFrame(TERR, "territory string, name string")


def movement_file(tmp_path, kind, month, records):
    cols = list(employment.LAYOUTS[kind].columns)
    lines = [";".join(cols)] + [";".join(r.get(c, "") for c in cols) for r in records]
    d = tmp_path / kind
    d.mkdir(exist_ok=True)
    (d / f"{kind}{month}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(d)


def rec(month="202401", pub="202401", sign="1", typ="10", wage="2000,00", **extra):
    return {"competenciamov": month, "competenciadec": pub, "uf": "41", "municipio": "410000", "secao": "C", "subclasse": "111399", "saldomovimentacao": sign,
            "cbo2002ocupacao": "521110", "tipomovimentacao": typ, "salario": wage, "indtrabintermitente": "0", "indicadordeforadoprazo": "0", **extra}


def test_employment_publication(spark, tmp_path, terr, rows):
    on_time = [rec() for _ in range(6)] + [rec(sign="-1", typ="31", wage=""), rec(uf="42"), rec(cbo2002ocupacao="999999"), rec(wage="1,00")]
    late = [rec(month="202312", indicadordeforadoprazo="1")]
    gone = [rec(competenciaexc="202401", indicadordeexclusao="1", pub="202401"), rec(month="202312", sign="-1", typ="31", competenciaexc="202401", indicadordeexclusao="1")]
    raw = employment.read_movements(spark, {
        "MOV": movement_file(tmp_path, "MOV", "202401", on_time), "FOR": movement_file(tmp_path, "FOR", "202401", late), "EXC": movement_file(tmp_path, "EXC", "202401", gone)})
    assert raw.select("publication").distinct().collect()[0][0] == "202401"
    acts = param_table(spark, [("0111399", "Cultivo")], "code string, label string")
    jobs = param_table(spark, [("521110", "Vendedor")], "code string, label string")
    mins = param_table(spark, [("2024", 1412.0)], "year string, minimum double")
    typed = employment.movements(raw, acts, jobs, mins)
    assert typed.filter("problem IS NOT NULL").isEmpty()
    assert rows(employment.national(typed, "202401"), "admissions", "dismissals", "balance") == [(8, 1, 7)]
    walk = spark.createDataFrame([("410000", "41", "4100001")], "source_code string, state_code string, code string")
    here = mapping.in_territory(typed, walk, "source_code", "state_code")
    m = employment.monthly(here, terr, "202312", "202401").filter("territory = '4100001'")
    # the retraction of an unknown December dismissal is legal in the ledger
    assert rows(m, "month", "admissions", "dismissals", "balance", "salary_sample", "balance_ytd") == sorted(
        [("202312", 1, -1, 2, None, None), ("202401", 7, 1, 6, 6, 6)], key=repr)
    assert rows(m, "month", "balance_12m") == [("202312", None), ("202401", None)]
    assert rows(employment.finalization_problems(here, ["sector"]), "month", "axis") == [("202312", "sector"), ("202312", "total")]
    jan = here.filter("month = '202401'")
    got = employment.protected_breakdown(jan, "occupation")
    assert rows(got, "occupation", "admissions", "dismissals", "privacy") == [(None, None, None, "suppressed")]
    assert employment.sector_series(here, terr, "202312", "202401").count() == 2 * 2 * 5


def test_series_from_an_additive_ledger_are_those_of_the_movements(spark, terr, rows):
    schema = "territory string, month string, publication string, sector string, sign int, weight int, salary decimal(18,2), wage_eligible boolean"
    moves = spark.createDataFrame([
        (f"410000{1 + i % 2}", "202312" if i % 3 else "202401", "202401" if i % 5 else "202402", ["industry", "commerce", None][i % 3], 1 if i % 4 else -1,
         -1 if i % 7 == 0 else 1, D(i) / 3 if i % 6 else None, i % 4 > 1) for i in range(90)], schema)
    ledger = employment.additive_ledger(moves, ["publication", "territory", "month", "sector"])
    for known in ("publication <= '202401'", "publication IS NOT NULL"):
        for series in (employment.monthly, employment.sector_series):
            assert rows(series(ledger.where(known), terr, "202312", "202402", additive=True)) == rows(series(moves.where(known), terr, "202312", "202402"))


def test_refresh_keeps_sums_of_the_records_not_the_records(spark, tmp_path, rows, monkeypatch):
    from datetime import datetime

    from statmosaic.operators.quality import GateFailure
    from statmosaic.plans import subjects

    def put(name, data, schema):
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))

    put("region", [(0, "R")], "r_regionkey long, r_name string")
    put("nation", [(3, "N", 0)], "n_nationkey long, n_name string, n_regionkey long")
    put("customer", [(1, 3, "BUILDING")], "c_custkey long, c_nationkey long, c_mktsegment string")
    orders = [(k, 1, datetime(1997, m, 10), "F", "1-URGENT", 10.0) for k, m in ((1, 5), (2, 8))]
    put("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string, o_totalprice double")
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double"
    may = datetime(1997, 5, 20)
    # on time in May, one of them taken back; late ones that became known in August
    lines = [(1, 2, 1, 1, "F", "N", may, 100.0 + i, 1.0) for i in range(100)] + [(1, 1, 1, 1, "F", "A", may, 100.0, 1.0)]
    lines += [(2, 2, 1, 1, "O", "N", may, 100.0, 1.0) for _ in range(50)]
    put("lineitem", lines, line)
    kept = {}

    def spy(df, name, own=subjects.materialize):
        out = own(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(subjects, "materialize", spy)
    out = subjects.employment_refresh(spark, str(tmp_path))
    assert rows(out) == [("N", "199705", 149, 0, 99, 0, "2", "FOR 1|MOV 1")]
    assert kept == {"movement-texts": 151, "movements": 3}
    # a record that breaks a rule still refuses the whole refresh
    put("lineitem", [*lines, (1, 2, 1, 1, "F", None, None, 100.0, 1.0)], line)
    with pytest.raises(GateFailure, match="record .*unreadable month"):
        subjects.employment_refresh(spark, str(tmp_path))


def test_wrong_movement_files_are_named(spark, tmp_path):
    raw = employment.read_movements(spark, {"MOV": movement_file(tmp_path, "MOV", "202401", [
        rec(month="202312"), rec(sign="-1", typ="10"), rec(secao="Z"), rec(subclasse="x"), rec()])})
    d = param_table(spark, [("0111399", "x")], "code string, label string")
    j = param_table(spark, [("521110", "x")], "code string, label string")
    typed = employment.movements(raw, d, j, param_table(spark, [("2024", 1.0)], "year string, minimum double"))
    assert sorted(r["problem"] or "" for r in typed.collect()) == ["", "malformed", "not on time", "sign against movement type", "unknown section"]


def test_stock_workbook_and_shares(spark, rows, tmp_path):
    book = workbook_bytes([("Tabela 4",), ("Código", "UF", "Indústria", "", "Serviços", "", "Total", ""), ("", "", "2023", "2024", "2023", "2024", "2023", "2024"),
                           ("410000", "PR", "3", "4", "1", "1", "4", "6")])
    (tmp_path / "r.xlsx").write_bytes(book)
    cells = archives.workbook_cells(landing.listing(spark, str(tmp_path))).cache()
    t = employment.stock_table(archives.bind_headers(cells, ["Código", "UF"], 2), {"Indústria": "industry", "Serviços": "services", "Total": "total"})
    s = employment.stock_shares(t.withColumn("territory", F.col("source_code")))
    assert rows(s, "year", "sector", "value", "total", "percent", "balanced") == [
        ("2023", "industry", 3, 4, 75.0, True), ("2023", "services", 1, 4, 25.0, True), ("2024", "industry", 4, 6, pytest.approx(66.666, abs=1e-2), False),
        ("2024", "services", 1, 6, pytest.approx(16.666, abs=1e-2), False)]


def test_stock_remuneration(spark, rows):
    data = [("t", "1", "0", 10, 100.0)] * 5 + [("t", "1", "0", 10, 0.0), ("t", "1", "1", 10, 9.0), ("t", "0", "0", 10, 9.0), ("t", "1", "0", 50, 50.0)]
    df = spark.createDataFrame(data, "territory string, act string, ab string, div int, w double")
    got = employment.stock_remuneration(df, "act", "ab", F.col("div"), F.col("w"))
    assert rows(got, "sector", "stock", "sample", "missing_or_zero", "mean") == sorted([
        ("Total", 7, 6, 1, 550.0 / 6), ("industry", 6, 5, 1, 100.0), ("services", 1, None, None, None)], key=repr)


SCHOOL = ["CO_ENTIDADE", "CO_MUNICIPIO", "NU_ANO_CENSO", "TP_DEPENDENCIA", "TP_LOCALIZACAO", "TP_SITUACAO_FUNCIONAMENTO", "IN_REGULAR", "QT_MAT_BAS", "QT_MAT_INF",
          "QT_MAT_INF_CRE", "QT_MAT_INF_PRE", "QT_TUR_BAS", "IN_BIBLIOTECA", "IN_SALA_LEITURA", "IN_ACESSIBILIDADE_INEXISTENTE"]
SCHOOLS = [
    ("41000001", "A", "2025", "2", "1", "1", "1", "100", "30", "10", "20", "5", "0", "1", "0"), ("41000001", "A", "2025", "2", "1", "1", "1", "100", "30", "10", "20", "5", "0", "1", "0"),
    ("41000002", "A", "2025", "3", "2", "1", "1", "50", "9", "4", "6", None, "0", None, "1"), ("41000003", "A", "2025", "3", "1", "1", "1", None, None, None, None, None, "0", "0", None),
    ("41000004", "A", "2025", "9", "1", "2", "0", None, None, None, None, None, None, None, None)]


def test_school_census(spark, rows):
    typed = education.schools(spark.createDataFrame(SCHOOLS, ", ".join(f"{c} string" for c in SCHOOL)))
    assert typed.count() == 4
    assert rows(education.school_violations(typed), "gate", "key") == [("declared without measure", "41000003"), ("network", "41000004")]
    s = education.series(typed)
    assert rows(s, "network", "active_schools", "total", "classes", "schools_rural") == sorted([
        ("Estadual", 1, 100, 5, 0), ("Municipal", 1, 50, None, 1), ("Total", 2, 150, None, 1)], key=repr)
    assert rows(education.stage_violations(s), "gate", "key") == [("infant = nursery + preschool", "A|2025|Municipal"), ("infant = nursery + preschool", "A|2025|Total")]
    infra = education.infrastructure(typed).filter("network = 'Total'")
    assert rows(infra.filter("resource IN ('library', 'accessibility', 'water')"), "resource", "with_resource", "considered", "missing", "percent") == [
        ("accessibility", 1, 2, 0, 50.0), ("library", 1, 1, 1, 100.0), ("water", 0, 0, 2, None)]
    controls = spark.createDataFrame([("A", "2025", "Total", "enrolments", 150), ("A", "2025", "Total", "schools", 3), ("A", "2025", "Total", "classes", 7)],
                                     "territory string, year string, network string, kind string, value bigint")
    assert rows(education.reconciled(s, controls), "kind", "status") == [("classes", "missing"), ("enrolments", "matched"), ("schools", "mismatch")]


def test_indicator_sheets(spark, rows):
    df = spark.createDataFrame([("A", "Urbana", "Total - Estadual e Municipal", "12,5", "--"), ("A", "Rural", "Privada", "101", "3")], "t string, loc string, net string, FUN_CAT_1 string, MED_CAT_2 string")
    got = education.indicators(df, ["t", "loc", "net"], r"(FUN|MED)_CAT_(\d)", ["stage", "grp"], "%", 100.0, "net")
    assert rows(got, "net", "stage", "value", "error") == sorted([
        ("Estadual e Municipal", "FUN", D("12.5000"), None), ("Estadual e Municipal", "MED", None, None), ("Privada", "FUN", None, "above limit"), ("Privada", "MED", D("3.0000"), None)], key=repr)


UNIT = "CO_IBGE string, CO_UF string, CO_CNES string, NO_FANTASIA string, TP_UNIDADE string, TP_GESTAO string, CO_NATUREZA_JUR string, CO_MOTIVO_DESAB string, CO_AMBULATORIAL_SUS string, NU_LATITUDE string, NU_LONGITUDE string, RUA string, NUM string"


def test_health_registry(spark, rows):
    walk = spark.createDataFrame([("410000", "41", "4100001")], "source_code string, state_code string, code string")
    types = param_table(spark, [("02", "Posto"), ("05", "Hospital")], "code string, label string")
    raw = spark.createDataFrame([
        ("410000", "41", "12", "U1", "2", "M", "1244", "", "SIM", "5", "5", "Rua A", " "), ("410000", "41", "12", "U1", "2", "M", "1244", "", "SIM", "5", "5", "Rua A", " "),
        ("410000", "41", "13", "U2", "05.0", "", "2038", "", "", "0", "0", "Rua B", "7"), ("410000", "41", "14", "U3", "5", "E", "2062", "03", "NAO", "x", "5", None, None),
        ("410000", "42", "15", "U4", "2", "M", "1244", "", "NAO", "50", "5", None, None), ("410000", "41", "16", " ", "77", "M", "9", "", "NAO", "50", "5", None, None), ("999999", "41", "9", "no", "2", "M", "", "", "", "", "", "", "")], UNIT)
    u = health.registry(raw, walk, types, ["RUA", "NUM"])
    assert rows(u, "unit", "label", "ownership", "management", "active", "ambulatory", "latitude", "address") == sorted([
        ("0000012", "Posto", "Pública", "Municipal", True, True, 5.0, "Rua A"), ("0000013", "Hospital", "Economia mista", "Não informada", True, None, None, "Rua B, 7"),
        ("0000014", "Hospital", "Privada", "Estadual", False, False, None, ""), ("0000015", "Posto", "Pública", "Municipal", True, False, 50.0, ""),
        ("0000016", None, "Não informada", "Municipal", True, False, 50.0, "")], key=repr)
    assert rows(health.violations(u), "gate", "key") == sorted([("legal nature", "4100001|0000016"), ("named", "4100001|0000016"), ("state agrees", "4100001|0000015"), ("type known", "4100001|0000016")])
    s = health.summary(u.filter("state_ok AND label IS NOT NULL"))
    assert rows(s) == [("4100001", 3, 2, 1, 1, 0, 1, 100.0)]
    assert [r["n"] for r in health.groups(u, "ownership").collect()] == [2, 1, 1]
    shape = spark.createDataFrame([("4100001", [[[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0], [0.0, 0.0]]]])], "territory string, geometry array<array<array<array<double>>>>")
    assert rows(health.mappable(u, shape)) == [("4100001", "0000012")]


def test_beds_confirm_zero_only_for_months_in_the_file(spark, terr, rows):
    walk = spark.createDataFrame([("410000", "PR", "4100001"), ("410001", "PR", "4100002")], "source_code string, state_code string, code string")
    raw = spark.createDataFrame([("410000", "PR", "202401", "7", "", "10", "8", "2", "1"), ("410000", "PR", "202401", "8", "", "5", "6", "0", "0"), ("999999", "PR", "202402", "9", "", "1", "1", "0", "0"),
                                 ("410001", "PR", "202401", "3", "X", "9", "9", "9", "9")],
                                "CO_IBGE string, UF string, COMP string, CNES string, MOTIVO_DESABILITACAO string, LEITOS_EXISTENTES string, LEITOS_SUS string, UTI_TOTAL_EXIST string, UTI_TOTAL_SUS string")
    b = health.beds(raw, walk)
    assert rows(health.bed_violations(b), "gate", "key") == [("public within all", "4100001|202401|0000008")]
    assert health.months_in(raw) == ["202401", "202402"]
    assert rows(health.bed_series(b, health.months_in(raw), terr), "territory", "month", "existing", "units", "zero_confirmed") == [
        ("4100001", "202401", 15, 2, False), ("4100001", "202402", 0, 0, True), ("4100002", "202401", 0, 0, True), ("4100002", "202402", 0, 0, True)]


CELL = "territory string, variable string, period string, dims map<string,string>, unit string, value double, status string"


def cell(spark, *data):
    return spark.createDataFrame([(t, v, p, d, u, x, "real" if x is not None else "suppressed") for t, v, p, d, u, x in data], CELL)


def test_population_blocks(spark, rows):
    c = cell(spark, *[("t", "93", "2022", {"age": a, "sex": s}, "Pessoas", x) for a, s, x in (
        ("1", "M", 10.0), ("1", "F", 12.0), ("1", "T", 22.0), ("2", "M", 5.0), ("2", "F", 5.0), ("2", "T", 11.0), ("9", "T", 99.0))])
    b = param_table(spark, [("1", "0–4"), ("2", "5–9")], "category string, band string")
    assert rows(cubes.age_bands(c, "age", "sex", b, "M", "F", "T"), "band", "male", "female", "total", "balanced") == [("0–4", 10.0, 12.0, 22.0, True), ("5–9", 5.0, 5.0, 11.0, False)]
    s = cell(spark, *[("t", "93", "2022", {"s": k}, "Pessoas", x) for k, x in (("0", 40.0), ("1", 30.0), ("2", 10.0))])
    assert rows(cubes.shares(s, "s", "0"), "category", "percent", "balanced") == [("1", 75.0, True), ("2", 25.0, True)]
    g = cell(spark, ("t", "93", "2022", {}, "Pessoas", 110.0), ("t", "5936", "2022", {}, "Pessoas", 10.0), ("u", "93", "2022", {}, "Pessoas", 5.0), ("u", "5936", "2022", {}, "Pessoas", 5.0))
    assert rows(cubes.growth(g, "93", "5936"), "territory", "base", "growth") == [("t", 100.0, 10.0), ("u", 0.0, None)]
    h = cubes.history(cell(spark, ("t", "93", "2010", {}, "", 1.0), ("t", "93", "2000", {}, "", None)), cell(spark, ("t", "9324", "2010", {}, "", 2.0)))
    assert rows(h, "period", "value", "methodology") == [("2010", 1.0, "census"), ("2010", 2.0, "estimate")]


def test_economy_blocks(spark, rows):
    raw = cell(spark, *[("t", v, p, {}, "Mil Reais", x) for v, p, x in (
        ("37", "2019", 100.0), ("37", "2020", 110.0), ("37", "2022", 99.0), ("498", "2019", 90.0), ("543", "2019", 5.0), ("513", "2019", 60.0), ("517", "2019", 30.0), ("513", "2020", None), ("517", "2020", 1.0))],
        ("t", "516", "2019", {}, "%", 66.7), ("t", "520", "2019", {}, "%", 33.3))
    f = {"Mil Reais": ("R$", 1000)}
    c = cubes.base_currency(raw, f)
    got = [(r["period"], r["value"], None if r["change"] is None else round(r["change"], 6), r["annual"]) for r in cubes.product_series(c, "37").orderBy("period").collect()]
    assert got == [("2019", 100000.0, None, False), ("2020", 110000.0, 10.0, True), ("2022", 99000.0, -10.0, False)]
    comp = cubes.composition(c, {"agriculture": ("513", "516"), "industry": ("517", "520")})
    assert rows(cubes.leading_sector(comp)) == [("t", "2019", "agriculture", 66.7)]
    assert rows(cubes.opening_violations(c, ["513", "517"], []), "key", "detail") == [("t|2020", "partial opening")]
    assert rows(cubes.tax_share(c, "543", "37"), "period", "ratio") == [("2019", 5.0)]
    assert rows(cubes.account_violations(c, "37", "498", "543", ["513", "517"]), "gate", "key") == [("product", "t|2019")]
    s = spark.createDataFrame([("t", "gdp", "R$", "m", "2020", 1.0), ("u", "gdp", "R$", "m", "2020", 2.0), ("w", "gdp", "R$", "m", "2019", 3.0)], "territory string, indicator string, unit string, methodology string, period string, value double")
    assert rows(cubes.compared(s, "t"), "territory", "comparable", "peer_value") == [("u", True, 2.0), ("w", False, None)]


def test_agriculture_blocks(spark, rows):
    c = cell(spark, *[("t", v, p, {"81": k}, u, x) for v, p, k, u, x in (
        ("215", "2021", "1", "Mil Reais", 10.0), ("215", "2022", "1", "Mil Reais", 15.0), ("215", "2022", "2", "Mil Reais", None), ("215", "2022", "3", "Mil Reais", 0.0), ("215", "2022", "0", "Mil Reais", 99.0),
        ("214", "2021", "1", "kg", 5.0), ("214", "2022", "1", "t", 6.0))])
    f = {"Mil Reais": ("R$", 1000)}
    p = cubes.products(c, "81", {"215": "value", "214": "quantity"}, f)
    assert rows(p.filter("product = '1'"), "metric", "period", "value", "annual_change") == sorted([
        ("value", "2021", 10000.0, None), ("value", "2022", 15000.0, 50.0), ("quantity", "2021", 5.0, None), ("quantity", "2022", 6.0, None)], key=repr)
    assert rows(cubes.present(p, "2022"), "product", "present_latest") == [("0", True), ("1", True), ("2", True), ("3", False)]
    names = param_table(spark, [("0", "Total"), ("1", "Soja"), ("2", "Mate"), ("3", "Uva")], "product string, name string")
    assert rows(cubes.ranked(p, names, "value", "2022"), "position", "name", "value") == [(1, "Soja", 15000.0), (2, "Mate", None)]
    milk = cubes.per_animal(cell(spark, ("t", "106", "2022", {}, "Mil litros", 30.0)), cell(spark, ("t", "107", "2022", {}, "Cabeças", 10.0), ("t", "107", "2021", {}, "Cabeças", 10.0)))
    assert rows(milk, "period", "ratio") == [("2022", 3000.0)]
    typ = cell(spark, *[("t", "183", "2017", {"829": k}, "Unidades", x) for k, x in (("T", 100.0), ("F", 70.0), ("N", 27.0))])
    assert rows(cubes.typology_violations(typ, "829", "T", ["F", "N"]), "key") == [("t|183|2017",)]
    p = p.withColumn("state", F.lit("S"))
    state = p.filter("product = '1'").select("state", "product", "metric", F.lit("t").alias("unit"), "period", (F.col("value") * 2).alias("value"))
    assert rows(cubes.state_share(p.filter("metric = 'quantity'"), state), "period", "ratio") == [("2022", 50.0)]
    assert cubes.state_share(p.filter("metric = 'quantity'"), state.withColumn("state", F.lit("other"))).isEmpty()


def test_cube_and_social_blocks_share_the_cell_shape(spark):
    body = '[{"id":"93","variavel":"População","unidade":"Pessoas","resultados":[{"classificacoes":[],"series":[{"localidade":{"id":"1","nivel":{"id":"N6"}},"serie":{"2022":"5"}}]}]}]'
    got = cubes.pick(nested.cube_cells(spark.createDataFrame([(body,)], "body string")), "93").first()
    assert (got["territory"], got["value"]) == ("1", 5.0)


def social_row(code, month, **over):
    base = {**{f: "100" for f in social.REGISTRY.values()}, **{f: "10" for f in social.BENEFIT.values()}, **{f: "50" for f in social.TRANSFER.values()}}
    base.update({social.REGISTRY[k]: v for k, v in (("families", "300"), ("people", "300"), ("updated", "150"), ("updatedPercent", "50.00"))})
    base.update({social.BENEFIT["total"]: "20", social.BENEFIT["transferredValue"]: "20.00"})
    base.update(over)
    return {"codigo_ibge": code, "anomes_s": month, **base}


def social_frame(spark, *data):
    cols = list(data[0])
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in data], ", ".join(f"{c} string" for c in cols))


def test_social_blocks(spark, rows):
    r, b = social.REGISTRY, social.BENEFIT
    raw = social_frame(
        spark, social_row("410000", "202301"), social_row("410000", "202404"), social_row("410000", "202406", **{r["povertyFamilies"]: "3", r["lowIncomeFamilies"]: "197", r["updated"]: "297", r["updatedPercent"]: "99.00"}),
        social_row("410000", "202407", **{r["people"]: None}))
    assert rows(social.latest_month(raw, r)) == [("410000", "202406")]
    reg = social.block(raw, r)
    assert sorted({x["month"] for x in reg.collect()}) == ["202404", "202406"]
    p = social.protect_income(reg).filter("month = '202406'")
    assert rows(p.filter("measure LIKE '%Families'"), "measure", "status") == [("aboveHalfFamilies", "suppressed"), ("lowIncomeFamilies", "suppressed"), ("povertyFamilies", "suppressed")]
    assert rows(p.filter("measure LIKE '%People'"), "status") == [("real",)] * 3
    q = social.registration_quality(reg)
    assert rows(q.filter("month = '202406'"), "measure", "value", "status") == sorted([(m, None, "suppressed") for m in ("updated", "updatedPercent", "notUpdated")], key=repr)
    assert rows(q.filter("month = '202404'"), "measure", "value", "status") == sorted([("updated", D("150.00"), "real"), ("updatedPercent", D("50.00"), "real"), ("notUpdated", D("150.00"), "derived")], key=repr)
    ben = social.protect_benefit(social.block(social_frame(
        spark, social_row("410000", "202405", **{b["elderly"]: None}), social_row("410000", "202406", **{b["elderly"]: "2", b["disabled"]: "18"}), social_row("410000", "202407")), b, whole_rows=True))
    assert rows(ben.filter("month = '202406'"), "value", "status") == [(None, "suppressed")] * 6
    assert rows(ben.filter("month = '202405'"), "value", "status") == [(None, "unavailable")] * 6
    assert rows(ben.filter("month = '202407' AND measure = 'transferredValue'"), "value", "unit") == [(D("20.00"), "R$")]


def test_social_identities(spark, rows):
    r, b = social.REGISTRY, social.BENEFIT
    raw = social_frame(spark, social_row("1", "202401"), social_row("2", "202401", **{r["povertyPeople"]: "99"}), social_row("3", "202401", **{b["transferredValue"]: "20.02"}), social_row("4", "202401", **{r["updatedPercent"]: "51.00"}))
    assert rows(social.violations(raw), "gate", "key") == [("b_transferredValue parts", "3|202401"), ("people parts", "2|202401"), ("rate", "4|202401")]


def test_social_rates_and_services(spark, terr, rows):
    people = spark.createDataFrame([("t", "202406", D("50.00")), ("u", "202406", None)], "territory string, month string, value decimal(18,2)")
    pop = spark.createDataFrame([("t", "2024", 200), ("u", "2023", 100)], "territory string, year string, population bigint")
    assert rows(social.per_hundred(people, pop), "territory", "per_100") == sorted([("t", 25.0), ("u", None)], key=repr)
    forms = spark.createDataFrame([("4100001", "1", "5", "1", "2"), ("4100001", "1", "7", "1", None)], "territory string, mes string, a1 string, a2 string, c1 string")
    s = social.service_months(forms, terr, "2025")
    assert s.count() == 24
    assert rows(s.filter("month = '202501'"), "territory", "reporting_units", "a1", "c1") == sorted([("4100001", 2, 12, None), ("4100002", 0, None, None)], key=repr)


def test_environment_land(spark, rows):
    wide = spark.createDataFrame([("t", "b1", 3, 40.0, 30.0), ("t", "b2", 3, 10.0, 10.0), ("t", "b1", 9, 20.0, 25.0), ("t", "b1", 39, 30.0, 33.0), ("t", "b1", 99, 0.0, 5.0)],
                                 "territory string, biome string, class int, y2022 double, y2023 double")
    legend = param_table(spark, [(3, "1.1.", "Floresta"), (9, "3.3.", "Silvicultura"), (39, "3.2.1.1.", "Soja")], "class int, path string, label string")
    panel = environment.land_cover(wide, legend, spark.createDataFrame([("t", 1.0)], "territory string, km2 double"))
    assert rows(panel.filter("class = 3"), "year", "ha", "share") == [("2022", 50.0, 50.0), ("2023", 40.0, 40.0)]
    assert rows(environment.land_violations(panel), "gate", "key") == [("legend", "t|99"), ("legend", "t|99"), ("mapped area", "t|2023")]
    h = environment.land_history(panel)
    assert rows(h, "year", "native", "forest", "farming", "farming_without_plantation", "agriculture", "plantation") == [
        ("2022", 50.0, 50.0, 50.0, 30.0, 30.0, 20.0), ("2023", 40.0, 40.0, 58.0, 33.0, 33.0, 25.0)]
    assert environment.land_change(h, "native", "2022", "2023").first()["difference"] == -10.0


def test_environment_fires(spark, terr, rows):
    obs = spark.createDataFrame([
        ("a", "4100001", "2023-01-05 00:00:00", "2023"), ("a", "4100001", "2023-01-05 00:00:00", "202301"), ("x", "4100001", "2023-02-01 00:00:00", "202302"),
        ("b", "4100001", "2024-01-05 00:00:00", "202401"), ("b", "4100001", "2024-01-05 00:00:00", "202402"), ("c", "4100002", "2024-02-05 00:00:00", "202402"), ("c", "4100001", "2024-02-05 00:00:00", "202402")],
        "id string, territory string, observed_at string, reference string")
    d = environment.detections(obs)
    assert rows(d, "id", "copies", "conflict") == [("a", 1, False), ("b", 2, False), ("c", 2, True)]
    cov = environment.coverage(spark.createDataFrame([("2023",), ("202401",), ("202402",)], "reference string"))
    assert cov.count() == 14
    m = environment.fire_months(d.filter("NOT conflict"), cov, terr, "202301", "202412")
    area = spark.createDataFrame([("4100001", 500.0), ("4100002", 100.0)], "territory string, km2 double")
    assert rows(environment.fire_years(m, area, "2024")) == sorted([
        ("4100001", "2023", 1, 12, True, 2.0), ("4100001", "2024", 1, 2, False, 2.0), ("4100002", "2023", 0, 12, True, 0.0), ("4100002", "2024", 0, 2, False, 0.0)], key=repr)


GEOM = "array<array<array<array<double>>>>"


def square(x0, y0, x1, y1):
    return [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]


def test_environment_places(spark, rows):
    b = spark.createDataFrame([("t", square(-51.2, -25.2, -51.0, -25.0))], f"territory string, geometry {GEOM}")
    centers = spark.createDataFrame([("t", -25.1, -51.1)], "territory string, clat double, clon double")
    pts = spark.createDataFrame([("1", -25.1, -51.1), ("2", -25.0, -51.1), ("3", -25.3, -51.1), ("4", -25.35, -51.1), ("5", -27.0, -51.1)], "code string, lat double, lon double")
    s = environment.stations(pts, b, centers, k=1)
    assert rows(s, "code", "location") == [("00000001", "inside"), ("00000002", "inside"), ("00000003", "regional")]
    units = spark.createDataFrame([("u", square(0.0, 0.0, 3.0, 3.0)), ("v", square(2.0, 0.0, 5.0, 3.0))], f"unit string, geometry {GEOM}")
    plane = spark.createDataFrame([("t", square(0.0, 0.0, 4.0, 4.0))], f"territory string, geometry {GEOM}")
    parts, union = environment.protected_areas(units, plane, 0.5)
    assert rows(parts, "unit", "area") == [("u", 9.0), ("v", 6.0)]
    assert rows(union, "union_area", "sum_of_parts", "share") == [(12.0, 15.0, 75.0)]
    named = environment.listed_in(spark.createDataFrame([("Serra (PR) - Lagoa (PR)",), ("Novalagoa (PR)",)], "m string"), "m", "LAGOA", "PR")
    assert sorted(r["listed"] for r in named.collect()) == [False, True]


def stock_file(tmp_path, records, reverse=False, rename=None):
    """Stock microdata of 2025; columns that a record does not name are empty."""
    cols = list(employment.STOCK_LAYOUTS["2025"].columns)
    names = {"code": "Município - Código", "active": "Ind Vínculo Ativo 31/12 - Código", "gone": "Ind Vínculo Abandonado - Código", "wage": "Vl Rem Dezembro Nom", "cls": "CNAE 2.0 Classe - Código"}
    lines = [[(rename or {}).get(c, c) for c in cols]] + [[{names[k]: v for k, v in r.items()}.get(c, "") for c in cols] for r in records]
    with open(tmp_path / f"stock{reverse}{bool(rename)}.csv", "w", encoding="cp1252", newline="") as f:
        csv.writer(f).writerows(x[::-1] if reverse else x for x in lines)
    return str(tmp_path / f"stock{reverse}{bool(rename)}.csv")


def bond(active="1", gone="0", wage="1000,50", cls="10112", code="410000"):
    return {"code": code, "active": active, "gone": gone, "wage": wage, "cls": cls}


def test_stock_microdata_by_edition(spark, tmp_path, rows):
    kept = [bond() for _ in range(5)] + [bond(wage="0,00")]
    left_out = [bond(active="0", wage="999999999,00"), bond(gone="1", wage="999999999,00")]
    path = stock_file(tmp_path, kept + left_out)
    records = employment.stock_records(employment.read_stock(spark, path, "2025")).withColumn("territory", F.lit("t"))
    assert records.filter("problem IS NOT NULL").isEmpty()
    out = employment.stock_remuneration(records, "active", "abandoned", F.col("division"), F.col("wage"))
    assert rows(out.filter("sector = 'industry'"), "stock", "sample", "mean") == [(6, 5, 1000.5)]
    # columns are bound by name, in any order; another edition or column fails before any value is read
    turned = employment.read_stock(spark, stock_file(tmp_path, kept + left_out, reverse=True), "2025")
    assert rows(turned) == rows(employment.read_stock(spark, path, "2025"))
    with pytest.raises(ContractError, match="no layout for edition 2026"):
        employment.read_stock(spark, path, "2026")
    with pytest.raises(ContractError, match="vlremdezembronom"):
        employment.read_stock(spark, stock_file(tmp_path, kept, rename={"Vl Rem Dezembro Nom": "Renda média"}), "2025")
    computed = out.filter("sector <> 'Total'").select("territory", "sector", "stock")
    assert employment.stock_disagreements(computed, computed).isEmpty()
    assert rows(employment.stock_disagreements(computed, computed.withColumn("stock", F.col("stock") + 1)), "key", "detail") == [("t|industry", "mismatch 6 7")]


@pytest.mark.parametrize("record,why", [
    (bond(active="2"), "invalid flag"), (bond(gone=""), "invalid flag"), (bond(wage="-1,00"), "negative wage"), (bond(cls="44000"), "unknown division")])
def test_stock_records_that_refuse_the_edition(spark, tmp_path, record, why):
    records = employment.stock_records(employment.read_stock(spark, stock_file(tmp_path, [record]), "2025"))
    assert [r["problem"] for r in records.collect()] == [why]


def unit_frame(spark, *answers):
    base = {"ibge7": "4100001", "ibge": "410000", "uf": "PR", "nu_identificador": "17", "q0_1": " House ", "q0_2": "Street", "q0_3": "5", "q0_4": " ", "q0_6": "Centre", "q12_13": "Sim", "q12_3": "Sim"}
    return spark.createDataFrame([{**base, **a} for a in answers], ", ".join(f"{c} string" for c in base))


def test_institutional_units(spark, rows):
    places = spark.createDataFrame([("4100001", ["PR", "Paraná"])], "territory string, states array<string>")
    units = social.institutional_units(unit_frame(spark, {}, {}, {"ibge7": "9900001", "ibge": "990000"}, {"nu_identificador": "9", "q12_13": "Não", "uf": "Paraná"}), places, "cras", "2025")
    assert rows(units, "unit", "name", "address", "services", "copies", "problem") == sorted([
        ("17", "House", "Street, 5, Centre", ["PAIF"], 2, None), ("9", "House", "Street, 5, Centre", [], 1, None)], key=repr)
    assert social.unit_violations(units).isEmpty()
    assert social.institutional_units(unit_frame(spark, {}), places, "creas", "2025").first()["services"] == ["PAEFI"]
    assert social.institutional_units(unit_frame(spark, {}), places, "other", "2025").first()["services"] == []
    with pytest.raises(ContractError, match="no dictionary of services for edition 2026"):
        social.institutional_units(unit_frame(spark, {}), places, "cras", "2026")


@pytest.mark.parametrize("answers,why", [
    ([{}, {"q0_1": "Other"}], "differing answers"), ([{"uf": "SC"}], "codes or state disagree"), ([{"ibge": "410009"}], "codes or state disagree"),
    ([{"ibge7": ""}], "no confirmed code"), ([{"nu_identificador": ""}], "no identifier"), ([{"nu_identificador": "1a"}], "no identifier"), ([{"q0_1": " "}], "no name")])
def test_unit_answers_that_refuse_the_edition(spark, answers, why):
    places = spark.createDataFrame([("4100001", ["PR", "Paraná"])], "territory string, states array<string>")
    assert [r["detail"] for r in social.unit_violations(social.institutional_units(unit_frame(spark, *answers), places, "cras", "2025")).collect()] == [why]
