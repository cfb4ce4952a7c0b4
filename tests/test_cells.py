from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from statmosaic.functions import cells, documents, present
from statmosaic.operators import mapping


def one(spark, col, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,dash,expected", [
    ("-", "zero", (0.0, "real", "-")), ("-", "missing", (None, "unavailable", "-")), ("X", "zero", (None, "suppressed", "X")),
    ("..", "zero", (None, "notApplicable", "..")), ("...", "zero", (None, "unavailable", "...")), (" 5 ", "zero", (5.0, "real", None)),
    ("NaN", "zero", (None, "invalid", None)), ("inf", "zero", (None, "invalid", None)), ("1,5", "zero", (None, "invalid", None)),
    ("1d", "zero", (None, "invalid", None)), ("1e999", "zero", (None, "invalid", None)), ("", "zero", (None, "unavailable", None)),
    (None, "zero", (None, "unavailable", None)), ("-3", "zero", (-3.0, "real", None)), ("2.5e3", "zero", (2500.0, "real", None)),
])
def test_symbols_keep_absence_apart_from_zero(spark, raw, dash, expected):
    got = one(spark, cells.decode_symbol(F.col("r"), dash), r=("string", raw))
    assert (got["value"], got["status"], got["raw"]) == expected


def test_number_rules_per_source(spark, rows):
    df = spark.createDataFrame([("1,5",), ("ND",), ("-1",), ("101",), ("abc",), (" 7 ",), (None,), ("inf",), ("",)], "raw string")
    comma = cells.with_number(df, "raw", missing=["ND"], comma=True, upper=100.0)
    assert rows(comma) == sorted([
        ("1,5", None, D("1.5000")), ("ND", None, None), ("-1", "negative", None), ("101", "above limit", None), ("abc", "not a number", None),
        (" 7 ", None, D("7.0000")), (None, None, None), ("inf", "not a number", None), ("", None, None)], key=repr)
    dot = cells.with_number(df.filter("raw = '1,5'"), "raw").first()
    assert dot["error"] == "not a number"
    whole = cells.with_number(df.filter("raw = '1,5'"), "raw", comma=True, whole=True).first()
    assert whole["error"] == "not whole"


@pytest.mark.parametrize("text", ["NaN", "inf", "-Infinity", "1d", "5f", "0x10", "1_000", "1,5", "", "1 2", "--1", "1e"])
def test_malformed_numbers_are_refused_by_every_type(spark, text):
    for kind in ("double", "decimal(18,2)"):
        assert one(spark, cells.strict_number(F.col("r"), type_=kind), r=("string", text)) is None


@pytest.mark.parametrize("text,value", [("+5", 5), (" .5 ", 0.5), ("5.", 5), ("2e2", 200), ("-0.25", -0.25)])
def test_plain_numbers_are_read_by_every_type(spark, text, value):
    for kind in ("double", "decimal(18,2)"):
        assert float(one(spark, cells.strict_number(F.col("r"), type_=kind), r=("string", text))) == value


def test_rounding_is_half_up_on_exact_decimals(spark):
    for text, expected in (("2.675", "2.68"), ("0.125", "0.13"), ("1.005", "1.01"), ("-2.675", "-2.68")):
        assert one(spark, cells.round2(F.lit(text))) == D(expected)
    assert one(spark, cells.ratio2(F.lit(201), F.lit(200))) == 1
    assert one(spark, cells.ratio2(F.lit(3), F.lit(2))) == 2
    assert one(spark, cells.ratio2(F.lit(3), F.lit(0))) is None


def test_money_is_exact_and_dotted(spark):
    assert one(spark, cells.money(F.lit("10.005"))) == D("10.01")
    assert one(spark, cells.money(F.lit("10,00"))) is None


def test_guarded_change_and_ratio_never_divide_by_nothing(spark):
    for prev, cur, expected in ((100.0, 110.0, 10.0), (0.0, 5.0, None), (-5.0, 5.0, None), (None, 5.0, None), (5.0, None, None)):
        got = one(spark, cells.guarded_change(F.col("c"), F.col("p")), p=("double", prev), c=("double", cur))
        assert got is None if expected is None else abs(got - expected) < 1e-9
    assert one(spark, cells.percent(F.lit(1.0), F.lit(0.0))) is None


def test_tolerance_takes_the_larger_allowance(spark):
    assert one(spark, cells.within(F.lit(102.0), F.lit(100.0), 1.0, 0.02))
    assert not one(spark, cells.within(F.lit(103.0), F.lit(100.0), 1.0, 0.02))


def test_currency_unit_holds_inside_its_years_only(spark):
    for period, unit, error in (("1995", "Mil Reais", None), ("1980", None, "period outside currency interval")):
        got = one(spark, cells.resolve_unit(F.lit("Mil Reais [1994 a 2024]"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(period), "Mil Reais", "Mil Reais"))
        assert (got["unit"], got["error"]) == (unit, error)
    by_category = one(spark, cells.resolve_unit(F.lit("Vide categorias"), F.lit("Toneladas"), F.lit(None).cast("string"), F.lit("2000"), "Mil Reais", "Mil Reais"))
    assert by_category["unit"] == "Toneladas"
    override = one(spark, cells.resolve_unit(F.lit("Vide categorias"), F.lit("Toneladas"), F.lit("Mil frutos"), F.lit("2000"), "Mil Reais", "Mil Reais"))
    assert override["unit"] == "Mil frutos"


def test_units_are_scaled_once_and_the_published_unit_stays(spark, rows):
    factors = {"Mil Reais": ("R$", 1000)}
    df = spark.createDataFrame([(1.5, "Mil Reais"), (2.0, "kg"), (None, "Mil Reais")], "value double, unit string")
    assert rows(cells.scale_units(df, factors), "value", "unit", "original_unit") == sorted(
        [(1500.0, "R$", "Mil Reais"), (2.0, "kg", "kg"), (None, "R$", "Mil Reais")], key=repr)


def test_tri_state_any(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, cells.tri_any(f, t, n)) is True
    assert one(spark, cells.tri_any(f, f)) is False
    assert one(spark, cells.tri_any(f, n)) is None
    assert one(spark, cells.tri_flag(F.lit(" NAO "))) is False
    assert one(spark, cells.tri_flag(F.lit(""))) is None
    assert one(spark, cells.bit_flag(F.lit("1.0"))) is True
    assert one(spark, cells.bit_flag(F.lit(""))) is None


def test_derived_cell_says_why_it_is_empty(spark):
    got = one(spark, cells.derived_cell(F.lit(None).cast("double"), "%", "a/b", {"a": F.lit(1)}, "no base"))
    assert (got["status"], got["reason"], got["inputs"]) == ("unavailable", "no base", '{"a":1}')


def test_mapped_measures_choose_unit_and_kind_by_name(spark, rows):
    df = spark.createDataFrame([("a", "12", "10.005", "101")], "id string, f string, m string, p string")
    got = mapping.mapped_measures(df, ["id"], {"families": "f", "value": "m", "rate": "p"},
                                  {"families": ("famílias", "count"), "value": ("R$", "money"), "rate": ("%", "percent")})
    assert rows(got) == sorted([
        ("a", "families", "famílias", D("12.00"), None), ("a", "rate", "%", None, "above limit"), ("a", "value", "R$", D("10.01"), None)], key=repr)


def test_display_texts(spark):
    text = lambda v, u, s: one(spark, present.cell_text(F.lit(v).cast("double"), F.lit(u), F.lit(s)))
    assert text(1234567.0, "R$", "real") == "R$ 1.234.567"
    assert text(12.5, "%", "real") == "12,5%"
    assert text(12.0, "%", "real") == "12%"
    assert text(100.0, "%", "real") == "100%"
    assert text(1500.0, "kg", "real") == "1.500 kg"
    assert text(None, "kg", "suppressed") == "Suprimido (X)"
    assert text(None, "kg", "notApplicable") == "Não se aplica (..)"
    assert one(spark, present.signed_text(F.lit(5))) == "+5"
    assert one(spark, present.signed_text(F.lit(-1234))) == "-1.234"
    assert one(spark, present.integer_text(F.lit(None).cast("int"))) == "—"
    assert one(spark, present.compact_currency(F.lit(2500000.0))) == "R$ 2,50 mi"
    assert one(spark, present.currency_text(F.lit(-2.5))) == "-R$ 2,50"


def test_sentence_states_direction_without_cause(spark):
    s = lambda c: one(spark, present.change_sentence(F.lit("o valor"), F.lit(c).cast("double"), F.lit("2020"), F.lit("2021")))
    assert s(10.0) == "Entre 2020 e 2021, o valor aumentou 10%."
    assert s(-2.5) == "Entre 2020 e 2021, o valor diminuiu 2,5%."
    assert s(0.0) == "Entre 2020 e 2021, o valor não variou."
    assert s(None) == "A variação não está disponível para esta observação."


def test_digest_ignores_column_order_and_volatile_columns(spark):
    a = spark.createDataFrame([(1, None, "2024")], "b int, a string, collectedAt string")
    b = spark.createDataFrame([(None, 1, "2025")], "a string, b int, collectedAt string")
    assert a.select(documents.content_digest(a)).first() == b.select(documents.content_digest(b)).first()
    assert a.select(documents.canonical_json(["b", "a"])).first()[0] == '{"a":null,"b":1}'
