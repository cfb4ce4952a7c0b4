import datetime as dt

import pytest
from pyspark.sql import functions as F

from statmosaic.functions import periods, text


def val(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_fold_and_header_key(spark):
    assert val(spark, text.fold(F.lit("  São  João d'Ávila "))) == "SAO JOAO D'AVILA"
    assert val(spark, text.fold(F.lit("été"))) == "ETE"
    assert val(spark, text.unaccent(F.lit("plain ASCII"))) == "plain ASCII"
    assert text.header_key("﻿Competência Mov.") == "competenciamov"


def test_codes_are_padded_but_never_cut(spark):
    pad = lambda v: val(spark, text.pad_code(F.lit(v), 7))
    assert pad(" 123 ") == "0000123"
    assert pad("12345678") is None
    assert pad("12a") is None


@pytest.mark.parametrize("v,expected", [("202012", True), ("202013", False), ("199912", False), ("2020-12", False)])
def test_year_month_pattern(spark, v, expected):
    assert val(spark, text.is_year_month(F.lit(v))) is expected


def test_labels(spark):
    assert val(spark, text.short_label(F.lit("3.2.1 - Soja"))) == "Soja"
    assert val(spark, text.short_label(F.lit("Soja - 3"))) == "Soja - 3"
    assert val(spark, text.ellipsis(F.lit("a" * 23))) == "a" * 22 + "…"
    assert val(spark, text.ellipsis(F.lit("a" * 22))) == "a" * 22
    assert val(spark, text.join_nonblank(", ", F.lit("Rua A"), F.lit(" "), F.lit(None).cast("string"), F.lit("10"))) == "Rua A, 10"


def test_relabel_prefers_exact_then_prefix(spark):
    f = lambda v: val(spark, text.relabel(F.lit(v), {"Total - X": "Mista"}, [("Total", "Total"), ("Privada", "Privada")]))
    assert f(" TOTAL - X ") == "Mista"
    assert f("total geral") == "Total"
    assert f("privada conveniada") == "Privada"
    assert f("outra") is None


def test_latest_year_is_bounded_by_non_digits(spark):
    y = lambda v: val(spark, text.latest_year_in(F.lit(v)))
    assert y("base_2019_2023.zip") == 2023
    assert y("120245") is None


def test_mentions_has_a_letter_boundary(spark):
    m = lambda v: val(spark, text.mentions(F.lit(v), "LAGOA", "PR"))
    assert m("Serra (PR) - Lagoa (PR)")
    assert not m("Novalagoa (PR)")
    assert not m("Lagoa (SC)")


def test_markup_and_url(spark):
    assert val(spark, text.strip_markup(F.lit("<b>A &amp; B</b>&nbsp;"))) == "A & B"
    assert val(spark, text.strip_markup(F.lit("&amp;lt;"))) == "&lt;"
    assert val(spark, text.query_url(F.lit("https://x"), {"q": F.lit("a b|c")})) == "https://x?q=a+b%7Cc"


def test_search_ignores_accents_and_case(spark):
    hit = lambda q: val(spark, text.search_match([F.lit("Unidade"), F.lit("São José")], q))
    assert hit("sao jose") and hit("SÃO") and not hit("santo")


def test_months(spark):
    assert val(spark, periods.month_list("202311", "202402")) == ["202311", "202312", "202401", "202402"]
    with pytest.raises(ValueError):
        periods.month_list("202402", "202311")
    assert val(spark, periods.window_first(F.lit("202402"), 24)) == "202203"
    assert val(spark, periods.month_ordinal(F.lit("2024-03")) - periods.month_ordinal(F.lit("202312"))) == 3
    assert val(spark, periods.year_month(F.lit(dt.date(2024, 3, 9)))) == "202403"


@pytest.mark.parametrize("p,grain,start", [
    ("2020", "year", dt.date(2020, 1, 1)), ("202003", "month", dt.date(2020, 3, 1)), ("2020-03", "month", dt.date(2020, 3, 1)),
    ("2020-03-04", "day", dt.date(2020, 3, 4)), ("2020-13", None, None), ("2020-02-30", "day", None)])
def test_grains(spark, p, grain, start):
    row = spark.createDataFrame([(p,)], "p string").select(periods.grain(F.col("p")).alias("g"), periods.period_start(F.col("p")).alias("s")).first()
    assert (row["g"], row["s"]) == (grain, start)


def test_instants(spark):
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    err = lambda v, p: val(spark, periods.instant_error(F.lit(v), F.lit(p), now))
    assert err("2024-05-03 10:00:00", "2024-05") is None
    assert err("2024-05-03 10:00:00", "202404") == "outside file period"
    assert err("2024-07-03 10:00:00", "2024") == "future"
    assert err("03/05/2024", "2024") == "malformed"
    assert val(spark, periods.millis_date(F.lit(1714780800000))) == dt.date(2024, 5, 4)
