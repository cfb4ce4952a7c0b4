import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statmosaic.functions.cells import status_consistent
from statmosaic.operators import quality as q
from statmosaic.sources import nested
from statmosaic.operators import sets


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def details(rows, v):
    return rows(v, "gate", "key", "detail")


def test_require_is_fail_closed(spark):
    ok = frame(spark, [], q.VIOLATION)
    q.require(ok)
    with pytest.raises(q.GateFailure, match=r"g \[k\] why"):
        q.require(ok, frame(spark, [("g", "k", "why")], q.VIOLATION))


def test_unique(spark, rows):
    df = frame(spark, [("a", None), ("a", None), ("b", 1)], "k string, p int")
    assert details(rows, q.unique_keys(df, ["k", "p"])) == [("unique", "a|∅", "2")]


def test_complete_cells(spark, rows):
    e = frame(spark, [("a",), ("b",)], "k string")
    assert q.complete_cells(sets.cell_differences(e, e, ["k"]), ["k"]).isEmpty()
    assert details(rows, q.complete_cells(sets.cell_differences(e, e.filter("k = 'a'"), ["k"]), ["k"])) == [("complete", "b", "missing")]


def test_metadata_contract(spark, rows):
    a, b = frame(spark, [("v", "t")], "n string, u string"), frame(spark, [("v", "kg")], "n string, u string")
    assert q.metadata_contract(a, a, ["n", "u"]).isEmpty()
    assert details(rows, q.metadata_contract(a, b, ["n", "u"])) == [("metadata", "v|kg", "not published"), ("metadata", "v|t", "not in contract")]


def test_unknown_does_not_satisfy_a_rule(spark, rows):
    df = frame(spark, [(1, 5), (2, -1), (3, None)], "id int, v int")
    assert rows(q.rules(df, ["id"], {"positive": F.col("v") > 0, "known": F.col("v").isNotNull()}), "gate", "key") == [
        ("known", "3"), ("positive", "2"), ("positive", "3")]


def test_sums(spark, rows):
    parts, totals = frame(spark, [("a", 1), ("a", 2), ("b", 1)], "k string, n int"), frame(spark, [("a", 3), ("b", 2), ("c", 1)], "k string, n int")
    assert rows(q.sums_to_total(parts, totals, ["k"], ["n"]), "key") == [("b",), ("c",)]


def test_identity_tolerance_edges(spark, rows):
    df = frame(spark, [("in", 100.0, 98.0), ("out", 100.0, 97.9), ("none", 100.0, None)], "k string, a double, b double")
    assert rows(q.identity(df, ["k"], F.col("a"), F.col("b"), absolute=2.0), "key") == [("out",)]


def test_published_rate(spark, rows):
    df = frame(spark, [("ok", 1, 3, 33.33), ("off", 1, 3, 33.9), ("above", 4, 3, 100.0), ("range", 0, 0, 120.0), ("zero", 0, 0, 0.0)], "k string, n int, d int, r double")
    assert details(rows, q.published_rate(df, ["k"], "n", "d", "r")) == [
        ("rate", "above", "numerator above universe"), ("rate", "off", "rate off its parts"), ("rate", "range", "rate out of bounds")]


def test_published_rate_needs_all_its_parts(spark, rows):
    df = frame(spark, [("n", None, 3, 1.0), ("d", 1, None, 1.0), ("r", 1, 3, None)], "k string, n int, d int, r double")
    assert details(rows, q.published_rate(df, ["k"], "n", "d", "r")) == [("rate", k, "rate or part absent") for k in "dnr"]


def test_unreadable_months_are_violations(spark, rows):
    df = frame(spark, [("a", "202312"), ("a", "202413"), ("b", "202312"), ("b", None), ("c", "2023-12"), ("c", "2024-01")], "k string, m string")
    assert details(rows, q.continuous(df, ["k"], "m")) == [("calendar", "a", "1 unreadable months"), ("calendar", "b", "1 unreadable months")]
    late = df.withColumn("l", F.when(F.col("k") == "c", "202401").when(F.col("k") == "a", "x"))
    assert rows(q.last_is_latest(late, ["k"], "m", "l"), "key") == [("a",), ("b",)]


def test_pages_without_a_readable_total_are_violations(spark, rows):
    bodies = [("ok", '{"numFound":2,"docs":[{"id":1},{"id":2}]}'), ("empty", '{"numFound":0,"docs":[]}'), ("html", "<html>busy</html>"), ("null", None),
              ("untold", '{"docs":[{"id":1}]}'), ("short", '{"numFound":3,"docs":[{"id":1}]}'), ("none", '{"numFound":3}')]
    pages = nested.paged_documents(frame(spark, bodies, "page string, body string"), "struct<id: bigint>")
    assert details(rows, q.declared_total(pages, ["page"], "declared", "received")) == [
        ("truncation", "html", "no readable total"), ("truncation", "none", "0/3"), ("truncation", "null", "no readable total"),
        ("truncation", "short", "1/3"), ("truncation", "untold", "no readable total")]


def test_cubes_that_cannot_be_read_are_violations(spark, rows):
    result = '{"classificacoes":[{"id":"81","nome":"P","categoria":%s}],"series":[{"localidade":{"id":"1","nivel":{"id":"N6","nome":"M"},"nome":"A"},"serie":{"2019":"10"}}]}'
    cube = '[{"id":"1","variavel":"v","unidade":"t","resultados":[%s]}]'
    docs = frame(spark, [("ok", cube % (result % '{"1":"a"}')), ("two", cube % ",".join([result % '{"1":"a","2":"b"}', result % '{"3":"c"}'])),
                         ("html", "<html>busy</html>"), ("null", None), ("hollow", "[{}]")], "r string, body string")
    assert details(rows, nested.cube_violations(docs, ["r"])) == [
        ("cube", "hollow", "unreadable response"), ("cube", "html", "unreadable response"), ("cube", "null", "unreadable response"), ("cube", "two", "1 results of several categories")]
    assert rows(nested.cube_cells(docs).select("r", nested.dims_key(F.col("dims")))) == [("ok", "81=1"), ("two", "81=3")]


def test_references_and_https(spark, rows):
    df = frame(spark, [("a", "s1", "https://x"), ("b", "s9", "http://x"), ("c", None, None)], "id string, s string, u string")
    src = frame(spark, [("s1",)], "s string")
    assert rows(q.referential(df, src, "s", ["id"]), "key") == [("b",), ("c",)]
    assert rows(q.https_only(df, ["id"], "u"), "key") == [("b",), ("c",)]


def test_calendar(spark, rows):
    df = frame(spark, [("a", "202311"), ("a", "202401"), ("a", "202401"), ("b", "202312"), ("b", "202401")], "k string, m string")
    assert details(rows, q.continuous(df, ["k"], "m")) == [("calendar", "a", "2/3")]
    t = df.select("k").distinct()
    assert rows(q.missing_months(df, t, ["k"], "m", "202311", "202401"), "key") == [("a|202312",), ("b|202311",)]
    late = df.withColumn("l", F.lit("202402"))
    assert rows(q.last_is_latest(late, ["k"], "m", "l"), "key") == [("a",), ("b",)]
    assert q.last_is_latest(df.withColumn("l", F.lit("202401")), ["k"], "m", "l").isEmpty()


def test_volume_and_truncation(spark, rows):
    df = frame(spark, [("p1", 2), ("p1", 2), ("p2", 5)], "page string, total int")
    assert q.volume_floor(df, 3).isEmpty() and not q.volume_floor(df, 4).isEmpty()
    assert not q.volume_floor(df.filter("false"), 1).isEmpty()
    assert details(rows, q.declared_total(df, ["page"], "total")) == [("truncation", "p2", "1/5")]


def test_all_or_nothing(spark, rows):
    data = [("2020", "a", 1), ("2020", "b", 2), ("2021", "a", 1), ("2021", "b", None), ("2022", "a", None), ("2022", "b", None), ("2023", "a", None), ("2023", "b", None)]
    df = frame(spark, data, "y string, c string, v int")
    assert details(rows, q.all_or_nothing(df, ["y"], "c", "v", 2, ["2023"], "y")) == [("partial", "2021", "partial opening"), ("partial", "2022", "undocumented gap")]


def test_recompute(spark, rows):
    a, b = frame(spark, [("x", 1), ("y", 2), ("z", None)], "k string, n int"), frame(spark, [("x", 1), ("y", 3), ("z", None), ("w", 1)], "k string, n int")
    assert rows(q.recomputed(a, b, ["k"], ["n"]), "key") == [("w",), ("y",)]


def test_yield_warnings(spark, rows):
    df = frame(spark, [("ok", 10.0, 5.0, 2050.0, 5.0), ("off", 10.0, 5.0, 2100.0, 4.0), ("none", 10.0, 0.0, 1.0, None)], "k string, p double, a double, y double, pl double")
    assert details(rows, q.yield_warnings(df, ["k"], "p", "a", "y", "pl")) == [("area", "off", "harvested above planted"), ("yield", "off", "yield off production/area")]


def test_zero_needs_a_confirmed_scan(spark, rows):
    e = frame(spark, [("a",), ("b",)], "k string")
    assert rows(q.confirmed_scan(e.filter("k = 'a'"), e, "k"), "key") == [("b",)]
    assert q.confirmed_scan(e.filter("false"), e, "k").count() == 2


def test_schema_differences_reach_nested_fields():
    a = T.StructType.fromDDL("x int, s struct<y: string, z: array<int>>")
    b = T.StructType.fromDDL("x int, s struct<y: int, w: int>")
    got = q.schema_differences(a, b)
    assert "s.y: string is not int" in got and "missing s.w" in got and "extra s.z" in got and q.schema_differences(a, a) == []


def test_export_equals_derived_as_a_multiset(spark, rows):
    a = frame(spark, [("x", 1), ("x", 1)], "k string, n int")
    assert q.export_matches(a, a).isEmpty()
    assert details(rows, q.export_matches(a, frame(spark, [("x", 1)], "k string, n int"))) == [("export", "x|1", "2/1")]
    with pytest.raises(q.GateFailure):
        q.export_matches(a.select("n", "k"), a)


def test_revalidation_fires_on_each_kind_of_damage(spark, rows):
    df = frame(spark, [("a", 1.0, "real"), ("b", None, "real"), ("c", 2.0, "suppressed"), ("d", -1.0, "real"), ("e", float("nan"), "real"), ("a", 1.0, "real")], "k string, v double, s string")
    got = rows(q.revalidate(df, ["k"], "v", "s"), "gate", "key")
    assert got == [("range", "d"), ("range", "e"), ("status", "b"), ("status", "c"), ("unique", "a")]
    assert [r[0] for r in df.coalesce(1).select(status_consistent(F.col("v"), F.col("s"))).collect()] == [True, False, False, True, True, True]
