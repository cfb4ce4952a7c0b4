import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statmosaic.operators import aggregates as agg
from statmosaic.operators import disclosure, joins, mapping, ranking, sets, windows
from statmosaic.session import attach_group, materialize, param_table, salted_join

MOVE = "t string, m string, sign int, weight int, salary double, sector string, job string"
MOVES = [
    ("a", "202401", 1, 1, 1000.0, "S1", "j1"), ("a", "202401", 1, 1, 2000.0, "S2", "j1"), ("a", "202401", -1, 1, 900.0, "S1", "j2"),
    ("a", "202402", 1, 1, 1500.0, "S1", "j1"),      # late record of an earlier month
    ("a", "202401", 1, -1, 1000.0, "S1", "j1"),     # retracts the first one
    ("b", "202312", -1, -1, 500.0, "S2", "j2"),     # retraction without an original in the window
]


@pytest.fixture
def moves(spark):
    return spark.createDataFrame(MOVES, MOVE)


def test_ledger_applies_retractions_to_the_original_month(moves, rows):
    assert rows(agg.ledger(moves, ["t", "m"])) == [("a", "202401", 1, 1, 0), ("a", "202402", 1, 0, 1), ("b", "202312", 0, -1, 1)]


def test_breakdowns_conserve_the_total(moves, rows):
    got = agg.breakdowns(moves, ["t"], ["sector", "job"])
    sums = defaultdict(int)
    for r in got.collect():
        sums[r["t"], r["axis"]] += r["balance"]
    assert {k: v for k, v in sums.items() if k[0] == "a"} == {("a", "total"): 1, ("a", "sector"): 1, ("a", "job"): 1}


def test_a_null_category_is_not_the_total(spark, rows):
    df = spark.createDataFrame([("a", None, 1, 1), ("a", "x", 1, 1)], "t string, c string, sign int, weight int")
    assert rows(agg.breakdowns(df, ["t"], ["c"]), "axis", "category", "admissions") == sorted(
        [("total", "total", 2), ("c", None, 1), ("c", "x", 1)], key=repr)
    assert rows(agg.with_total(df, ["t"], "c", [F.count(F.lit(1)).alias("n")]), "c", "n") == sorted([("Total", 2), (None, 1), ("x", 1)], key=repr)


def test_mean_needs_its_minimum_sample(spark, rows):
    data = [("a", 10.0, 1)] * 5 + [("a", 10.0, -1)] + [("b", 10.0, 1)] * 5
    df = spark.createDataFrame(data, "t string, v double, w int")
    got = df.groupBy("t").agg(*agg.mean_with_sample(F.col("v"), F.col("w"), F.lit(True)))
    assert rows(got) == [("a", None, None, "unavailable"), ("b", 10.0, 5, "available")]


def test_spine_fills_zero_only_where_covered(spark, rows):
    t = spark.createDataFrame([("a",)], "t string")
    facts = spark.createDataFrame([("a", "202401", 3), ("a", "202404", 1)], "t string, month string, n int")
    dense = windows.densify(windows.month_spine(t, "202401", "202404"), facts, ["t", "month"], ["n"], F.col("month") != "202403")
    assert rows(dense) == sorted([("a", "202401", 3), ("a", "202402", 0), ("a", "202403", None), ("a", "202404", 1)], key=repr)


def test_windows_are_complete_or_absent(spark):
    months = [f"{y}{m:02}" for y in (2023, 2024) for m in range(1, 13)]
    df = spark.createDataFrame([("a", m, None if m == "202306" else 1) for m in months], "t string, month string, n int")
    got = {r["month"]: r for r in windows.complete_year_to_date(windows.complete_trailing(df, ["t"], "month", ["n"]), ["t"], "month", ["n"]).collect()}
    assert got["202305"]["n_ytd"] == 5 and got["202306"]["n_ytd"] is None and got["202312"]["n_ytd"] is None
    assert got["202312"]["n_12m"] is None and got["202405"]["n_12m"] is None and got["202406"]["n_12m"] == 12
    late = windows.complete_year_to_date(df.filter("month >= '202402'"), ["t"], "month", ["n"])
    assert all(r["n_ytd"] is None for r in late.collect())


def test_changes_need_a_positive_base_consecutive_years_and_one_unit(spark, rows):
    df = spark.createDataFrame([("a", "2019", 0.0, "t"), ("a", "2020", 10.0, "t"), ("a", "2021", 15.0, "t"), ("a", "2023", 30.0, "t"), ("a", "2024", 60.0, "kg")],
                               "k string, y string, v double, u string")
    close = lambda x: None if x is None else round(x, 6)
    got = [(r["y"], close(r["change"]), r["annual"]) for r in windows.changes(df, ["k"], "y", "v").orderBy("y").collect()]
    assert got == [("2019", None, False), ("2020", None, True), ("2021", 50.0, True), ("2023", 100.0, False), ("2024", 100.0, True)]
    strict = [(r["y"], close(r["annual_change"])) for r in windows.annual_changes(df, ["k"], "y", "v", "u").orderBy("y").collect()]
    assert strict == [("2019", None), ("2020", None), ("2021", 50.0), ("2023", None), ("2024", None)]


def test_latest_complete_skips_gaps_and_old_regimes(spark, rows):
    df = spark.createDataFrame([("e", "202301", 1, 1), ("e", "202302", 2, None), ("f", "202212", 9, 9)], "k string, p string, a int, b int")
    assert rows(windows.latest_complete(df, ["k"], "p", ["a", "b"], "202301")) == [("e", "202301", 1, 1)]


def test_last_n(spark, rows):
    df = spark.createDataFrame([("k", m) for m in ("202301", "202306", "202401", "202402")], "k string, month string")
    assert rows(windows.last_calendar_months(df, "month", F.lit("202402"), 12), "month") == [("202306",), ("202401",), ("202402",)]
    assert rows(windows.last_published(df, ["k"], "month", 3), "month") == [("202306",), ("202401",), ("202402",)]


def test_regime_break_starts_a_segment(spark, rows):
    df = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("k", "3", 3)], "k string, p string, v int")
    assert rows(windows.regime_segments(df, ["k"], "p", "v", ["2"]), "p", "v", "segment") == sorted([("1", 1, 0), ("2", None, 1), ("3", 3, 1)], key=repr)


def test_between_periods_rejects_reversed_order(spark):
    df = spark.createDataFrame([("k", "1", 1), ("k", "2", 5)], "k string, p string, v int")
    assert windows.between_periods(df, ["k"], "p", "v", "1", "2").first()["difference"] == 4
    assert windows.between_periods(df, ["k"], "p", "v", "2", "1").first()["difference"] is None


def test_null_sum_and_known_share(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v int")
    assert rows(df.groupBy("k").agg(agg.null_sum(F.col("v")).alias("s"))) == [("a", None), ("b", 5)]
    share = df.groupBy("k").agg(*agg.known_share(F.col("v") > 2))
    assert rows(share) == [("a", 0, 1, 1, 0.0), ("b", 1, 2, 0, 50.0)]
    none = df.filter("v IS NULL").groupBy("k").agg(*agg.known_share(F.col("v") > 2))
    assert rows(none) == [("a", 0, 0, 1, None)]


def test_leader_ties_resolve_by_label(spark, rows):
    df = spark.createDataFrame([("k", "b", 5), ("k", "a", 5), ("k", "c", None)], "k string, l string, v int")
    assert rows(agg.leader(df, ["k"], "l", "v")) == [("k", "a", 5)]


def test_coverage_decides_between_zero_and_unknown(spark, rows):
    spine = windows.month_spine(spark.createDataFrame([("a",)], "t string"), "202401", "202403")
    events = spark.createDataFrame([("a", "202401"), ("a", "202401")], "t string, month string")
    covered = spark.createDataFrame([("202401",), ("202402",)], "month string")
    monthly = agg.covered_counts(events, spine, covered, ["t"], "month")
    assert rows(monthly, "month", "count") == sorted([("202401", 2), ("202402", 0), ("202403", None)], key=repr)
    assert rows(agg.annual_coverage(monthly, ["t"], F.substring("month", 1, 4))) == [("a", "2024", 2, 2, False)]


def test_ranking_puts_missing_last_and_sorts_names_by_locale(spark):
    df = spark.createDataFrame([("k", "Zebu", 5), ("k", "Érva", 5), ("k", "ervilha", 5), ("k", "Soja", None), ("k", "Milho", 9)], "k string, n string, v int")
    got = ranking.rank_products(df, ["k"], "v", "n", F.lit(True)).orderBy("position").collect()
    assert [r["n"] for r in got] == ["Milho", "Érva", "ervilha", "Zebu", "Soja"]
    assert ranking.rank_products(df, ["k"], "v", "n", F.lit(True), 2).count() == 2


def test_tail_never_competes(spark):
    df = spark.createDataFrame([("k", c, n) for c, n in (("x", 1), ("y", 2), ("other", 99), ("unknown", 50), ("z", 3))], "k string, c string, n int")
    got = ranking.top_with_tail(df, ["k"], "c", [F.desc("n")], 2).orderBy("position").collect()
    assert [(r["c"], r["position"]) for r in got] == [("z", 1), ("y", 2), ("other", 3), ("unknown", 4)]


def test_merge_reports_conflicts_and_gaps(spark, rows):
    a = spark.createDataFrame([(1, "1", "x"), (2, "1", "y"), (3, "0", "z"), (4, "1", None)], "id int, active string, s string")
    b = spark.createDataFrame([(1, "x", 10), (2, "Y", 20), (4, "q", 40)], "id int, s string, v int")
    got = joins.merge_parts({"a": a, "b": b}, ["id"], "active")
    assert rows(got, "id", "v", "in_b", "conflicts", "incomplete") == sorted([
        (1, 10, True, [], False), (2, 20, True, ["s"], False), (3, None, False, [], False), (4, 40, True, ["s"], False)], key=repr)
    c = spark.createDataFrame([(9, 1)], "id int, v int")
    assert rows(joins.merge_parts({"a": a.filter("id = 1"), "c": c}, ["id"], "active"), "id", "incomplete") == [(1, True), (9, False)]


def test_lookup_separates_unknown_from_malformed(spark, rows):
    d = param_table(spark, [("01", "one")], "code string, label string")
    df = spark.createDataFrame([("01",), ("02",), ("x",)], "code string")
    assert rows(joins.lookup(df, d, "code", 2)) == sorted([("01", "one", None), ("unknown", None, None), ("x", None, "malformed")], key=repr)


def test_homonym_in_another_state_drops(spark, rows):
    walk = spark.createDataFrame([("410001", "41", "4100009")], "source_code string, state_code string, code string")
    df = spark.createDataFrame([("410001", "41", 1), ("410001", "42", 2), ("999999", "41", 3)], "c string, s string, n int")
    assert rows(mapping.in_territory(df, walk, "c", "s"), "n", "territory") == [(1, "4100009")]
    assert rows(mapping.located(df, walk, "c", "s").filter("NOT state_ok"), "n") == [(2,)]


def test_comparison_shows_a_peer_only_when_every_key_agrees(spark, rows):
    local = spark.createDataFrame([("gdp", "R$", "m1", "2021", 10.0)], "i string, u string, m string, p string, value double")
    peers = spark.createDataFrame([("gdp", "R$", "m1", "2021", 1.0), ("gdp", "US$", "m1", "2021", 2.0), ("gdp", "R$", "m2", "2021", 3.0), ("gdp", "R$", "m1", "2020", 4.0)],
                                  "i string, u string, m string, p string, value double")
    got = joins.comparable(local, peers, ["i", "u", "m", "p"])
    assert rows(got, "value", "comparable", "peer_value") == sorted([(1.0, True, 1.0), (2.0, False, None), (3.0, False, None), (4.0, False, None)], key=repr)


def test_leaves_need_a_whole_step_as_prefix(spark, rows):
    df = spark.createDataFrame([(p,) for p in ("1", "1.1", "1.10", "1.1.2", "2", "3.2")], "path string")
    assert rows(joins.leaves(df, "path")) == [("1.1.2",), ("1.10",), ("2",), ("3.2",)]


def test_reconcile_and_fallback(spark, rows):
    a = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "k string, value int")
    b = spark.createDataFrame([("k1", 1), ("k2", 9), ("k4", 4)], "k string, value int")
    assert rows(joins.reconcile(a, b, ["k"]), "k", "status") == [("k1", "matched"), ("k2", "mismatch"), ("k3", "pending"), ("k4", "missing")]
    cur = spark.createDataFrame([("k1", None), ("k2", 5), ("k9", None)], "k string, value int")
    assert rows(joins.fallback(cur, b, ["k"], "value"), "k", "value", "carried") == sorted([("k1", 1, True), ("k2", 5, False), ("k9", None, False)], key=repr)


def test_dedup_folds_identical_and_reports_conflicts(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "a", 1), (2, "a", None), (3, "b", 2)], "id int, x string, y int")
    assert rows(sets.dedup(df, ["id"]), "id", "copies", "conflict") == [(1, 2, False), (2, 2, True), (3, 1, False)]


def test_dedup_and_latest_records_reduce_by_hash(spark, rows):
    """Null keys are keys, ties and null fields keep their order, and no plan sorts facts to aggregate them."""
    data = [(1, "x", "2024-01", 5), (1, "x", "2024-01", 5), (1, "x", "2024-01", None), (None, "x", "2024-02", 1), (None, "x", "2024-02", 1), (2, None, "2023-12", 7),
            (2, None, "2024-03", 7), (2, None, "2024-03", 9), (3, "z", None, 4), (3, "z", "2022", 1), (4, "z", None, 2)]
    df = spark.createDataFrame(data, "k int, name string, p string, v int")
    one = sets.dedup(df, ["k", "name"])
    assert rows(one) == sorted([(1, "x", "2024-01", None, 3, True), (None, "x", "2024-02", 1, 2, False), (2, None, "2023-12", 7, 3, True),
                                (3, "z", None, 4, 2, True), (4, "z", None, 2, 1, False)], key=repr)
    last = windows.latest_complete(df, ["k", "name"], "p", ["v"])
    assert rows(last) == sorted([(1, "x", "2024-01", 5), (None, "x", "2024-02", 1), (2, None, "2024-03", 9), (3, "z", "2022", 1), (4, "z", None, 2)], key=repr)
    dated = df.withColumn("p", F.make_date(F.lit(2024), F.col("v").cast("int"), F.lit(1)))
    assert rows(windows.latest_complete(dated, ["k"], "p", ["v"]), "k", "v") == sorted([(1, 5), (None, 1), (2, 9), (3, 4), (4, 2)], key=repr)
    for frame in (one, last):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "WindowGroupLimit" in plan


def test_expected_seen_both_directions(spark, rows):
    e = sets.expected_cells(spark.createDataFrame([("a",)], "t string"), {"y": ["1", "2", "3"]})
    seen = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "1")], "t string, y string")
    assert rows(sets.cell_differences(e, seen, ["t", "y"])) == [("a", "2", 2, "repeated"), ("a", "3", 0, "missing"), ("b", "1", 1, "unexpected")]


def test_exclusive_lists_and_assemble(spark, rows):
    mk = lambda *v: spark.createDataFrame([(x,) for x in v], "item string")
    assert rows(sets.exclusive({"perm": mk("a", "b"), "temp": mk("b", "c")}, "item")) == [("b", "perm", "temp")]
    got = sets.assemble(mk("x", "y"), spark.createDataFrame([("x", 1, "real")], "item string, v int, status string"), "item", "none")
    assert rows(got, "item", "v", "status", "reason") == sorted([("x", 1, "real", None), ("y", None, "unavailable", "none")], key=repr)


def brute_merge(group):
    """The published rule, one group at a time."""
    small = lambda a, d: 0 < a < 5 or 0 < d < 5
    rows = [(c, a, d) for c, a, d in group if a or d]
    other = [r for r in rows if small(r[1], r[2])]
    visible = [r for r in rows if not small(r[1], r[2])]
    if not other:
        return {(c, a, d, "complete") for c, a, d in visible}
    tot = lambda: (sum(r[1] for r in other), sum(r[2] for r in other))
    while visible and small(*tot()):
        nxt = min(visible, key=lambda r: (r[1] + r[2], r[0]))
        visible.remove(nxt)
        other.append(nxt)
    if small(*tot()):
        return {(None, None, None, "suppressed")}
    return {(c, a, d, "aggregated") for c, a, d in visible} | {("other", *tot(), "aggregated")}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_small_category_merge_equals_the_rule(spark, seed):
    r = random.Random(seed)
    pick = lambda: r.choice([0, 0, 1, 2, 3, 4, 5, 6, 8, 20])
    data = [(g, f"c{i:02}", pick(), pick()) for g in range(250) for i in range(r.randint(1, 7))]
    df = spark.createDataFrame(data, "g int, c string, admissions bigint, dismissals bigint")
    got = defaultdict(set)
    for x in disclosure.merge_small(df, ["g"], "c").collect():
        got[x["g"]].add((x["c"], x["admissions"], x["dismissals"], x["privacy"]))
    want, before, after = defaultdict(set), defaultdict(int), defaultdict(int)
    for g in range(250):
        w = brute_merge([(c, a, d) for gg, c, a, d in data if gg == g])
        if w:
            want[g] = w
    assert dict(got) == dict(want)
    for g, _, a, d in data:
        before[g] += a + d
    for g, cells in got.items():
        if all(c[3] != "suppressed" for c in cells):
            after[g] = sum(c[1] + c[2] for c in cells)
            assert after[g] == before[g]
            assert not any(0 < v < 5 for c in cells for v in c[1:3])


def test_primary_and_sibling_suppression(spark, rows):
    df = spark.createDataFrame([("g", "a", 3, "pessoas", "real"), ("g", "b", 9, "pessoas", "real"), ("h", "a", 0, "pessoas", "real"), ("h", "b", 2, "unidades", "real"), ("h", "c", None, "pessoas", "real")],
                               "g string, c string, value int, unit string, status string")
    p = disclosure.suppress_primary(df, "value", "unit", "status", ["pessoas"])
    assert rows(p, "g", "c", "value", "status") == sorted([("g", "a", None, "suppressed"), ("g", "b", 9, "real"), ("h", "a", 0, "real"), ("h", "b", 2, "real"), ("h", "c", None, "unavailable")], key=repr)
    for bounded in (True, False):
        s = disclosure.suppress_siblings(p, ["g"], ["value"], "status", bounded=bounded)
        assert rows(s, "g", "c", "value", "status") == sorted([("g", "a", None, "suppressed"), ("g", "b", None, "suppressed"), ("h", "a", 0, "real"), ("h", "b", 2, "real"), ("h", "c", None, "unavailable")], key=repr)


def test_field_allow_list_and_leaks(spark, rows):
    df = spark.createDataFrame([(("x", "1"), "mail me@x.org"), (("y", "2"), "fine")], "who struct<name: string, cpf: string>, note string")
    bad = disclosure.forbidden_fields(df.schema, ["who", "who.name", "who.cpf", "note"], named=["who.name"], identifiers=["CPF"])
    assert bad == ["who.cpf"]
    assert disclosure.forbidden_fields(df.schema, ["who", "who.name", "note"]) == ["who.cpf", "who.name"]
    assert rows(disclosure.leaks(df, ["note"], r"\S+@\S+")) == [("note", 1)]


def test_hot_key_join_is_whole(spark, rows):
    facts = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(0, 60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).filter("k <> 9")
    for how in ("inner", "left", "left_semi"):
        a, b = salted_join(facts, dim, ["k"], how, 8), facts.join(dim, ["k"], how)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    with pytest.raises(ValueError):
        salted_join(facts, dim, ["k"], "full_outer")


def test_group_attachment_is_the_same_both_ways(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    one, two = (attach_group(df, ["k"], {"s": F.sum("v")}, b) for b in (True, False))
    assert rows(one) == rows(two) == [("a", 1, 3), ("a", 2, 3), ("b", 3, 3)]


def test_materialized_frames_come_back_whole(spark, rows):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), None)], "d date, x int")
    assert rows(materialize(df, "t")) == rows(df)


def test_movement_rules(spark):
    cols = "kind string, m string, dec string, exc string, late string, isx string, sign int, typ string"
    data = [("MOV", "202401", "202401", None, "0", None, 1, "10"), ("MOV", "202312", "202401", None, "0", None, 1, "10"), ("FOR", "202312", "202401", None, "0", None, 1, "10"),
            ("EXC", "202312", "202312", "202402", "0", "1", 1, "10"), ("FOR", "202312", "202401", None, "1", None, 1, "31"), ("FOR", "202312", "202401", None, "1", None, 1, "99"),
            ("FOR", "202312", "202401", None, "1", None, 2, "10"), ("MOV", "202401", "202312", None, "0", None, 1, "10")]
    c = {n: F.col(n) for n in ("kind", "m", "dec", "exc", "late", "isx", "sign", "typ")}
    p = mapping.movement_problem(c["kind"], c["m"], c["dec"], c["exc"], c["late"], c["isx"], c["sign"], c["typ"], F.lit("202401"), ["10"], ["31"])
    got = [r["p"] for r in spark.createDataFrame(data, cols).coalesce(1).select(p.alias("p")).collect()]
    assert got == [None, "not on time", "not flagged late", "wrong exclusion month", "sign against movement type", "unknown movement type", "unknown sign", "wrong declaration month"]


@pytest.mark.parametrize("changed,why", [
    ({"kind": None}, "unknown file kind"), ({"kind": "ABC"}, "unknown file kind"), ({"m": None}, "unreadable month"), ({"m": "202413"}, "unreadable month"),
    ({"pub": None}, "unreadable month"), ({"dec": None}, "wrong declaration month"), ({"late": None}, "not on time"), ({"kind": "FOR", "late": None}, "not flagged late"),
    ({"kind": "EXC", "isx": None, "exc": "202401"}, "wrong exclusion month"), ({"kind": "EXC", "isx": "1", "exc": None}, "wrong exclusion month"),
    ({"sign": None}, "unknown sign"), ({"typ": None}, "unknown movement type")])
def test_a_movement_record_with_a_missing_field_is_refused(spark, changed, why):
    record = {"kind": "MOV", "m": "202401", "dec": "202401", "exc": None, "late": "0", "isx": None, "sign": 1, "typ": "10", "pub": "202401"}
    df = spark.createDataFrame([tuple({**record, **changed}.values())], "kind string, m string, dec string, exc string, late string, isx string, sign int, typ string, pub string")
    p = mapping.movement_problem(*[F.col(c) for c in record], ["10"], ["31"])
    assert df.select(p.alias("p")).first()["p"] == why


def test_wage_without_a_known_minimum_is_never_used(spark, rows):
    df = spark.createDataFrame([("2024", 1000.0), ("2024", 100.0), ("2031", 1000.0)], "y string, w double")
    mins = param_table(spark, [("2024", 1412.0)], "year string, minimum double")
    got = mapping.wage_eligible(df, mins, "y", F.col("w"), F.lit(True), F.lit(False))
    assert rows(got, "y", "w", "wage_eligible") == [("2024", 100.0, False), ("2024", 1000.0, True), ("2031", 1000.0, False)]


def test_parameter_tables_keep_rows_order_of_columns_and_types(spark, rows):
    data = [("1995", 200.0, 1, None), ("1996", 300.5, 2, "x"), ("it's", -1.0, 3, "?")]
    got = param_table(spark, data, "year string, minimum double, n bigint, note string")
    assert got.schema.simpleString() == "struct<year:string,minimum:double,n:bigint,note:string>"
    assert rows(got) == sorted(data, key=repr)
    long = [(str(i), float(i)) for i in range(2000)]
    assert rows(param_table(spark, long, "k string, v double")) == sorted(long, key=repr)
    assert param_table(spark, [], "k string").count() == 0


def test_group_aggregates_reach_null_groups_in_both_forms(spark, rows):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, "x", 3), (None, None, 4), ("a", "x", 5)], "k string, j string, v int")
    for bounded in (True, False):
        got = attach_group(df, ["k", "j"], {"t": F.sum("v")}, bounded)
        assert got.columns == ["k", "j", "v", "t"]
        assert rows(got) == sorted([("a", None, 1, 3), ("a", None, 2, 3), (None, "x", 3, 3), (None, None, 4, 4), ("a", "x", 5, 5)], key=repr)


def test_siblings_of_a_null_group_are_withheld_in_both_forms(spark, rows):
    df = spark.createDataFrame([(None, "p", None, "suppressed"), (None, "q", 50.0, "real"), ("g", "p", 7.0, "real")], "g string, c string, value double, status string")
    one = rows(disclosure.suppress_siblings(df, ["g"], ["value"], "status", bounded=True))
    assert rows(disclosure.suppress_siblings(df, ["g"], ["value"], "status", bounded=False)) == one
    assert ("q", None) in [(r[1], r[2]) for r in one]


def test_a_published_category_named_other_is_not_the_fold(spark, rows):
    df = spark.createDataFrame([("a", "other", 50, 0), ("a", "x", 2, 0), ("a", "y", 9, 0), ("a", "z", 60, 0)], "k string, c string, admissions long, dismissals long")
    got = disclosure.merge_small(df, ["k"], "c")
    assert rows(got, "c", "admissions") == [("other", 11), ("other", 50), ("z", 60)]
