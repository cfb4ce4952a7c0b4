import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from statmosaic.operators import quality, refresh, sets
from statmosaic.session import scratch_path, shared_dir
from statmosaic.streaming import ledger as live


def snap(spark, data):
    return spark.createDataFrame(data, "k string, n int, collectedAt string")


def test_only_dates_changed_keeps_the_previous_snapshot(spark, rows):
    old, same, new = snap(spark, [("a", 1, "d1"), ("a", 1, "d1")]), snap(spark, [("a", 1, "d2"), ("a", 1, "d3")]), snap(spark, [("a", 1, "d2")])
    assert rows(refresh.keep_or_replace(same, old)) == rows(old)
    # one copy fewer is a change of content
    assert rows(refresh.keep_or_replace(new, old)) == [("a", 1, "d2")]
    # so is a column that disappeared
    assert not refresh.content_differences(old.drop("n"), old).isEmpty()


def test_a_group_moves_together_or_not_at_all(spark, tmp_path, rows):
    """A refused member leaves every table at its version; unmoved tables stay, revisions add up and dates are kept."""
    root = str(tmp_path / "group")
    assert refresh.published_group(spark, root) == {}
    series = {"figures": (["k"], ["n"])}

    def run(version, figures, names, hashes):
        tables = {"figures": spark.createDataFrame(figures, "k string, n int"), "names": spark.createDataFrame(names, "k string, name string")}
        sources = spark.createDataFrame(hashes, "source string, hash string")
        gates = lambda t: [quality.unique_keys(t["figures"], ["k"]), quality.unique_keys(t["names"], ["k"])]
        return refresh.refresh_group(spark, root, version, tables, gates, series, sources, ["source", "hash"], F.lit(f"day {version}"))

    first = run("1", [("a", 1), ("b", 2)], [("a", "A")], [("s", "h1"), ("t", "h1")])
    second = run("2", [("a", 5), ("b", 2), ("c", 3)], [("a", "A")], [("s", "h2"), ("t", "h1")])
    assert second["names"] == first["names"] and second["figures"] != first["figures"]
    with pytest.raises(quality.GateFailure):
        run("3", [("a", 9), ("b", 9), ("c", 9)], [("a", "A"), ("a", "B")], [("s", "h3"), ("t", "h3")])
    now = refresh.published_group(spark, root)
    assert rows(now["figures"]) == [("a", 5), ("b", 2), ("c", 3)] and rows(now["names"]) == [("a", "A")]
    assert rows(now["sources"], "source", "hash", "collected_at") == [("s", "h2", "day 2"), ("t", "h1", "day 1")]
    run("4", [("a", 5), ("b", 7), ("c", 3)], [("a", "A")], [("s", "h2"), ("t", "h1")])
    log = refresh.published_group(spark, root)["revisions_figures"]
    assert rows(log, "k", "previous_n", "n", "detected_at") == [("a", 1, 5, "day 2"), ("b", 2, 7, "day 4")]


def test_dates_move_only_with_content(spark, rows):
    prev = spark.createDataFrame([("s1", "h1", "jan"), ("s2", "h2", "jan")], "source_id string, sha string, collected_at string")
    now = spark.createDataFrame([("s1", "h1"), ("s2", "h9"), ("s3", "h3")], "source_id string, sha string")
    assert rows(refresh.retain_dates(now, prev, F.lit("jun"), ["source_id", "sha"])) == [("s1", "h1", "jan"), ("s2", "h9", "jun"), ("s3", "h3", "jun")]


def test_revisions_list_changed_past_periods_only(spark, rows):
    a = spark.createDataFrame([("t", "1", 5), ("t", "2", None), ("t", "3", 7)], "t string, p string, n int")
    b = spark.createDataFrame([("t", "1", 5), ("t", "2", 6), ("t", "4", 1)], "t string, p string, n int")
    assert rows(refresh.revision_log(a, b, ["t", "p"], ["n"], F.lit("now"))) == [("t", "2", 6, None, "now")]


def test_failed_publication_leaves_the_last_good_version(spark, tmp_path, rows):
    gates = lambda df: [quality.unique_keys(df, ["k"])]
    good, bad = spark.createDataFrame([("a", 1)], "k string, n int"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    root = str(tmp_path)
    refresh.publish(good, root, "1", gates)
    with pytest.raises(quality.GateFailure):
        refresh.publish(bad, root, "2", gates)
    assert rows(refresh.published(spark, root)) == [("a", 1)]
    # a pointer that broke off before its commit names nothing
    os.makedirs(f"{root}/pointers/99999999999999999999/_temporary/0")
    assert rows(refresh.published(spark, root)) == [("a", 1)]
    refresh.publish(good.withColumn("n", F.lit(3)), root, "3", gates)
    assert rows(refresh.published(spark, root)) == [("a", 3)]


def test_failures_stay_alone_unless_a_group_moves_together(spark, rows):
    r = spark.createDataFrame([("fire", "1", "ok"), ("fire", "2", "failed"), ("land", "1", "ok"), ("land", "2", "failed")], "g string, s string, status string")
    assert rows(refresh.isolate_failures(r, "g", ["fire"])) == [("land", "1", "ok")]


def test_new_periods_and_carry_forward(spark, rows):
    have, offered = spark.createDataFrame([("1",), ("1",)], "p string"), spark.createDataFrame([("1",), ("2",), ("2",)], "p string")
    assert rows(refresh.new_periods(offered, have, ["p"])) == [("2",)]
    cur = spark.createDataFrame([("a", 5, None), ("b", 6, None), ("c", None, None)], "k string, stock int, mean double")
    prev = spark.createDataFrame([("a", 5, 1.5), ("b", 7, 2.5), ("c", None, 3.5)], "k string, stock int, mean double")
    assert rows(refresh.carry_forward(cur, prev, ["k"], ["stock"], ["mean"])) == sorted([("a", 5, 1.5), ("b", 6, None), ("c", None, 3.5)], key=repr)


def test_as_of_cuts_by_publication_and_window(spark, rows):
    df = spark.createDataFrame([("202401", "202312"), ("202401", "202201"), ("202403", "202401")], "pub string, m string")
    assert rows(refresh.as_of(df, "pub", "202402", "m", "202401", 24)) == [("202401", "202312")]


def test_partition_replacement_leaves_the_others(spark, tmp_path, rows):
    path = str(tmp_path / "catalog")
    df = spark.createDataFrame([("m1", 1), ("m2", 2)], "module string, n int")
    df.write.partitionBy("module").parquet(path)
    sets.replace_partitions(spark.createDataFrame([("m2", 9), ("m3", 3)], "module string, n int"), path, "module")
    assert rows(spark.read.parquet(path), "module", "n") == [("m1", 1), ("m2", 9), ("m3", 3)]


def test_scratch_follows_the_named_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))

    class Named:
        class conf:
            get = staticmethod({"spark.checkpoint.dir": "/shared/folder/"}.get)

    assert scratch_path(Named, "x").startswith("/shared/folder/statmosaic/x-")


EVENT = "id string, ts timestamp, territory string, sign int, weight int"


def put(spark, path, data):
    spark.createDataFrame([(i, None, t, s, w, at) for i, at, t, s, w in data], "id string, ts timestamp, territory string, sign int, weight int, at string").withColumn(
        "ts", F.to_timestamp("at")).drop("at").coalesce(1).write.mode("append").parquet(path)


def test_stream_updates_late_and_retracted_months_and_logs_them(spark, tmp_path, rows):
    src, state, log, cp = (str(tmp_path / n) for n in ("in", "state", "log", "cp"))

    def run():
        led = live.daily_ledger(spark.readStream.schema(EVENT).parquet(src), "ts", "800 days", ["territory"])
        live.write_ledger(led, state, cp, ["territory"], log, period=F.date_format("day", "yyyyMM")).awaitTermination()
        days = live.current_state(live.read_updates(spark, state), ["territory", "day"])
        return rows(live.by_period(days, ["territory"], F.date_format("day", "yyyyMM")))

    put(spark, src, [("1", "2024-01-05", "a", 1, 1), ("2", "2024-01-06", "a", -1, 1), ("3", "2024-02-01", "a", 1, 1)])
    assert run() == [("a", "202401", 1, 1, 0), ("a", "202402", 1, 0, 1)]
    put(spark, src, [("4", "2024-01-20", "a", 1, 1), ("1x", "2024-01-05", "a", 1, -1), ("5", "2024-02-03", "a", 1, 1)])
    assert run() == [("a", "202401", 1, 1, 0), ("a", "202402", 2, 0, 2)]
    logged = spark.read.option("recursiveFileLookup", "true").parquet(log)
    # January came out even again, so only February is a revision
    assert rows(logged, "period", "previous_admissions", "admissions") == [("202402", 1, 2)]


def test_snapshots_do_not_change_state_or_revisions(spark, tmp_path, rows):
    src, keys = str(tmp_path / "in"), ["territory", "day"]
    outs = {e: [str(tmp_path / f"{n}{e}") for n in ("state", "cp", "log")] for e in (2, 100)}
    for i in range(5):
        put(spark, src, [(f"{i}", "2024-01-05", "a", 1, 1), (f"{i}b", f"2024-0{i + 1}-05", "b", -1, 1)])
        for every, (state, cp, log) in outs.items():
            led = live.daily_ledger(spark.readStream.schema(EVENT).parquet(src), "ts", "800 days", ["territory"])
            live.write_ledger(led, state, cp, ["territory"], log, every=every).awaitTermination()
    got = {e: (rows(live.current_state(live.read_updates(spark, state), keys)), rows(spark.read.option("recursiveFileLookup", "true").parquet(log).drop("batch")))
           for e, (state, _, log) in outs.items()}
    assert got[2] == got[100]
    assert ("a", dt.date(2024, 1, 5), 5, 0, 5) in got[2][0] and len(got[2][1]) == 4
    schema = live.read_updates(spark, outs[2][0]).schema
    for e in (2, 100):
        last = max(int(n.split("=")[1]) for n in os.listdir(outs[e][0]) if n.startswith("b="))
        assert rows(live.state_before(spark, outs[e][0], keys, last + 1, schema, e)) == got[2][0]
        assert rows(live.read_state(spark, outs[e][0], ["territory"], last + 1, e)) == got[2][0]


def test_the_ledger_drops_what_is_too_late_and_lets_old_days_go(spark, tmp_path, rows):
    src, state, cp = (str(tmp_path / n) for n in ("in", "state", "cp"))

    def run(records):
        put(spark, src, records)
        q = live.write_ledger(live.daily_ledger(spark.readStream.schema(EVENT).parquet(src), "ts", "1 day", ["territory"]), state, cp, ["territory"])
        q.awaitTermination()
        return q

    run([("1", "2020-03-01", "a", 1, 1), ("2", "2024-06-10", "a", 1, 1)])
    q = run([("3", "2020-03-01", "a", 1, 1), ("4", "2024-06-10", "a", -1, 1), ("5", "2024-06-12", "a", 1, 1)])
    assert live.dropped_rows(q) == 1
    days = live.current_state(live.read_updates(spark, state), ["territory", "day"])
    assert rows(days) == [("a", dt.date(2020, 3, 1), 1, 0, 1), ("a", dt.date(2024, 6, 10), 1, 1, 0), ("a", dt.date(2024, 6, 12), 1, 0, 1)]
    # the day of 2020 has left the state, the latest days are in it
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_records_older_than_the_watermark_are_dropped_and_counted(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(spark, src, [("1", "2024-06-01", "a", 1, 1)])

    def run():
        q = live.write_rows(live.once_per_id(spark.readStream.schema(EVENT).parquet(src), ["id"], "ts", "30 days"), out, cp)
        q.awaitTermination()
        return q

    run()
    put(spark, src, [("1", "2024-06-01", "a", 1, 1), ("2", "2024-01-01", "a", 1, 1), ("3", "2024-05-20", "a", 1, 1)])
    q = run()
    assert rows(spark.read.parquet(out), "id") == [("1",), ("3",)]
    assert live.dropped_rows(q) == 1


def test_stream_logs_revised_wages_once(spark, tmp_path, rows):
    """A late record that leaves the counts as they were, by way of a retraction, still revises the mean wage."""
    src, state, cp, log = (str(tmp_path / n) for n in ("in", "state", "cp", "log"))
    schema = "id int, territory string, ts timestamp, sign int, weight int, wage double"
    day = dt.datetime(2024, 1, 5, 10)
    batches = [[(i, "a", day, 1, 1, 100.0) for i in range(6)] + [(9, "b", day, 1, 1, 50.0)], [(10, "a", day, 1, -1, 100.0), (11, "a", day, 1, 1, 400.0), (12, "b", day, 1, -1, 50.0), (13, "b", day, 1, 1, 70.0)], []]
    for batch in batches:
        if batch:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        led = live.daily_ledger(spark.readStream.schema(schema).parquet(src), "ts", "800 days", ["territory"], wage=F.col("wage").cast("decimal(18,2)"))
        live.write_ledger(led, state, cp, ["territory"], log).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(log)
    # five admissions make a sample: the mean of "a" is shown, that of "b" never is and so is no revision
    assert rows(got, "territory", "admissions", "previous_admissions", "admission_wage", "previous_admission_wage") == [("a", 6, 6, 150.0, 100.0)]
