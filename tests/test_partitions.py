"""Publications by partition: digests, what is written, what is read again."""

import pytest
from pyspark.sql import functions as F

from statmosaic.operators import partitions, quality

SCHEMA = "k string, p string, n int, collectedAt string"
ROWS = [("a", "x", 1, "d"), ("b", "x", None, "d"), ("b", "x", None, "d"), ("c", None, 3, "d"), ("d", "", 4, "d"), ("e", "y", 5, "d")]


def publish(spark, root, version, data, schema=SCHEMA):
    gates = lambda df: [quality.unique_keys(df, ["k", "n"]) if version == "refused" else quality.volume_floor(df, 1)]
    df = spark.createDataFrame(data, schema)
    names = {r.key: r.p for r in df.select("p", partitions.part_key(["p"]).alias("key")).distinct().collect()}
    return {names.get(r.part, "not there"): r.status for r in partitions.publish_partitions(df, root, version, ["p"], gates).collect()}


def test_digests_follow_content_not_order_or_dates(spark):
    def digests(data, parts=1):
        df = spark.createDataFrame(data, SCHEMA).repartition(parts)
        return {r.part: tuple(r)[1:] for r in partitions.partition_digests(df, ["p"]).collect()}

    base = digests(ROWS)
    assert len(base) == 4 and sum(d[0] for d in base.values()) == len(ROWS)
    assert digests(ROWS[::-1], 3) == base
    assert digests([(k, p, n, "later") for k, p, n, _ in ROWS]) == base
    # one copy fewer, a null for a number and swapped fields all count
    for changed in (ROWS[:2] + ROWS[3:], [("a", "x", None, "d"), *ROWS[1:]], [("b", "x", 1, "d"), ("a", "x", None, "d"), *ROWS[2:]]):
        other = digests(changed)
        assert sum(other[p] != base[p] for p in base) == 1
    assert digests([], 2) == {}


def test_only_moved_partitions_are_written(spark, tmp_path, rows):
    root = str(tmp_path / "table")
    assert partitions.manifest(spark, root).count() == 0
    with pytest.raises(ValueError, match="nothing is published"):
        partitions.read_partitions(spark, root)
    assert publish(spark, root, "1", ROWS) == {"x": "new", None: "new", "": "new", "y": "new"}
    assert rows(partitions.read_partitions(spark, root)) == sorted(ROWS, key=repr)
    second = [*ROWS[:3], ("c", None, 9, "d"), ("d", "", 4, "later"), ("f", "z", 6, "d")]
    assert publish(spark, root, "2", second) == {"x": "same", None: "changed", "": "same", "not there": "gone", "z": "new"}
    assert spark.read.parquet(f"{root}/data/version=2").count() == 2
    # what did not move keeps its date of collection
    assert rows(partitions.read_partitions(spark, root)) == sorted([*second[:4], ROWS[4], second[5]], key=repr)
    # a refused version leaves the one before
    with pytest.raises(quality.GateFailure):
        publish(spark, root, "refused", [*second, ("f", "z", 6, "d")])
    assert partitions.read_partitions(spark, root).count() == 6
    # nothing moved: nothing written; another column moves all
    assert set(publish(spark, root, "3", second).values()) == {"same"} and not (tmp_path / "table" / "data" / "version=3").exists()
    assert set(publish(spark, root, "4", [(*r, 1) for r in second], SCHEMA + ", more int").values()) == {"new"}
    # an empty table publishes no rows
    assert set(publish(spark, root, "5", [], SCHEMA + ", more int").values()) == {"gone"}
    assert rows(partitions.read_partitions(spark, root)) == []


def test_reserved_column_is_refused(spark):
    with pytest.raises(ValueError, match="reserved"):
        partitions.partition_digests(spark.createDataFrame([("a", "b")], "p string, _part_key string"), ["p"])


def test_judging_reads_moved_partitions_only(spark, tmp_path, rows):
    roots = {"detail": str(tmp_path / "detail"), "summary": str(tmp_path / "summary")}
    seen = []

    def gate(tables):
        seen.append({n: (t.count(), len(t.inputFiles())) for n, t in tables.items()})
        summed = tables["detail"].groupBy("p").agg(F.sum("n").cast("int").alias("n"))
        return quality.recomputed(tables["summary"], summed, ["p"], ["n"])

    def run(version, detail, summary):
        publish(spark, roots["detail"], version, [("k", p, n, "d") for p, n in detail])
        publish(spark, roots["summary"], version, summary, "p string, n int")
        found, read = partitions.judge_moved(spark, roots, str(tmp_path / "checked"), gate)
        return [r.key for r in found.collect()], len(read)

    many = [(f"p{i}", 1) for i in range(20) for _ in range(5)]
    right = [(f"p{i}", 5) for i in range(20)]
    assert run("1", many, right) == ([], 20)
    assert run("2", many, right) == ([], 0) and seen[-1] == {"detail": (0, 0), "summary": (0, 0)}
    # one detail row more, its summary left behind: both tables are read in that partition alone
    assert run("3", [*many, ("p7", 1)], right) == (["p7"], 1) and seen[-1]["detail"][0] == 6 and seen[-1]["summary"] == (1, 1)
    # not found right, so judged again, beside a partition of which only the summary moved
    wrong = [(p, 4 if p == "p3" else n) for p, n in right]
    assert run("4", [*many, ("p7", 1)], wrong) == (["p3", "p7"], 2)
    assert run("5", [*many, ("p7", 1)], [(p, 6 if p == "p7" else n) for p, n in right]) == ([], 1)
    # a partition that left the detail but not the summary
    assert run("6", [*[r for r in many if r[0] != "p0"], ("p7", 1)], [(p, 6 if p == "p7" else n) for p, n in right]) == (["p0"], 1)
