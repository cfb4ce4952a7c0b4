"""The pipeline stage by stage, and the registered queries against their SQL."""

import os
from collections import Counter

import duckdb
import pytest
from conftest import FOLD, frame_of, got
from pyspark.sql import functions as F
from test_copies import plain_contamination, plain_groups, plain_lines

import corpus_pipeline
from statmosaic.llm import quality_model
from statmosaic.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are absent")


def rows_of(frame):
    return [(r.doc_id, r.text, r.lang) for r in frame.collect()]


@pytest.fixture(scope="module")
def tables(spark, awkward_rows, tmp_path_factory):
    """A folder with documents, labels and benchmark."""
    path = str(tmp_path_factory.mktemp("tables"))
    frame_of(spark, awkward_rows).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d not in (11, 12)), 0) for d, _, _ in awkward_rows if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    passage = next(t for d, t, _ in awkward_rows if d == 14).split("\n")[0]
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_against_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        after = corpus_pipeline.materialize(stage(spark, docs, tables), name)
        if name == "quality_classifier":
            scores = quality_model.quality_scores(docs, spark.read.parquet(f"{tables}/labels.parquet"))
            assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in scores.where("predicted = 1").collect())
            assert not set(rows_of(after)) - set(before)
        elif name == "line_dedup":
            want = sorted(((d, t) for d, t, _, _ in plain_lines(before, 10, 1)), key=repr)
            assert sorted(((r.doc_id, r.text or "") for r in after.collect()), key=repr) == want
            assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)
        elif name == "ngram_jaccard_join":
            groups = plain_groups([(i, t, g) for i, (_, t, g) in enumerate(before)], 3, 90)
            of_row = {i: c for i, _, c in groups}
            kept = Counter(rows_of(after))
            for component in set(of_row.values()):
                members = [before[i] for i in of_row if of_row[i] == component]
                assert sum(min(kept[m], 1) for m in set(members)) == 1, members[0][0]
            assert max(kept.values()) == 1
        elif name == "benchmark_decontamination":
            good = Counter(r[0] for r in plain_contamination(before, bench, 13) if not r[5])
            assert Counter(r.doc_id for r in after.collect()) == good
            assert 14 not in good or 13 not in good
        else:
            assert sum(r.length for r in after.collect()) == sum(r.doc_tokens for r in after.collect() if r.start == 0)
            assert Counter(r.doc_id for r in after.collect() if r.start == 0) == Counter(d for d, _, _ in before)
        if name != "packing":
            assert after.columns == columns
        docs = after
    assert docs.count() == corpus_pipeline.run(spark, tables).count()


def test_stages_take_empty_tables(spark, nothing, tables):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, tables).count() == 0, name


INNER = "kept_text n_lines n_dropped KEPT_TEXT_1 row own_row drops doc place _place stays again _row _again _own_row cls node label bucket n unit hits items key salt h1 h2".split()


def test_stages_and_queries_take_columns_of_any_name(spark, tables, monkeypatch):
    """Documents that have every inner and result name as a column, a third of them without doc_id, keep their columns."""
    from statmosaic.llm import decontaminate, line_dedup

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    given_ = rows_of(spark.read.parquet(f"{tables}/documents.parquet"))
    rows = [(d if i % 3 else None, t, g) for i, (d, t, g) in enumerate(given_)]
    plain = frame_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    odd = plain.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in INNER])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, odd, tables), name)
        assert after.columns == odd.columns
        assert sorted(rows_of(after), key=repr) == sorted(rows_of(corpus_pipeline.materialize(stage(spark, plain, tables), name)), key=repr), name
        for r in after.collect():
            assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for n in INNER), name
    names = ["doc_id", *line_dedup.RESULT]
    assert got(line_dedup.drop_shared_lines(odd).select(names)) == got(line_dedup.drop_shared_lines(plain).select(names))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@present
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_and_equal_their_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    rows = got(frame.select(*sorted(frame.columns)))
    assert rows
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(frame.columns)
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert rows == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
