"""From documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again before the next:
documents of poor quality go, lines that many documents share go, of each group of similar documents one
stays, documents that hold benchmark passages go, and what is left is packed.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statmosaic.llm import decontaminate, jaccard_join, line_dedup, packing, quality_model
from statmosaic.llm.tables import documents, fresh, row_key, table
from statmosaic.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None  # no SQL fits a classifier; tests hold every stage against plain Python


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from this stage's labelled documents, accepts.

    A null text is scored like the empty one; repeated rows are judged each; without labels all documents have one score.
    """
    stats = materialize(quality_model.features(docs), "text-stats")
    return quality_model.accepted(docs, quality_model.fit(stats, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share; one that loses all of them stays, empty."""
    names = fresh(docs, *line_dedup.RESULT)
    kept_text, n_dropped = names[0], names[2]
    kept = line_dedup.drop_shared_lines(docs, min_docs=10, min_chars=1, names=tuple(names))
    text = F.when(F.col("text").isNull(), None).otherwise(F.col(kept_text))
    new = {"text": text, "n_chars": F.when(F.col(n_dropped) > 0, F.char_length(kept_text).cast(dict(docs.dtypes).get("n_chars", "bigint"))).otherwise(F.col("n_chars"))}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def similarity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents the one with the least doc_id; a repeated row once; all without words."""
    groups = jaccard_join.similar_groups(docs)
    stays, again = fresh(docs, "stays", "again")
    stay = materialize(groups.where("doc_id <=> component_id").select("doc_id").distinct(), "staying").toDF(stays)
    # the ids grow with the corpus: a merge at every size, never a broadcast
    kept = docs.join(stay.hint("merge"), docs["doc_id"].eqNullSafe(stay[stays]), "left_semi")
    # copies of one row meet, rows without doc_id do not; all but the first go before they are sent
    copies = Window.partitionBy("doc_id", row_key()).orderBy(row_key())
    return kept.withColumn(again, F.row_number().over(copies)).where(F.col(again) == 1).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those that hold benchmark passages; one without words stays, and every row is judged for itself."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", similarity_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each stage's result written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
