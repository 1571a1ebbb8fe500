"""The training-data pipeline: documents that are in a known language, of good quality, unlike each other and free of
benchmark items, packed into sequences. Each stage works on all rows that its predecessor kept.

Cases: null and blank texts have no language and go with the first stage; rows that share a doc_id and differ in text all
stay (with equal texts, one does), as do rows with a null doc_id; further columns, whatever their names, are handed on
unchanged up to packing; an empty table, or one of which nothing is kept, gives no rows; without labels no row is
rejected by the quality stage, and without languages all are by the first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import op3_quality_classifier, op7_benchmark_decontamination, op8_ngram_jaccard_join, op9_best_fit_packing, op10_language_id
from plumbline.llm.common import materialize, table
from plumbline.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language", _shipped(op10_language_id.stage)),
    ("quality", _shipped(op3_quality_classifier.stage)),
    ("similar", _shipped(op8_ngram_jaccard_join.stage)),
    ("benchmark", _shipped(op7_benchmark_decontamination.stage)),
    ("packing", _shipped(lambda spark, docs, sf_dir: op9_best_fit_packing.pack(docs))),
]

#: Trained models and packing have no SQL equivalent; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
