"""From raw documents to token ids: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns documents with the columns it was given; the last one adds
n_tokens and ids. What a stage decides takes effect: rejected documents go, one document of each group of
near-duplicates stays, contaminated documents go, personal data is blanked in the text.

Defined results: a null text counts as empty for the classifier and has null ids at the end; a null doc_id is
a document like any other; empty texts are no near-duplicates of each other; of repeated rows with words one
stays; an empty table gives no rows; extra columns are kept, whatever their names (but for ids and n_tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsboard.llm import decontaminate, jaccard, pieces, pii, quality
from opsboard.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encode(docs)
    return found.withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids")))


STAGES = [
    ("quality_trees", keep_good),
    ("jaccard_regions", one_of_each),
    ("decontamination", without_benchmark),
    ("bootstrapped_pii", without_personal_data),
    ("sentencepiece_scan", encoded),
]

# Trained trees, scored patterns and subword ids are beyond SQL: tests/llm/test_pipeline.py holds run() against
# plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
