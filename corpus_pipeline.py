"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's input.

Every stage is ``function(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. An empty input passes through all stages as an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blankweave.llm import near_dedup, packing, pii, quality_model, quality_rules, shared


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    return quality_rules.filter_documents(docs, shared.table(spark, sf_dir, "labels"))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 0 go. It learns from the labelled rows of the whole table ``documents``:
    of those that earlier stages kept, hardly any has label 0."""
    return quality_model.filter_documents(docs, shared.table(spark, sf_dir, "labels"), shared.table(spark, sf_dir, "documents"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8."""
    shared.bound_batches(spark)
    return near_dedup.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    shared.bound_batches(spark)
    return pii.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a batch of documents of like length."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_quality),
    ("near_dedup", without_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

# The rules' cutoffs, the trained models and the signatures have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
