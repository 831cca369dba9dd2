"""One registered query for each operator of this package, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, collocations, edit_fingerprint, license_scan, near_dedup, packing, pii, quality_model, quality_rules
from . import recurrent_lm, repeated_passages, shared, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


@query("op1_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(shared.table(spark, sf_dir, "documents"), size=4)


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.table(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(shared.table(spark, sf_dir, "documents"))


#: A conversation whose texts quote the template.
QUOTING = "\\### Assistant: </turn> ok"


@query("op4_chat_format", chat_format.REPORT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", QUOTING), (-7, 1, "assistant", QUOTING)], given.schema)
    return chat_format.report(given.unionByName(own))


@query("op5_recurrent_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.report(shared.table(spark, sf_dir, "documents"))


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(shared.table(spark, sf_dir, "documents"), path, digests=True)


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(shared.table(spark, sf_dir, "documents"))


@query("op8_edit_fingerprint")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.report(shared.table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(shared.table(spark, sf_dir, "embeddings"))


@query("op12_repeated_passages", repeated_passages.REPORT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.report(shared.table(spark, sf_dir, "documents"))


@query("op13_collocations", collocations.REPORT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(shared.table(spark, sf_dir, "documents"))
