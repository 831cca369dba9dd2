"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_key(*columns: str) -> Column:
    """Key of a merged document: the same for every rerun."""
    return F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]), 256)


def write_results(merged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Merged documents under ``template_id=.../`` folders.

    Rows are spread over files by record inside each template, so one popular
    template does not end in one task.
    """
    keyed = merged.withColumn("result_id", result_key("template_id", "record_id"))
    keyed.write.mode(mode).partitionBy("template_id").parquet(path)


def write_blocks(blocks: DataFrame, table: str, buckets: int = 512) -> None:
    """Blocks as a table bucketed and sorted by document: later document windows need no exchange and no sort."""
    blocks.write.bucketBy(buckets, "doc_id").sortBy("doc_id", "block_index").mode("overwrite").saveAsTable(table)
