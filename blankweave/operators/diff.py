"""Differences between two versions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blankweave.functions import text as T


def field_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields that vanished or appeared.

    One aggregation over both sides instead of two anti joins: each side is
    read once and reduced before the shuffle.
    """
    both = old.select("doc_id", "field_name", F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(
        new.select("doc_id", "field_name", F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    )
    seen = both.groupBy("doc_id", "field_name").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return seen.where("_old <> _new").select(
        "doc_id", "field_name", F.when(F.col("_old") == 1, F.lit("deleted")).otherwise(F.lit("added")).alias("change")
    )


def _differs(old: Column, new: Column) -> Column:
    """Texts differ by more than the kind of white space used."""
    same_trimmed = T.strip(old) == T.strip(new)
    same_spaced = F.regexp_replace(old, r"(?U)\s", " ") == F.regexp_replace(new, r"(?U)\s", " ")
    return ~(same_trimmed & same_spaced)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Text updates that turn one version into the other; a missing block counts as empty text.

    ``keys`` may add a paragraph number for cells to ``(doc_id, block_index)``.
    """
    keys = keys or ["doc_id", "block_index"]
    joined = old.select(*keys, F.col("text").alias("old_text")).join(
        new.select(*keys, F.col("text").alias("new_text")), keys, "full_outer"
    )
    filled = joined.withColumn("old_text", F.coalesce("old_text", F.lit(""))).withColumn(
        "new_text", F.coalesce("new_text", F.lit(""))
    )
    return filled.where((F.col("old_text") != F.col("new_text")) & _differs(F.col("old_text"), F.col("new_text")))


def diff_edits(old: DataFrame, new: DataFrame, old_fields: DataFrame, new_fields: DataFrame) -> DataFrame:
    """Text updates first, then deletions of vanished fields, as edit rows."""
    updates = snapshot_diff(old, new).select(
        "doc_id", F.lit("update_text").alias("type"), "block_index", "old_text", "new_text",
        F.lit(None).cast("string").alias("field_name"),
    )
    gone = field_changes(old_fields, new_fields).where("change = 'deleted'")
    none = F.lit(None)
    deletes = gone.select(
        "doc_id", F.lit("delete_placeholder").alias("type"), none.cast("bigint").alias("block_index"),
        none.cast("string").alias("old_text"), none.cast("string").alias("new_text"), "field_name",
    )
    return updates.unionByName(deletes)
