"""Blocks of a document: numbering, headings, neighbours, continuation lines.

Every function takes and returns a ``blocks`` DataFrame keyed by
``(doc_id, block_index)``. A document comes from one source row or file, so a
window per document is a group that some task has held already. All
windows here cluster on ``doc_id`` alone: after one ``by_document`` exchange (or
on a table bucketed by ``doc_id``) they share partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from blankweave.functions import text as T


def doc_order() -> WindowSpec:
    return W.partitionBy("doc_id").orderBy("block_index")


def so_far() -> WindowSpec:
    return doc_order().rowsBetween(W.unboundedPreceding, 0)


def by_document(df: DataFrame) -> DataFrame:
    """One exchange on ``doc_id`` that all later document windows reuse."""
    return df.repartition("doc_id")


def explode_lines(documents: DataFrame) -> DataFrame:
    """Plain-text documents -> one block per line; empty lines stay."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select(
        "doc_id",
        F.col("pos").cast("bigint").alias("block_index"),
        F.when(T.is_blank(F.col("text")), F.lit("[EMPTY LINE]")).otherwise(F.col("text")).alias("text"),
        T.is_blank(F.col("text")).alias("is_empty"),
    )


def number_blocks(df: DataFrame, *order: str | Column) -> DataFrame:
    """Running block number in document order, from 0."""
    window = W.partitionBy("doc_id").orderBy(*order)
    return df.withColumn("block_index", (F.row_number().over(window) - 1).cast("bigint"))


def with_headings(blocks: DataFrame) -> DataFrame:
    """Carry the last heading forward, with its block index and number."""
    style = F.col("style") if "style" in blocks.columns else None
    mark = F.when(
        T.is_heading(F.col("text"), style),
        F.struct(
            T.strip(F.col("text")).alias("text"),
            F.col("block_index").alias("at"),
            T.heading_number(F.col("text")).alias("number"),
        ),
    )
    return (
        blocks.withColumn("_heading", F.last(mark, ignorenulls=True).over(so_far()))
        .withColumn("nearest_heading", F.coalesce(F.col("_heading.text"), F.lit("")))
        .withColumn("section_start_index", F.col("_heading.at"))
        .withColumn("heading_number", F.col("_heading.number"))
        .drop("_heading")
    )


def with_neighbours(blocks: DataFrame, chars: int | None = None) -> DataFrame:
    """Two blocks before and after, each whole or its first ``chars`` characters."""
    snippet = T.first_chars(F.col("text"), chars)
    return blocks.withColumn(
        "before_context", F.collect_list(snippet).over(doc_order().rowsBetween(-2, -1))
    ).withColumn("after_context", F.collect_list(snippet).over(doc_order().rowsBetween(1, 2)))


def context_halo(blocks: DataFrame, has_field: Column) -> DataFrame:
    """Flag blocks that hold a field or sit right next to one that does."""
    near = F.max(has_field).over(doc_order().rowsBetween(-1, 1))
    return blocks.withColumn("in_halo", F.coalesce(near, F.lit(False)))


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """Append lines of blanks to the block with a blank they follow, then renumber.

    Only body paragraphs take part; a table between two paragraphs does not
    break a streak.
    """
    leaders = F.col("tab_leaders") if "tab_leaders" in blocks.columns else None
    in_body = F.col("type") == "paragraph" if "type" in blocks.columns else F.lit(True)
    body = W.partitionBy("doc_id", "_body").orderBy("block_index")
    flagged = (
        blocks.withColumn("_body", in_body)
        .withColumn("_has", T.has_blank(F.col("text"), leaders))
        .withColumn("_only", F.col("_has") & T.is_blank(T.strip_blanks(F.col("text"), leaders)))
        .withColumn("_after_blank", F.coalesce(F.lag("_has").over(body), F.lit(False)))
        .withColumn("_start", ~(F.col("_body") & F.col("_only") & F.col("_after_blank")))
        .withColumn("_streak", F.sum(F.col("_start").cast("int")).over(body.rowsBetween(W.unboundedPreceding, 0)))
    )
    carried = [c for c in blocks.columns if c not in ("doc_id", "block_index", "text")]
    merged = flagged.groupBy("doc_id", "_body", "_streak").agg(
        F.min("block_index").alias("first_block"),
        F.count(F.lit(1)).alias("merged_blocks"),
        F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("_parts"),
        *[F.min_by(c, "block_index").alias(c) for c in carried],
    )
    return number_blocks(merged, "first_block").select(
        "doc_id",
        "block_index",
        "first_block",
        "merged_blocks",
        F.array_join(F.col("_parts.text"), "").alias("text"),
        *carried,
    )


def paragraph_index(blocks: DataFrame, paragraph_count: Column) -> DataFrame:
    """Global number of the first paragraph of each block; a cell counts all of its paragraphs."""
    before = F.sum(paragraph_count).over(doc_order().rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("paragraph_index", F.coalesce(before, F.lit(0)).cast("bigint"))


def cell_paragraph(blocks: DataFrame, paragraph_count: Column, para_in_cell: Column) -> DataFrame:
    """(block, paragraph in cell) -> global paragraph number, NULL outside the cell."""
    inside = (F.col("type") == "table_cell") & (para_in_cell >= 0) & (para_in_cell < paragraph_count)
    return paragraph_index(blocks, paragraph_count).withColumn(
        "target_paragraph", F.when(inside, F.col("paragraph_index") + para_in_cell)
    )


def fallback_text(blocks: DataFrame, para_in_cell: Column | None = None) -> DataFrame:
    """Own text if it says something, else the nearest earlier block that does.

    With ``para_in_cell`` a table cell answers with that paragraph, else with
    its first paragraph that says something; it never looks at other cells.
    """
    earlier = F.last(F.when(T.has_content(F.col("text")), F.col("text")), ignorenulls=True).over(so_far())
    general = F.coalesce(earlier, F.lit(""))
    if para_in_cell is None:
        return blocks.withColumn("fallback_text", general)
    paragraphs = F.transform(F.split("text", "\n", -1), T.strip)
    addressed = F.coalesce(F.when(para_in_cell >= 0, F.get(paragraphs, para_in_cell.cast("int"))), F.lit(""))
    spoken = F.get(F.filter(paragraphs, T.has_content), 0)
    in_cell = F.when(T.has_content(addressed), addressed).otherwise(F.coalesce(spoken, F.lit("")))
    return blocks.withColumn(
        "fallback_text",
        F.when(para_in_cell.isNotNull() & (F.col("type") == "table_cell"), in_cell).otherwise(general),
    )
