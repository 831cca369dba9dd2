"""Edits that name a cell of a table and a paragraph in it.

``cells(doc_id, table_index, row, col, colspan, rowspan, block_index)`` places the visible cells, ``col`` being the
logical column they start in; a spanned place belongs to the cell that covers it. The paragraphs of a
cell are the lines of its block. An address becomes a block and a range of its shown text by equi-joins, and offsets
inside the paragraph become offsets in the block, so that all operators on blocks take edits in cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blankweave.operators import spans as S
from blankweave.operators.context import shown_blocks
from blankweave.operators.skew import hot_join

ADDRESS = ["table_index", "row_index", "col_index"]
OFFSETS = ("offset", "start_offset", "end_offset")


def covered_cells(cells: DataFrame) -> DataFrame:
    """``(doc_id, table_index, row_index, col_index, block_index)`` for every place that a cell covers."""
    rows = F.sequence(F.col("row"), F.col("row") + F.coalesce("rowspan", F.lit(1)) - 1)
    columns = F.sequence(F.col("col"), F.col("col") + F.coalesce("colspan", F.lit(1)) - 1)
    wide = cells.select("doc_id", "table_index", F.explode(rows).alias("row_index"), columns.alias("_c"), "block_index")
    return wide.select("doc_id", "table_index", "row_index", F.explode("_c").alias("col_index"), "block_index")


def cell_paragraphs(segments: DataFrame, cells: DataFrame) -> DataFrame:
    """``(doc_id, block_index, paras)``: for each cell's block where its paragraphs begin and end in the shown text."""
    spoken = shown_blocks(segments.join(cells.select(*S.BLOCK).distinct(), S.BLOCK, "left_semi"))

    def add(done: Column, line: Column) -> Column:
        at = F.coalesce(F.element_at(done, -1)["high"] + 1, F.lit(0).cast("bigint"))
        return F.concat(done, F.array(F.struct(at.alias("low"), (at + F.length(line)).alias("high"))))

    none = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    first = F.struct(F.lit(0).cast("bigint").alias("low"), F.length(F.get(F.col("_l"), 0)).cast("bigint").alias("high"))
    paras = F.aggregate(F.slice("_l", 2, F.size("_l")), F.coalesce(none, F.array(first)), add)
    return spoken.withColumn("_l", F.split("text", "\n", -1)).select(*S.BLOCK, paras.alias("paras"))


def resolve(edits: DataFrame, segments: DataFrame, cells: DataFrame, first_by_default: bool = False) -> DataFrame:
    """``edits`` with the block they mean, their offsets counted from its start, ``para_start``, ``para_end`` and ``error``.

    An edit names a table, row and column, or a block; ``para_in_cell`` is needed where the cell has several paragraphs,
    unless the first one is meant by default. Edits of blocks that are no cells stay as they are.
    """
    named = F.col("table_index").isNotNull() & F.col("row_index").isNotNull() & F.col("col_index").isNotNull()
    places = covered_cells(cells).withColumnRenamed("block_index", "_cell")
    # Half of a request may be in one document.
    met = hot_join(edits, places, ["doc_id", *ADDRESS], F.col("op_index"), "left").withColumn("_named", named)
    asked = met.withColumn("block_index", F.when(F.col("_named"), F.col("_cell")).otherwise(F.col("block_index")).cast("bigint")).drop("_cell")
    found = hot_join(asked, cell_paragraphs(segments, cells), S.BLOCK, F.col("op_index"), "left")
    several = F.size("paras") > 1
    which = F.coalesce(F.col("para_in_cell"), F.when(~several | F.lit(first_by_default), F.lit(0)))
    para = F.when(which >= 0, F.get("paras", which.cast("int")))
    offsets = [F.col(c) for c in OFFSETS if c in edits.columns]
    outside = F.lit(False)
    for c in offsets:
        outside = outside | F.coalesce((c < 0) | (c > para["high"] - para["low"]), F.lit(False))
    in_cell = F.col("paras").isNotNull()
    error = (
        F.when(F.col("_named") & ~in_cell, F.lit("unknown cell"))
        .when(in_cell & which.isNull(), F.lit("cell has several paragraphs"))
        .when(in_cell & para.isNull(), F.lit("unknown paragraph"))
        .when(in_cell & outside, F.lit("offset outside the paragraph"))
    )
    out = found.withColumn("error", error).withColumn("para_start", para["low"]).withColumn("para_end", para["high"])
    for c in OFFSETS:
        if c in edits.columns:
            out = out.withColumn(c, F.coalesce(F.col("para_start") + F.col(c), F.col(c)))
    return out.drop("paras", "_named")


def beside(resolved: DataFrame) -> DataFrame:
    """Adds with a ``position`` left or right as adds at an offset: the start or the end of their paragraph."""
    return resolved.withColumn("offset", F.when(F.col("position") == "left", F.col("para_start")).otherwise(F.col("para_end")))


def apply_in_cells(
    segments: DataFrame, resolved: DataFrame, operator: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], keys: tuple[str, ...] = ("op_index",)
) -> tuple[DataFrame, DataFrame]:
    """An operator on blocks run on edits from ``resolve``: segments, and (doc_id, op_index, status, error) of all edits.

    ``keys`` tell the operator's status rows apart inside a block.
    """
    good = resolved.where("error IS NULL").drop("error", "para_start", "para_end")
    out, told = operator(segments, good)
    columns = [*S.BLOCK, *keys]
    status = told.select(*columns, "status", F.col("error") if "error" in told.columns else F.lit(None).cast("string").alias("error")).dropDuplicates(columns)
    done = good.select("op_index", *[c for c in columns if c != "op_index"]).join(status, columns)
    bad = resolved.where("error IS NOT NULL").select("doc_id", "op_index", F.lit("failed").alias("status"), "error")
    return out, done.select("doc_id", "op_index", "status", "error").unionByName(bad)
