"""Edits addressed by table, row, column and paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.operators import addresses as A
from blankweave.operators import fields as FL
from blankweave.operators import spans as S
from blankweave.plans.duck import CTES, duck
from blankweave.plans.edit_queries import _SETTLED
from blankweave.plans.registry import query
from blankweave.sources import fixtures as X

# Two lines of a form make a cell of two paragraphs, every fourth cell has one; six cells make a table of two rows, whose
# first cell spans two columns.
_CELL_SQL = {
    "cell_blocks": """SELECT doc_id, CAST(block_index // 2 AS BIGINT) AS block_index, string_agg(text, chr(10) ORDER BY block_index) AS text
      FROM form_blocks WHERE block_index % 8 <> 7 GROUP BY ALL""",
    **{name: CTES[name][1].replace("form_blocks", "cell_blocks") for name in ("cut", "segs", "named", "tseg")},
    "cells": """SELECT doc_id, block_index, block_index // 6 AS t, block_index % 6 // 3 AS r, unnest(CASE block_index % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [2] ELSE [3] END) AS c FROM cell_blocks""",
    "shown": "SELECT doc_id, block_index, string_agg(text, '' ORDER BY seg_index) AS text FROM tseg GROUP BY ALL",
    "lines": """SELECT doc_id, block_index, i - 1 AS para, len(ls) AS n, list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)) AS low0, length(ls[i]) AS size
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, block_index, string_split(text, chr(10)) AS ls FROM shown))""",
    "edits": """SELECT doc_id, 0 AS op_index, doc_id % 2 AS t, doc_id % 3 AS r, doc_id % 5 AS c, NULL AS b, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 END AS p, doc_id % 6 AS a, doc_id % 6 + 4 AS z FROM documents
      UNION ALL SELECT doc_id, 1, 0, 1, 1, NULL, NULL, 0, 3 FROM documents
      UNION ALL SELECT doc_id, 2, NULL, NULL, NULL, doc_id % 7, 1, doc_id % 11, doc_id % 11 + 9 FROM documents""",
    "met": """SELECT e.* EXCLUDE (b), CASE WHEN e.t IS NULL THEN e.b ELSE x.block_index END AS b, e.t IS NOT NULL AS by_place FROM edits e
      LEFT JOIN cells x ON x.doc_id = e.doc_id AND x.t = e.t AND x.r = e.r AND x.c = e.c""",
    "held": "SELECT doc_id, block_index, max(n) AS n FROM lines GROUP BY ALL",
    "resolved": """SELECT m.doc_id, m.op_index, m.b, a, z, coalesce(l.low0, 0) AS low, l.size,
        CASE WHEN by_place AND h.n IS NULL THEN 'unknown cell' WHEN h.n IS NULL THEN NULL WHEN m.p IS NULL AND h.n > 1 THEN 'cell has several paragraphs' WHEN l.para IS NULL THEN 'unknown paragraph'
          WHEN greatest(a, z) > l.size THEN 'offset outside the paragraph' END AS error
      FROM met m LEFT JOIN held h ON h.doc_id = m.doc_id AND h.block_index = m.b
      LEFT JOIN lines l ON l.doc_id = m.doc_id AND l.block_index = m.b AND l.para = coalesce(m.p, 0)""",
}


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, cells and edits."""
    lines = X.form_blocks(spark, d).where("block_index % 8 <> 7")
    blocks = lines.groupBy("doc_id", F.expr("block_index DIV 2").alias("block_index")).agg(F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("l"))
    blocks = blocks.select("doc_id", "block_index", F.array_join(F.col("l.text"), "\n").alias("text"))
    cells = blocks.selectExpr(
        "doc_id", "block_index", "block_index DIV 6 AS table_index", "block_index % 6 DIV 3 AS row", "CASE block_index % 3 WHEN 0 THEN 0L ELSE block_index % 3 + 1 END AS col",
        "CASE block_index % 3 WHEN 0 THEN 2L ELSE 1L END AS colspan", "1L AS rowspan",
    )
    documents = X.table(spark, d, "documents").select("doc_id")
    columns = "table_index", "row_index", "col_index", "block_index", "para_in_cell", "start_offset", "end_offset"

    def edit(number: int, *values: str) -> DataFrame:
        return documents.selectExpr("doc_id", f"{number}L AS op_index", *[f"cast({v} AS bigint) AS {c}" for c, v in zip(columns, values, strict=True)])

    edits = edit(0, "doc_id % 2", "doc_id % 3", "doc_id % 5", "NULL", "CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 END", "doc_id % 6", "doc_id % 6 + 4")
    edits = edits.unionByName(edit(1, "0", "1", "1", "NULL", "NULL", "0", "3")).unionByName(edit(2, "NULL", "NULL", "NULL", "doc_id % 7", "1", "doc_id % 11", "doc_id % 11 + 9"))
    return FL.convert_blocks(blocks), cells, edits


@query("cell_addresses", duck("""
  SELECT doc_id, CAST(op_index AS BIGINT) AS op_index, CASE WHEN error IS NULL THEN b END AS block_index, CASE WHEN error IS NULL THEN CAST(coalesce(low, 0) + a AS BIGINT) END AS start_offset,
    CASE WHEN error IS NULL THEN CAST(coalesce(low, 0) + z AS BIGINT) END AS end_offset, error FROM resolved""", "form_blocks", **_CELL_SQL))
def cell_addresses(spark: SparkSession, d: str) -> DataFrame:
    segments, cells, edits = _inputs(spark, d)
    good = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return A.resolve(edits, segments, cells).select("doc_id", "op_index", good("block_index"), good("start_offset"), good("end_offset"), "error")


_CUT_SQL = dict(
    ranges="SELECT doc_id, b AS block_index, low + a AS x, low + z AS y FROM resolved WHERE error IS NULL AND z > a",
    touched="SELECT t.*, EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = t.doc_id AND r.block_index = t.block_index AND t.end_pos > r.x AND t.start_pos < r.y) AS hit FROM tseg t",
    chars="SELECT doc_id, block_index, seg_index, i, substring(text, i + 1, 1) AS ch, start_pos + i AS p FROM (SELECT *, unnest(range(length(text))) AS i FROM touched WHERE hit AND kind = 'text')",
    left_over="""SELECT doc_id, block_index, seg_index, string_agg(ch, '' ORDER BY i) AS t FROM chars c WHERE NOT EXISTS (SELECT 1 FROM ranges r
        WHERE r.doc_id = c.doc_id AND r.block_index = c.block_index AND c.p >= r.x AND c.p < r.y) GROUP BY ALL""",
    pieces="""SELECT doc_id, block_index, seg_index AS ord, CASE WHEN hit THEN 'text' ELSE kind END AS kind, CASE WHEN NOT hit THEN text WHEN kind = 'field' THEN '' ELSE coalesce(t, '') END AS text,
        CASE WHEN NOT hit THEN field_name END AS field_name, CASE WHEN NOT hit THEN switch END AS switch, CASE WHEN NOT hit THEN original_text END AS original_text
      FROM touched LEFT JOIN left_over USING (doc_id, block_index, seg_index)""",
    settled=_SETTLED,
)


@query("delete_range_in_cell", duck("SELECT doc_id, block_index, seg_index, kind, text, start_pos FROM settled", "form_blocks", **_CELL_SQL, **_CUT_SQL))
def delete_range_in_cell(spark: SparkSession, d: str) -> DataFrame:
    segments, cells, edits = _inputs(spark, d)
    keys = ("start_offset", "end_offset")
    return A.apply_in_cells(segments, A.resolve(edits, segments, cells), S.delete_ranges, keys)[0].select("doc_id", "block_index", "seg_index", "kind", "text", "start_pos")


_ADD_SQL = dict(
    # A field at the start or the end of the addressed paragraph.
    points="SELECT doc_id, op_index, b, low + CASE WHEN op_index = 1 THEN 0 ELSE size END AS p FROM resolved WHERE error IS NULL AND size IS NOT NULL",
    spots="""SELECT p.doc_id, op_index, b, p, arg_min(seg_index, seg_index) AS seg FROM points p JOIN tseg t ON t.doc_id = p.doc_id AND t.block_index = p.b
      WHERE kind = 'text' AND p BETWEEN start_pos AND end_pos GROUP BY ALL""",
    outcome="""SELECT r.doc_id, r.op_index, CASE WHEN r.error IS NULL AND s.seg IS NOT NULL THEN 'executed' ELSE 'failed' END AS status,
        coalesce(r.error, CASE WHEN s.seg IS NULL THEN CASE WHEN r.b IS NULL OR NOT EXISTS (SELECT 1 FROM shown x WHERE x.doc_id = r.doc_id AND x.block_index = r.b) THEN 'unknown block' ELSE 'offset not found' END END) AS error
      FROM resolved r LEFT JOIN spots s USING (doc_id, op_index)""",
)


@query("add_field_in_cell_status", duck("SELECT doc_id, CAST(op_index AS BIGINT) AS op_index, status, error FROM outcome", "form_blocks", **_CELL_SQL, **_ADD_SQL))
def add_field_in_cell_status(spark: SparkSession, d: str) -> DataFrame:
    segments, cells, edits = _inputs(spark, d)
    named = edits.withColumn("field_name", F.concat(F.lit("o_moi_"), F.col("op_index"))).withColumn("position", F.expr("CASE op_index WHEN 1 THEN 'left' ELSE 'right' END"))
    adds = A.beside(A.resolve(named, segments, cells)).withColumn("insert_after", F.lit(None).cast("string"))
    return A.apply_in_cells(segments, adds, S.add_field_at)[1]
