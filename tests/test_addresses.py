"""Edits that name a cell and a paragraph in it."""

from pyspark.sql import functions as F

from blankweave.operators import addresses as A
from blankweave.operators import context as C
from blankweave.operators import spans as S

from test_batch import forms

CELLS = "doc_id bigint, table_index bigint, row bigint, col bigint, colspan bigint, rowspan bigint, block_index bigint"
EDITS = "doc_id bigint, op_index bigint, table_index bigint, row_index bigint, col_index bigint, block_index bigint, para_in_cell bigint, start_offset bigint, end_offset bigint, position string, field_name string"


def table(spark):
    segments = forms(spark, {1: ["plain", "one\ntwo «f» end\n", "", "wide"], 2: ["plain"]})
    # The first row holds a cell of two rows and one of two columns.
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 2, 1), (1, 0, 0, 1, 2, None, 2), (1, 0, 1, 1, None, None, 3)], CELLS)
    return segments, cells


def edits(spark, *rows):
    return spark.createDataFrame([(1, i, *row) for i, row in enumerate(rows)], EDITS)


def test_addresses_find_block_and_range(spark):
    segments, cells = table(spark)
    asked = edits(
        spark, (0, 0, 0, None, 1, 0, 3, None, None), (0, 1, 0, None, 1, 0, 3, None, None), (0, 0, 2, None, None, 0, 0, None, None), (0, 0, 0, None, None, 0, 1, None, None),
        (0, 0, 0, None, 2, 0, 0, None, None), (0, 0, 0, None, 3, 0, 0, None, None), (0, 9, 0, None, 0, 0, 1, None, None), (0, 1, 1, None, 0, 0, 5, None, None),
        (None, None, None, 1, 0, 1, 2, None, None), (None, None, None, 0, None, 1, 3, None, None), (1, 0, 0, None, 0, 0, 1, None, None),
    )
    got = {r.op_index: r for r in A.resolve(asked, segments, cells).collect()}
    assert [(got[i].block_index, got[i].start_offset, got[i].end_offset, got[i].error) for i in (0, 1, 2, 8, 9)] == [
        (1, 4, 7, None), (1, 4, 7, None), (2, 0, 0, None), (1, 1, 2, None), (0, 1, 3, None),
    ]
    assert [got[i].error for i in (3, 5, 6, 7, 10)] == ["cell has several paragraphs", "unknown paragraph", "unknown cell", "offset outside the paragraph", "unknown cell"]
    assert (got[4].para_start, got[4].para_end, got[4].error) == (16, 16, None)
    first = A.resolve(asked, segments, cells, first_by_default=True).where("op_index = 3").first()
    assert (first.error, first.start_offset) == (None, 0)


def test_operators_take_edits_in_cells(spark):
    segments, cells = table(spark)
    cut = edits(spark, (0, 0, 0, None, 1, 0, 4, None, None), (0, 0, 0, None, 0, 2, 3, None, None), (0, 0, 0, None, None, 0, 1, None, None))
    out, status = A.apply_in_cells(segments, A.resolve(cut, segments, cells), S.delete_ranges, ("start_offset", "end_offset"))
    assert [r.text for r in C.shown_blocks(out).where("doc_id = 1").orderBy("block_index").collect()] == ["plain", "on\n«f» end\n", "", "wide"]
    assert [(r.op_index, r.status) for r in status.orderBy("op_index").collect()] == [(0, "executed"), (1, "executed"), (2, "failed")]
    adds = edits(spark, (0, 0, 0, None, 1, None, None, "left", "x"), (0, 1, 1, None, None, None, None, "right", "y"), (0, 0, 0, None, 7, None, None, "left", "z"))
    placed = A.beside(A.resolve(adds, segments, cells)).withColumn("insert_after", F.lit(None).cast("string"))
    out, status = A.apply_in_cells(segments, placed, S.add_field_at)
    assert [r.text for r in C.shown_blocks(out).where("doc_id = 1").orderBy("block_index").collect()] == ["plain", "one\n«x»two «f» end\n", "", "wide«y»"]
    assert [(r.status, r.error) for r in status.orderBy("op_index").collect()] == [("executed", None), ("executed", None), ("failed", "unknown paragraph")]


def test_one_document_with_most_cells_and_edits(spark):
    blocks = [f"a{i}\nb{i}" for i in range(3000)]
    segments = spark.range(3000).selectExpr(
        "1L AS doc_id", "id AS block_index", "0L AS seg_index", "'text' AS kind", "concat('a', id, '\\nb', id) AS text", "cast(NULL AS string) AS field_name",
        "cast(NULL AS string) AS switch", "cast(NULL AS string) AS original_text", "0L AS start_pos", "cast(length(concat('a', id, '\\nb', id)) AS bigint) AS end_pos",
    )
    cells = spark.range(3000).selectExpr("1L AS doc_id", "0L AS table_index", "id DIV 3 AS row", "id % 3 AS col", "1L AS colspan", "1L AS rowspan", "id AS block_index")
    asked = spark.range(3000).selectExpr("1L AS doc_id", "id AS op_index", "0L AS table_index", "id DIV 3 AS row_index", "id % 3 AS col_index", "cast(NULL AS bigint) AS block_index", "1L AS para_in_cell", "0L AS start_offset", "1L AS end_offset")
    out, status = A.apply_in_cells(segments, A.resolve(asked, segments, cells), S.delete_ranges, ("start_offset", "end_offset"))
    assert status.where("status = 'executed'").count() == 3000
    assert {r.text for r in C.shown_blocks(out).collect()} == {b.replace("\nb", "\n") for b in blocks}
