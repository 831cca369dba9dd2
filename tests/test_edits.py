"""Several edits of one block, field, cell or table in one request."""

from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.operators import context as C
from blankweave.operators import fields as FL
from blankweave.operators import merge as M
from blankweave.operators import spans as S
from blankweave.operators import structure as ST
from blankweave.operators import tables as G
from blankweave.sources.readers import html_blocks, read_edits

SEGMENTS = "doc_id bigint, block_index bigint, seg_index bigint, kind string, text string, field_name string, switch string, original_text string"


def template(spark, *blocks):
    """Each block is a list of texts; ``«x»`` stands for a field."""
    rows = []
    for i, block in enumerate(blocks):
        for j, part in enumerate(block):
            name = part[1:-1] if part.startswith("«") else None
            rows.append((1, i, j, "field" if name else "text", part, name, V.SWITCH_UPPER if name else None, "...." if name else None))
    return FL.with_offsets(spark.createDataFrame(rows, SEGMENTS))


def texts(segments):
    return [r.text for r in C.shown_blocks(segments).orderBy("block_index").collect()]


def statuses(status):
    return [r.status for r in status.orderBy("op_index").collect()]


def edits(spark, columns, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id bigint, op_index bigint, " + columns)


def test_two_spans_of_a_block_keep_its_text(spark):
    segments = template(spark, ["first"], ["second block here"]).withColumn("attrs", F.create_map().cast("map<string,string>"))
    spans = edits(spark, "block_index bigint, start_offset bigint, end_offset bigint, config map<string,string>",
                  (1, 0, 9, {"bold": "true"}), (1, 7, 12, {"italic": "true"}), (1, 5, 99, {"bold": "true"}))
    out, status = S.overlay_span_attrs(segments, spans)
    assert texts(out) == ["first", "second block here"] and statuses(status) == ["executed", "executed", "failed"]
    parts = [(r.text, sorted(r.attrs)) for r in out.where("block_index = 1").orderBy("seg_index").collect()]
    assert parts == [("second ", ["bold"]), ("bl", ["bold", "italic"]), ("ock", ["italic"]), (" here", [])]


def test_adds_on_both_sides_and_one_name_twice(spark):
    adds = edits(spark, "block_index bigint, field_name string, position string",
                 (1, "f1", "left"), (1, "f2", "right"), (0, "f1", "right"), (1, "f3", "new_line"), (1, "f4", "right"))
    out, status = S.add_field(template(spark, ["first"], ["second block here"]), adds)
    assert texts(out) == ["first", "«f1»second block here«f2»«f4»", "«f3»"]
    assert statuses(status) == ["executed", "executed", "failed", "executed", "executed"]


def test_several_points_of_a_block(spark):
    adds = edits(spark, "block_index bigint, field_name string, offset bigint, insert_after string",
                 (0, "a", 3, None), (0, "b", 1, None), (0, "c", 3, None), (0, "a", 0, None), (0, "d", None, "ef"), (0, "e", None, "zz"))
    out, status = S.add_field_at(template(spark, ["abcdef"]), adds)
    assert texts(out) == ["a«b»bc«a»«c»def«d»"]
    assert statuses(status) == ["executed", "executed", "executed", "failed", "executed", "failed"]


def test_renames_of_single_occurrences(spark):
    segments = template(spark, ["«x»", " mid ", "«x»"], ["«y»"])
    renames = edits(spark, "old_name string, new_name string, occurrence_index bigint",
                    ("x", "p", 0), ("x", "q", 1), ("x", "r", 0), ("y", "p", None))
    out, status = S.rename_field(segments, renames)
    assert texts(out) == ["«p» mid «q»", "«y»"] and statuses(status) == ["executed", "executed", "failed", "failed"]


def test_updates_of_a_block_follow_each_other(spark):
    updates = edits(spark, "block_index bigint, old_text string, new_text string",
                    (0, "second", "2nd"), (0, "2nd block", "B"), (0, "far away", "near"), (0, "nowhere", "all new"), (9, "x", "y"))
    out, status = ST.update_text(template(spark, ["second block here"], ["a"], ["b"], ["c"], ["d"], ["e far away"]), updates)
    assert texts(out) == ["all new", "a", "b", "c", "d", "e near"]
    assert [(r.how, r.target_block) for r in status.orderBy("op_index").collect()] == [
        ("exact", 0), ("exact", 0), ("exact", 5), ("rewrite", 0), ("failed", None)]
    near, _ = ST.update_text(template(spark, ["a"], ["b"], ["c"]), edits(spark, "block_index bigint, old_text string, new_text string", (0, "c", "x")), look_ahead=1)
    assert texts(near) == ["x", "b", "c"]


def test_two_page_breaks_and_splits_of_a_block(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", "abcdef"), (1, 1, "paragraph", "")], "doc_id bigint, block_index bigint, type string, text string")
    inserts = edits(spark, "block_index bigint, offset bigint, what string, rows bigint, cols bigint, image_path string, width double",
                    (0, 4, "page_break", None, None, None, None), (0, 2, "page_break", None, None, None, None), (1, 0, "image", None, None, "p", 2.0), (0, 2, "table", 30, 1, None, None))
    out, status = ST.insert_structure(blocks, inserts)
    rows = [(r.type, r.text) for r in out.orderBy("block_index").collect()]
    assert rows == [("paragraph", "ab"), ("page_break", ""), *[("table_cell", "")] * 30, ("paragraph", "cd"), ("page_break", ""), ("paragraph", "ef"), ("paragraph", ""), ("image", "")]
    assert statuses(status) == ["executed"] * 4
    adds = spark.createDataFrame([(1, 1, 0, "after", "x", 2, None), (1, 2, 0, "after", "y", 4, None), (1, 3, 0, "after", "n", None, None), (1, 4, 0, "after", "m", None, None)],
                                 "doc_id bigint, add_id bigint, block_index bigint, position string, text string, offset bigint, para_in_cell bigint")
    got = ST.add_block(blocks.where("block_index = 0"), adds).orderBy("block_index").collect()
    assert [r.text for r in got] == ["ab", "cd", "ef", "n", "m"]


def test_two_row_edits_of_a_table(spark):
    cells = spark.createDataFrame([(7, r, c, f"{r}{c}") for r in range(3) for c in range(2)], "table_id bigint, row bigint, col bigint, text string")
    rows = [(7, 0, "delete", 0, None), (7, 1, "delete", 0, None), (7, 2, "delete", 0, None), (7, 3, "insert", 0, "below"), (8, 0, "insert", 0, "below")]
    out, status = G.edit_table_rows(cells, spark.createDataFrame(rows, "table_id bigint, op_index bigint, action string, at bigint, position string"))
    assert sorted((r.row, r.col, r.text) for r in out.collect()) == [(0, 0, "20"), (0, 1, "21"), (1, 0, ""), (1, 1, "")]
    assert [(r.table_id, r.status, r.error) for r in status.orderBy("table_id", "op_index").collect()] == [
        (7, "executed", None), (7, "executed", None), (7, "failed", "the last row stays"), (7, "executed", None), (8, "failed", "unknown table")]


def test_formats_fold_in_order(spark):
    blocks = spark.createDataFrame([(1, 0, {"alignment": "left"})], "doc_id bigint, block_index bigint, attrs map<string,string>")
    formats = edits(spark, "block_index bigint, paragraph_format map<string,string>",
                    (0, {"alignment": "center", "spaceAfter": "6"}), (0, {"alignment": "distribute"}), (0, {"alignment": "both"}))
    out, status = S.set_block_attrs(blocks, formats)
    assert out.first().attrs == {"alignment": "both", "space_after": "6"} and statuses(status) == ["executed", "failed", "executed"]


def test_repeated_values_leave_one_row(spark):
    records = spark.createDataFrame([(1, 5)], "record_id bigint, template_id bigint")
    letter = template(spark, ["Tên: ", "«a»"]).withColumn("template_id", F.lit(5).cast("bigint"))
    values = spark.createDataFrame([(1, "a", "old", 1), (1, "a", "new", 2), (1, "a", "mid", 1)], "record_id bigint, field_name string, value string, value_order int")
    assert [r.text for r in M.render_documents(records, letter, values).collect()] == ["Tên: NEW"]
    assert [r.shown for r in M.merge_values(records, letter.where("kind = 'field'"), values).collect()] == ["NEW"]


def test_a_long_blank_comes_back_whole(spark):
    blocks = spark.createDataFrame([(5, 0, "Tên: " + "." * 80)], "doc_id bigint, block_index bigint, text string")
    segments = FL.convert_blocks(blocks).withColumn("template_id", F.col("doc_id"))
    records = spark.createDataFrame([(1, 5)], "record_id bigint, template_id bigint")
    empty = spark.createDataFrame([], "record_id bigint, field_name string, value string")
    assert M.render_documents(records, segments, empty).first().text == "Tên: " + "." * 80


def test_best_paragraph_of_a_cell(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a b\nc d"), (1, 1, 0, "x\na c")], "table_id bigint, row bigint, col bigint, text string")
    hints = spark.createDataFrame([(1, "a c", "n")], "table_id bigint, hint string, name string")
    assert [tuple(r) for r in G.best_matching_cell(cells, hints).collect()] == [(1, 1, 0, 1)]


def test_html_of_any_element(spark):
    html = '<H1 id="a">Head &amp; &#233;&lt;</H1><P class=x>one <b>two</b><br>three</P><ul><LI>item<script>var t="</p>";</script></LI></ul><!-- <p>no</p> -->tail'
    rows = html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id bigint, html string")).orderBy("block_index").collect()
    assert [r.text for r in rows] == ["Head & é<", "one two", "three", "item", "tail"]


def test_read_edits_rejects(spark):
    raw = (
        '[{"type":"add_placeholder","block_index":1,"field_name":"a"},{"type":"fly"},{"type":"add_placeholder","block_index":1},'
        '{"type":"add_table_at_cursor","block_index":1,"offset":0,"rows":0},{"type":"add_table_row","table_index":0,"position":"up"},'
        '{"type":"add_table_at_cursor","block_index":1,"offset":0,"rows":21,"cols":40}]'
    )
    df = spark.createDataFrame([(1, raw), (2, "not json")], "template_id bigint, operations string")
    good, bad = read_edits(df)
    assert [(r.op_index, r.position, r.rows) for r in good.orderBy("op_index").collect()] == [(0, "right", None), (5, None, 21)]
    reasons = {(r.template_id, r.op_index): r.reason for r in bad.collect()}
    assert reasons == {
        (1, 1): "unknown type fly", (1, 2): "field_name is required", (1, 3): "rows is out of bounds",
        (1, 4): "unknown position", (2, None): "no operation",
    }


def test_adds_of_one_name_in_two_blocks_and_adds_to_no_block(spark):
    from blankweave.operators import fields as FL
    from blankweave.operators import spans as S

    blocks = spark.createDataFrame([(1, 0, "A ...."), (1, 1, "B"), (None, 0, "C")], "doc_id bigint, block_index bigint, text string")
    adds = spark.createDataFrame(
        [(1, 2, 0, "x", 0, None), (1, 1, 1, "x", 99, None), (1, 3, 1, "y", 1, None), (1, 4, 7, "z", 0, None), (1, 5, 1, "field", 0, None), (None, 1, 0, "w", 0, None), (2, 1, 0, "v", 0, None)],
        "doc_id bigint, op_index bigint, block_index bigint, field_name string, offset bigint, insert_after string",
    )
    out, status = S.add_field_at(FL.convert_blocks(blocks), adds)
    got = {(r.doc_id, r.op_index): r.error for r in status.collect()}
    # The earlier add holds its name though its point is missed; null is no document.
    assert got == {
        (1, 1): "offset not found", (1, 2): "name in use", (1, 3): None, (1, 4): "unknown block", (1, 5): "name in use",
        (None, 1): "unknown block", (2, 1): "unknown block",
    }
    texts = sorted((r.doc_id or 0, r.block_index, r.seg_index, r.text) for r in out.collect())
    assert texts == [(0, 0, 0, "C"), (1, 0, 0, "A"), (1, 0, 1, "«field»"), (1, 1, 0, "B"), (1, 1, 1, "«y»")]
