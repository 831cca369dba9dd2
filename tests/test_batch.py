"""Ordered requests of mixed edits."""

import re

from pyspark.sql import functions as F

from blankweave.operators import batch as B
from blankweave.operators import context as C
from blankweave.operators import fields as FL
from blankweave.operators import spans as S
from blankweave.operators import structure as ST
from blankweave.sources import paths
from blankweave.sources.readers import EDIT_SCHEMA

SEGMENTS = "doc_id bigint, block_index bigint, seg_index bigint, kind string, text string, field_name string, switch string, original_text string"
NAMES = [part.split(" ")[0] for part in EDIT_SCHEMA.split(", ")]


def forms(spark, documents):
    """``{doc_id: [block, ...]}``; ``«x»`` in a block stands for a field."""
    rows = []
    for doc, blocks in documents.items():
        for i, block in enumerate(blocks):
            for j, part in enumerate([p for p in re.split("(«[^»]+»)", block) if p] or [""]):
                name = part[1:-1] if part.startswith("«") else None
                rows.append((doc, i, j, "field" if name else "text", part, name, "s" if name else None, "..." if name else None))
    return FL.with_offsets(spark.createDataFrame(rows, SEGMENTS))


def requests(spark, documents):
    """``{doc_id: [edit, ...]}``"""
    rows = [(doc, i, *[edit.get(n) for n in NAMES]) for doc, edits in documents.items() for i, edit in enumerate(edits)]
    return spark.createDataFrame(rows, "doc_id bigint, op_index bigint, " + EDIT_SCHEMA)


def applied(spark, documents, edits, **options):
    modes = options.pop("modes", None)
    out, status = B.apply_edits(forms(spark, documents), requests(spark, edits), modes)
    texts = {}
    for r in C.shown_blocks(out).orderBy("doc_id", "block_index").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    told = {}
    for r in status.orderBy("doc_id", "op_index").collect():
        told.setdefault(r.doc_id, []).append((r.status, r.error))
    return texts, told


def rename(old, new):
    return {"type": "rename_placeholder", "old_name": old, "new_name": new}


def add(block, name, offset):
    return {"type": "add_placeholder_by_offset", "block_index": block, "field_name": name, "offset": offset}


def delete(name):
    return {"type": "delete_placeholder", "field_name": name}


def cut(block, start, end):
    return {"type": "delete_text_range", "block_index": block, "start_offset": start, "end_offset": end}


def update(block, old, new):
    return {"type": "update_text", "block_index": block, "old_text": old, "new_text": new}


DONE = ("executed", None)


def test_each_edit_sees_what_the_ones_before_it_left(spark):
    texts, told = applied(
        spark, {1: ["one «a» two", "three «b»"], 2: ["plain text"], 3: ["«x» and «y»"]},
        {
            1: [rename("a", "c"), rename("c", "d"), rename("b", "a"), cut(0, 0, 4), add(0, "new", 3), delete("a"), update(1, "three", "3 «z»"), rename("z", "zz"),
                {"type": "delete_paragraph", "block_index": 0}, {"type": "add_paragraph", "block_index": 0, "position": "before", "text": "top"},
                {"type": "add_paragraph", "position": "end", "text": "end"}],
            2: [add(0, "f", 5), rename("f", "g"), {"type": "add_placeholder", "block_index": 0, "field_name": "h", "position": "left"}, cut(0, 5, 12)],
            3: [rename("x", "t"), rename("y", "x"), rename("t", "y")],
        },
    )
    assert texts[1] == ["top", "3 «zz» ", "end"] and told[1] == [DONE] * 11
    # The cut touches the field, which goes as a whole.
    assert texts[2] == ["«h»pltext"] and told[2] == [DONE] * 4
    assert texts[3] == ["«y» and «x»"] and told[3] == [DONE] * 3


def test_a_failure_undoes_the_request_or_only_itself(spark):
    whole = {i: ["abc «a»", "def"] for i in range(1, 8)}
    edits = {
        1: [rename("a", "b"), delete("nobody"), rename("b", "c")],
        2: [rename("a", "b"), delete("nobody"), rename("b", "c")],
        3: [rename("a", "b"), cut(1, 50, 60), rename("b", "c")],
        4: [rename("a", "b"), cut(1, 50, 60), rename("b", "c")],
        5: [rename("a", "b"), cut(1, 50, 60)],
        6: [rename("a", "b"), {"type": "add_hyperlink", "block_index": 0, "url": "ftp://x", "start_offset": 0, "end_offset": 2}],
        7: [cut(7, 0, 1), rename("a", "b")],
    }
    modes = spark.createDataFrame(
        [(1, False, True), (2, False, False), (3, False, True), (4, False, False), (5, True, False), (6, None, None)], "doc_id bigint, validate_only boolean, stop_on_error boolean"
    )
    texts, told = applied(spark, whole, edits, modes=modes)
    unknown, nowhere = ("validation_failed", "unknown field"), ("failed", "range not found")
    assert told[1] == [DONE, unknown] and told[2] == [DONE, unknown, DONE] and told[3] == [DONE, nowhere] and told[4] == [DONE, nowhere, DONE]
    assert told[5] == [("validated", None), ("validation_failed", "range not found")] and told[6] == [DONE, ("validation_failed", "bad url")]
    assert told[7] == [("validation_failed", "unknown block")]
    assert texts[4] == ["abc «c»", "def"] and all(texts[i] == whole[i] for i in (1, 2, 3, 5, 6, 7))


def test_one_document_with_most_edits(spark):
    """Independent edits of a document share a level, so rounds don't grow with their number."""
    blocks = [f"text of block {i} «f{i}»" for i in range(120)]
    edits = {1: [e for i in range(120) for e in (rename(f"f{i}", f"g{i}"), add(i, f"n{i}", 4))], 2: [rename("f0", "q")], 3: []}
    documents = {1: blocks, 2: blocks[:2], 3: blocks[:1]}
    levels = B.dependency_levels(forms(spark, documents), requests(spark, edits))
    assert {r.op_index % 2: r.level for r in levels.where("doc_id = 1").select("op_index", "level").collect()} == {0: 1, 1: 2}
    assert levels.agg(F.max("level")).first()[0] == 2
    texts, told = applied(spark, documents, edits)
    assert texts[1] == [f"text«n{i}» of block {i} «g{i}»" for i in range(120)] and told[1] == [DONE] * 240
    assert texts[2] == ["text of block 0 «q»", blocks[1]] and texts[3] == blocks[:1]


def test_no_edits(spark):
    out, status = B.apply_edits(forms(spark, {1: ["a"]}), requests(spark, {1: [rename("a", "b")]}).where("false"))
    assert out.count() == 1 and status.count() == 0


def test_a_request_passes_its_document_once(spark, monkeypatch):
    """A chain of dependent edits is folded inside the row: one table is written, and the results are read from it as they are."""
    tables, plans, write = [], [], paths.written

    def counted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        tables.append(name)
        return write(df, name)

    monkeypatch.setattr(B, "written", counted)
    names = "abcdefghij"
    documents = {i: ["x «a» y", "z"] for i in range(4)}
    edits = {i: [rename(x, y) for x, y in zip(names, names[1:])] for i in range(4)}
    out, status = B.apply_edits(forms(spark, documents).repartition("doc_id"), requests(spark, edits))
    assert len(tables) == 1
    # Of the segments of forms(), of documents and of edits; none for a level.
    assert plans[0].count("Exchange hashpartitioning") <= 3, plans[0]
    for df in (out, status):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    alone = B.edit_status(forms(spark, documents), requests(spark, edits))
    assert alone.exceptAll(status).count() == 0 and status.exceptAll(alone).count() == 0 and len(tables) == 1
    assert {r.text for r in C.shown_blocks(out).collect()} == {"x «j» y", "z"}
    assert status.where("status = 'executed'").count() == 4 * 9


def test_edits_in_the_row_do_what_the_operators_do(spark):
    """One kind of edit per document against the operator on all segments."""
    block = ["«a» one «b» .. «a»", "text ....", "two «a»«c_2»", "", "««b» tail _____"]
    rest = {"position": "right"}
    cases = {
        1: ("rename", [{**rename("a", "n"), "occurrence_index": 1}]),
        2: ("rename", [{**rename("a_7", "n"), "occurrence_index": None}]),
        3: ("delete", [delete("a")]),
        4: ("delete", [delete("a_3")]),
        5: ("at", [add(1, "n", 3)]),
        6: ("at", [add(0, "n", 1)]),
        7: ("cut", [cut(0, 2, 9)]),
        8: ("cut", [cut(1, 0, 50)]),
        9: ("add", [{"type": "add_placeholder", "block_index": 1, "field_name": "n", **rest}]),
        10: ("add", [{"type": "add_placeholder", "block_index": 4, "field_name": "n", "position": "new_line"}]),
        11: ("add", [{"type": "add_placeholder", "block_index": 3, "field_name": "n", "position": "left"}]),
        12: ("update", [update(0, "one «b»", "1 «b» «m»"), update(1, "two", "2"), update(3, "", "new")]),
        13: ("paragraph", [{"type": "delete_paragraph", "block_index": 2}]),
    }
    asked = requests(spark, {doc: edits for doc, (_, edits) in cases.items()})
    documents = {doc: block for doc in cases}
    segments = forms(spark, documents)
    out, status = B.apply_edits(segments, asked)
    found = sorted(map(repr, out.select(*segments.columns).collect()))
    expected = []
    none = F.lit(None).cast("bigint")
    for kind, apply in {
        "rename": lambda s, e: S.rename_field(s, e.select("doc_id", "op_index", "old_name", "new_name", "occurrence_index"))[0],
        "delete": lambda s, e: S.delete_field(s, e)[0],
        "at": lambda s, e: S.add_field_at(s, e.withColumn("insert_after", F.lit(None).cast("string")))[0],
        "cut": lambda s, e: S.delete_ranges(s, e.select("doc_id", "block_index", "start_offset", "end_offset"))[0],
        "add": lambda s, e: S.add_field(s, e)[0],
        "update": lambda s, e: ST.update_text(s, e)[0],
        "paragraph": lambda s, e: S.delete_blocks(s, e.select("doc_id", "block_index", none.alias("start_offset"), none.alias("end_offset"))),
    }.items():
        own = F.col("doc_id").isin(*[doc for doc, (k, _) in cases.items() if k == kind])
        expected += map(repr, apply(segments.where(own), asked.where(own)).select(*segments.columns).collect())
    failed = {r.doc_id: r.error for r in status.where("status <> 'executed'").collect()}
    assert failed == {6: "offset not found"}
    assert found == sorted(expected)
