"""Word files, stores and sinks."""

import zipfile

from pyspark.sql import functions as F

from blankweave.functions import text as T
from blankweave.operators import tables as G
from blankweave.sources.docx import read_docx, template_pages
from blankweave.sources.readers import read_locks, resolve_artifact
from blankweave.sources.writers import write_results

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def run(text):
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def paragraph(*parts, style=None, tabs=()):
    stops = "".join(f'<w:tab w:val="left" w:leader="{leader}" w:pos="1"/>' for leader in tabs)
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f"<w:tabs>{stops}</w:tabs>" if tabs else "")
    return f"<w:p><w:pPr>{props}</w:pPr>{''.join(parts)}</w:p>"


def cell(text, span=1, merge=None):
    props = f'<w:gridSpan w:val="{span}"/>' if span > 1 else ""
    if merge:
        props += '<w:vMerge w:val="restart"/>' if merge == "restart" else "<w:vMerge/>"
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{paragraph(run(text))}</w:tc>"


def write_docx(path, body, pages=None):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        archive.writestr(
            "word/styles.xml",
            f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>',
        )
        if pages is not None:
            archive.writestr("docProps/app.xml", f"<Properties><Pages>{pages}</Pages></Properties>")


def test_docx_blocks(spark, tmp_path):
    field = '<w:fldSimple w:instr=" MERGEFIELD ten \\* Upper \\z &quot;....&quot; "><w:r><w:t>«ten»</w:t></w:r></w:fldSimple>'
    table = (
        "<w:tbl><w:tr>" + cell("A", span=2) + cell("B", merge="restart") + "</w:tr><w:tr>"
        + cell("c") + cell("") + cell("", merge="continue") + "</w:tr></w:tbl>"
    )
    body = (
        paragraph(run("Mở đầu"), style="H1") + paragraph(run("Tên: "), field) + paragraph()
        + paragraph(run("Lớp"), "<w:r><w:tab/></w:r>", run("x"), tabs=("dot",)) + table
    )
    write_docx(tmp_path / "a.docx", body, pages="7")
    write_docx(tmp_path / "b.docx", paragraph(run("chỉ một dòng")), pages="nhiều")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "D.DOCX").write_bytes(b"x")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "big.docx").write_bytes(b"0" * (10 * 1024 * 1024 + 1))
    blocks, rejects = read_docx(spark, str(tmp_path), max_bytes=10 * 1024 * 1024)
    rows = blocks.where(F.col("path").endswith("a.docx")).orderBy("block_index").collect()
    assert [(r.type, r.text) for r in rows] == [
        ("paragraph", "Mở đầu"), ("paragraph", "Tên: «ten»"), ("paragraph", "[EMPTY LINE]"), ("paragraph", "Lớp\tx"),
        ("table_cell", "A"), ("table_cell", "B"), ("table_cell", "c"), ("table_cell", ""), ("table_summary", "A | B\nc | "),
    ]
    assert [(r.row, r.col, r.colspan, r.rowspan) for r in rows[4:8]] == [(0, 0, 2, 1), (0, 2, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]
    assert rows[0].style == "Heading 1" and rows[1].instrs == [' MERGEFIELD ten \\* Upper \\z "...." '] and rows[3].tab_leaders == ["dot"]
    assert blocks.where("block_index = 3 AND size(tab_leaders) = 1").select(T.has_blank(F.col("text"), F.col("tab_leaders"))).first()[0]
    pages = {r.path.rsplit("/", 1)[1]: r.page_count for r in template_pages(blocks).collect()}
    assert pages == {"a.docx": 7, "b.docx": None}
    reasons = {r.path.rsplit("/", 1)[1]: r.reason.split(":")[0] for r in rejects.collect()}
    assert reasons == {
        "c.txt": "not a .docx file", "D.DOCX": "not a .docx file", "broken.docx": "unreadable", "big.docx": "file is too large",
    }


def test_results_are_idempotent(spark, tmp_path):
    merged = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (1, 8, "c")], "record_id bigint, template_id bigint, text string")
    for _ in range(2):
        write_results(merged, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and back.select("result_id").distinct().count() == 3


def test_artifacts(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "file_id string")
    templates = spark.createDataFrame([("a", "t/a")], "file_id string, path string")
    results = spark.createDataFrame([("a", "r/a"), ("b", "r/b")], "file_id string, path string")
    found = lambda purpose: {
        r.file_id: r.path for r in resolve_artifact(wanted, templates, results, purpose).collect()
    }
    assert found("download") == {"a": "t/a", "b": "r/b", "c": None}
    assert found("preview") == {"a": "r/a", "b": "r/b", "c": None}


def test_locks(spark):
    df = spark.createDataFrame([(1, '["a", null, 5]'), (2, None), (3, " "), (4, '{"a": 1}'), (5, "x"), (6, "[]")], "k int, raw string")
    good, bad = read_locks(df, "k", "raw")
    assert sorted((r.k, r.field_name) for r in good.collect()) == [(1, "5"), (1, "a")]
    assert sorted(r.k for r in bad.collect()) == [4, 5]


def test_growth_plan(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, "A"), (1, 0, 1, "B"), (1, 1, 0, " .. "), (1, 1, 1, "x"), (2, 0, 0, "chỉ tiêu đề"), (3, 0, 0, "A"), (3, 1, 0, "b")],
        "table_id bigint, row bigint, col bigint, text string",
    )
    required = spark.createDataFrame([(1, 4), (2, 3), (3, 2)], "table_id bigint, required bigint")
    plan = {r.table_id: (r.empty_cells, r.rows_to_add, r.empty_after) for r in G.expansion_plan(cells, required).collect()}
    assert plan == {1: (1, 3, 4), 2: (0, 0, 0), 3: (0, 2, 2)}
