"""Word files -> blocks.

The one place where file bytes meet Python: each file becomes block rows inside
a ``mapInPandas`` batch, everything after that is Catalyst. ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds
what one batch holds.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.sources.readers import page_count, scan_templates

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCK_SCHEMA = (
    "path string, block_index bigint, type string, text string, style string, is_empty boolean, table_index bigint, "
    "row bigint, col bigint, colspan bigint, rowspan bigint, rows bigint, cols bigint, paragraphs bigint, "
    "tab_leaders array<string>, instrs array<string>, app_xml string, error string"
)
COLUMNS = [part.strip().split(" ")[0] for part in BLOCK_SCHEMA.split(",")]


def _text(element) -> str:
    """Visible text: runs, tabs and breaks in order."""
    shown = {f"{WORD}tab": "\t", f"{WORD}br": "\n"}
    inside_tabs = {tab for tabs in element.iter(f"{WORD}tabs") for tab in tabs}
    parts = []
    for node in element.iter():
        if node.tag == f"{WORD}t":
            parts.append(node.text or "")
        elif node.tag in shown and node not in inside_tabs:
            parts.append(shown[node.tag])
    return "".join(parts).strip()


def _instrs(element) -> list[str]:
    return [f.get(f"{WORD}instr", "") for f in element.iter(f"{WORD}fldSimple")]


def _leaders(paragraph) -> list[str]:
    stops = paragraph.findall(f"{WORD}pPr/{WORD}tabs/{WORD}tab")
    return [stop.get(f"{WORD}leader") or "none" for stop in stops]


def _val(element, path: str, default: str | None = None) -> str | None:
    found = element.find(path)
    return default if found is None else found.get(f"{WORD}val", default)


def _visible_cells(table) -> list[dict]:
    """Cells with logical column and spans; vertical continuations are not shown but lengthen the cell above."""
    cells, open_at = [], {}
    for r, row in enumerate(table.findall(f"{WORD}tr")):
        col = 0
        for cell in row.findall(f"{WORD}tc"):
            span = max(1, int(_val(cell, f"{WORD}tcPr/{WORD}gridSpan", "1")))
            merge = cell.find(f"{WORD}tcPr/{WORD}vMerge")
            how = None if merge is None else merge.get(f"{WORD}val", "continue")
            if how == "continue":
                if col in open_at:
                    open_at[col]["rowspan"] += 1
            else:
                paragraphs = cell.findall(f"{WORD}p")
                found = dict(
                    row=r, col=col, colspan=span, rowspan=1, text="\n".join(_text(p) for p in paragraphs).strip(),
                    instrs=_instrs(cell), paragraphs=len(paragraphs),
                )
                cells.append(found)
                open_at.pop(col, None)
                if how == "restart":
                    open_at[col] = found
            col += span
    return cells


def _table_rows(table, index: int) -> Iterator[dict]:
    cells = _visible_cells(table)
    for cell in cells:
        yield cell | dict(type="table_cell", table_index=index, is_empty=not cell["text"])
    if any(cell["text"] for cell in cells):
        lines: dict[int, list[str]] = {}
        for cell in cells:
            lines.setdefault(cell["row"], []).append(cell["text"])
        first = table.find(f"{WORD}tr")
        yield dict(
            type="table_summary", table_index=index, is_empty=False,
            text="\n".join(" | ".join(line) for line in lines.values() if any(t.strip() for t in line)),
            rows=len(table.findall(f"{WORD}tr")), cols=len(first.findall(f"{WORD}tc")),
        )


def parse_docx(path: str, content: bytes) -> list[dict]:
    """Block rows of one file; a broken file gives one row with an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
            names = set(archive.namelist())
            app_xml = archive.read("docProps/app.xml").decode("utf-8", "replace") if "docProps/app.xml" in names else None
            styles = {}
            if "word/styles.xml" in names:
                for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{WORD}style"):
                    styles[style.get(f"{WORD}styleId")] = _val(style, f"{WORD}name")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        return [dict(path=path, error=str(error))]
    rows, tables = [], 0
    for child in body:
        if child.tag == f"{WORD}p":
            text = _text(child)
            style = _val(child, f"{WORD}pPr/{WORD}pStyle")
            rows.append(dict(
                type="paragraph", text=text or "[EMPTY LINE]", style=styles.get(style, style) or "Normal", is_empty=not text,
                tab_leaders=_leaders(child), instrs=_instrs(child), paragraphs=1,
            ))
        elif child.tag == f"{WORD}tbl":
            rows += _table_rows(child, tables)
            tables += 1
    return [
        row | dict(path=path, block_index=i, app_xml=app_xml if i == 0 else None) for i, row in enumerate(rows)
    ]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = parse_docx(path, bytes(content))
            if rows:
                yield pd.DataFrame({name: pd.Series([row.get(name) for row in rows], dtype=object) for name in COLUMNS})


def read_docx(spark: SparkSession, path: str, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Folder or glob of templates -> (blocks, rejects with a reason).

    Rejected are other file types, files over ``max_bytes`` if given and files that
    do not parse. Blocks keep ``path`` as the document key.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    good, bad = scan_templates(files, max_bytes)
    parsed = good.select("path", "content").mapInPandas(_parse_batches, BLOCK_SCHEMA)
    broken = parsed.where("error IS NOT NULL").select("path", F.concat(F.lit("unreadable: "), F.col("error")).alias("reason"))
    return parsed.where("error IS NULL").drop("error"), bad.select("path", "reason").unionByName(broken)


def template_pages(blocks: DataFrame) -> DataFrame:
    """Saved page count per document, NULL when the file has none."""
    return blocks.where("block_index = 0").select("path", page_count(F.col("app_xml")).alias("page_count"))
