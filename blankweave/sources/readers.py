"""Readers: text, HTML, JSON columns and template stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.functions import text as T


# Elements that begin and end a block of text, and named characters.
BLOCK_TAGS = (
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html li link main meta nav ol option p pre section table tbody td tfoot th thead title tr ul"
).split()
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}
_BREAK = "\x1e"


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal characters; the ampersand last, so that nothing is decoded twice."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(1)))

    def put(done: Column, number: Column) -> Column:
        digits = F.when(F.lower(F.left(number, F.lit(1))) == "x", F.substring(number, 2, 6)).otherwise(F.hex(number.try_cast("int")))
        char = F.decode(F.unhex(F.lpad(digits, F.lit(8), F.lit("0"))), "UTF-32")
        return F.replace(done, F.concat(F.lit("&#"), number, F.lit(";")), char)

    text = F.when(text.contains("&#"), F.aggregate(numbers, text, put)).otherwise(text)
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Web pages -> one block for each run of text between block elements, whatever their case and attributes.

    Comments, scripts and styles are no text; inline tags vanish; white space is
    squeezed, as a browser shows it; runs without text are dropped.
    """
    silent = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>"
    breaks = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:\s[^>]*|/)?>"
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", silent, ""), breaks, _BREAK), "<[^>]*>", "")
    runs = F.transform(F.split(marked, _BREAK, -1), lambda run: T.strip(F.regexp_replace(decode_entities(run), r"(?U)\s+", " ")))
    return pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.filter(runs, lambda run: run != "")).alias("pos", "text")).select(
        "doc_id", F.col("pos").cast("bigint").alias("block_index"), "text"
    )


def read_values(requests: DataFrame, fields: DataFrame) -> DataFrame:
    """``requests(record_id, template_id, field_values JSON)`` -> a value per template field, '' when absent."""
    from blankweave.operators.merge import with_template

    parsed = requests.withColumn("_m", F.from_json("field_values", "MAP<STRING,STRING>")).drop("field_values")
    names = fields.select("template_id", "field_name").distinct()
    return with_template(parsed, names).select(
        "record_id", "field_name", F.coalesce(F.try_element_at("_m", F.col("field_name")), F.lit("")).alias("value")
    )


def read_locks(rows: DataFrame, key: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """JSON lists -> (key, field_name) rows and rejects; no text is an empty list, NULL items are dropped."""
    text = T.strip(F.col(raw))
    present = ~T.is_blank(F.col(raw))
    parsed = rows.where(present).withColumn(
        "_a", F.when(text.startswith("["), F.from_json(text, "ARRAY<STRING>"))
    )
    good = parsed.where("_a IS NOT NULL").select(key, F.explode("_a").alias("field_name")).where("field_name IS NOT NULL")
    bad = parsed.where("_a IS NULL").select(key, F.col(raw), F.lit("expected a JSON list").alias("reason"))
    return good, bad


def read_requirements(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """JSON object of lists -> number of wanted fields and their names, duplicates kept."""
    lists = F.from_json(raw, "MAP<STRING,ARRAY<STRING>>")
    names = F.flatten(F.filter(F.map_values(lists), lambda names: names.isNotNull()))
    return rows.select(key, F.coalesce(names, F.array().cast("array<string>")).alias("table_fields")).withColumn(
        "total_fields", F.size("table_fields").cast("bigint")
    )


EDIT_SCHEMA = (
    "type STRING, description STRING, block_index BIGINT, para_in_cell BIGINT, field_name STRING, old_name STRING, "
    "new_name STRING, occurrence_index BIGINT, position STRING, offset BIGINT, old_text STRING, new_text STRING, "
    "text STRING, start_offset BIGINT, end_offset BIGINT, selected_text STRING, format_config MAP<STRING,STRING>, "
    "paragraph_format MAP<STRING,STRING>, format_options MAP<STRING,STRING>, table_index BIGINT, row_index BIGINT, "
    "col_index BIGINT, rows BIGINT, cols BIGINT, image_path STRING, width DOUBLE, url STRING, "
    "blocks ARRAY<MAP<STRING,BIGINT>>"
)

# Columns an edit of each type cannot do without.
REQUIRED = {
    "rename_placeholder": ("old_name", "new_name"),
    "delete_placeholder": ("field_name",),
    "add_placeholder": ("block_index", "field_name"),
    "add_placeholder_by_offset": ("block_index", "offset", "field_name"),
    "update_text": ("block_index", "old_text", "new_text"),
    "delete_text_range": ("block_index", "start_offset", "end_offset"),
    "format_text": ("block_index", "selected_text", "format_config"),
    "format_paragraph": ("block_index", "paragraph_format"),
    "add_paragraph": (),
    "delete_paragraph": ("block_index",),
    "delete_multiple_paragraphs": ("blocks",),
    "add_page_break": ("block_index", "offset"),
    "add_table_row": ("table_index",),
    "delete_table_row": ("table_index", "row_index"),
    "add_table_column": ("table_index",),
    "delete_table_column": ("table_index", "col_index"),
    "format_table_cell": ("table_index", "row_index", "col_index", "format_options"),
    "add_table_at_cursor": ("block_index", "offset"),
    "add_image_at_cursor": ("block_index", "offset", "image_path"),
    "add_hyperlink": ("block_index", "start_offset", "end_offset", "url"),
}

# Allowed positions per type and bounds of numbers.
POSITIONS = {
    "add_placeholder": ("left", "right", "new_line"),
    "add_paragraph": ("after", "before", "end"),
    "add_table_row": ("above", "below"),
    "add_table_column": ("left", "right"),
}
DEFAULT_POSITION = {
    "add_placeholder": "right", "add_paragraph": "after", "add_table_row": "below", "add_table_column": "right",
}
NOT_NEGATIVE = (
    "block_index", "para_in_cell", "occurrence_index", "offset", "start_offset", "table_index", "row_index", "col_index",
)
#: Least sizes; a request of any larger size is good.
LEAST = {"rows": 1, "cols": 1, "width": 1}


def read_edits(requests: DataFrame, key: str = "template_id", raw: str = "operations") -> tuple[DataFrame, DataFrame]:
    """JSON operation lists -> edit rows ``(key, op_index, <wide columns>)`` and rejects with a reason."""
    parsed = requests.select(key, F.posexplode_outer(F.from_json(raw, f"ARRAY<STRUCT<{_as_struct(EDIT_SCHEMA)}>>")).alias("op_index", "op"))
    wide = parsed.select(key, F.col("op_index").cast("bigint").alias("op_index"), "op.*")
    checked = wide.withColumn("reason", edit_problem())
    defaults = F.create_map(*[F.lit(part) for pair in DEFAULT_POSITION.items() for part in pair])
    good = (
        checked.where("reason IS NULL").drop("reason")
        .withColumn("position", F.coalesce("position", F.try_element_at(defaults, F.col("type"))))
        .withColumn("rows", F.when(F.col("type") == "add_table_at_cursor", F.coalesce("rows", F.lit(3))).otherwise(F.col("rows")))
        .withColumn("cols", F.when(F.col("type") == "add_table_at_cursor", F.coalesce("cols", F.lit(3))).otherwise(F.col("cols")))
        .withColumn("width", F.when(F.col("type") == "add_image_at_cursor", F.coalesce("width", F.lit(4.0))).otherwise(F.col("width")))
    )
    bad = checked.where("reason IS NOT NULL").select(key, "op_index", "type", "reason")
    return good, bad


def _as_struct(schema: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in _split_columns(schema))


def _split_columns(schema: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in schema:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]


def edit_problem():
    """First reason why an edit row is unusable, NULL for a good one."""
    kind = F.col("type")
    reasons = [
        F.when(kind.isNull(), F.lit("no operation")),
        F.when(~kind.isin(*V.EDIT_TYPES), F.concat(F.lit("unknown type "), kind)),
    ]
    for name, columns in REQUIRED.items():
        for column in columns:
            reasons.append(F.when((kind == name) & F.col(column).isNull(), F.lit(f"{column} is required")))
    for name, allowed in POSITIONS.items():
        reasons.append(
            F.when((kind == name) & F.col("position").isNotNull() & ~F.col("position").isin(*allowed), F.lit("unknown position"))
        )
    for column in NOT_NEGATIVE:
        reasons.append(F.when(F.col(column) < 0, F.lit(f"{column} is negative")))
    reasons.append(F.when(F.col("end_offset") <= 0, F.lit("end_offset is not positive")))
    for column, low in LEAST.items():
        reasons.append(F.when(F.col(column) < low, F.lit(f"{column} is out of bounds")))
    return F.coalesce(*reasons)


def scan_templates(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``binaryFile`` rows -> accepted ``.docx`` files, of ``max_bytes`` at most if given, and rejects with a reason."""
    reason = F.when(~F.col("path").endswith(".docx"), F.lit("not a .docx file"))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, F.lit("file is too large"))
    checked = files.withColumn("reason", reason)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL").drop("content")


def page_count(app_xml):
    """Saved page count of a document's properties, NULL when absent or not a number."""
    return F.regexp_extract(app_xml, r"<(?:\w+:)?Pages>\s*(\d+)\s*</", 1).try_cast("int")


def resolve_artifact(wanted: DataFrame, templates: DataFrame, results: DataFrame, purpose: str) -> DataFrame:
    """Find ids in two stores; ``download`` looks at templates first, ``preview`` at results first."""
    first = "template" if purpose == "download" else "result"
    stores = templates.select("file_id", "path", F.lit("template").alias("store")).unionByName(
        results.select("file_id", "path", F.lit("result").alias("store"))
    )
    best = stores.groupBy("file_id").agg(
        F.min_by(F.struct("store", "path"), F.when(F.col("store") == first, 0).otherwise(1)).alias("_hit")
    )
    return wanted.join(best, "file_id", "left").select(
        "file_id", F.col("_hit.store").alias("store"), F.col("_hit.path").alias("path")
    )
