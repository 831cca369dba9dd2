"""Readable contexts of a template, for people and for a text model.

The input is ``shown_blocks`` (text as a reader sees it, fields as ``«name»``),
optionally with ``type``, ``row`` and ``col`` columns. Each output row is one
line, or one document: a document is bounded by the ingest limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blankweave.functions import text as T
from blankweave.operators import blocks as B
from blankweave.operators import fields as FL


def shown_blocks(segments: DataFrame, **gathered: Column) -> DataFrame:
    """Segments -> blocks with the text a reader sees, fields as ``«name»``, and what else is ``gathered`` of their segments."""
    parts = F.array_sort(F.collect_list(F.struct("seg_index", "text")))
    others = [value.alias(name) for name, value in gathered.items()]
    return segments.groupBy("doc_id", "block_index").agg(parts.alias("_p"), *others).select(
        "doc_id", "block_index", F.array_join(F.col("_p.text"), "").alias("text"), *gathered
    )


def lines_by_document(lines: DataFrame, line: Column, name: str, glue: str = "\n") -> DataFrame:
    """Join lines in block order, one text per document."""
    ordered = F.array_sort(F.collect_list(F.struct("block_index", line.alias("line"))))
    return lines.groupBy("doc_id").agg(ordered.alias("_l")).select(
        "doc_id", F.array_join(F.col("_l.line"), glue).alias(name)
    )


def _kind(blocks: DataFrame) -> Column:
    return F.col("type") if "type" in blocks.columns else F.lit("paragraph")


def _cell_position(blocks: DataFrame) -> tuple[Column, Column]:
    if "row" in blocks.columns:
        return F.col("row").cast("string"), F.col("col").cast("string")
    return F.lit("?"), F.lit("?")


def flat(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def full_text(blocks: DataFrame) -> DataFrame:
    """Non-empty blocks joined by newline."""
    spoken = blocks.where(~T.is_blank(F.col("text")))
    return lines_by_document(spoken, T.strip(F.col("text")), "full_text")


def section_outline(headed: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct headings in first-seen order, with their rank from 1."""
    first = (
        headed.where("nearest_heading <> ''")
        .groupBy("doc_id", F.col("nearest_heading").alias("heading"))
        .agg(F.min("block_index").alias("first_block"))
    )
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("first_block"))
    ranked = first.withColumn("rank", rank.cast("bigint"))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def full_context(blocks: DataFrame) -> DataFrame:
    """``[i] text`` lines, newlines flattened."""
    line = T.strip(flat(F.col("text")))
    numbered = F.concat(F.lit("["), F.col("block_index").cast("string"), F.lit("] "), line)
    return lines_by_document(blocks.where(~T.is_blank(F.col("text"))), numbered, "context")


def known_fields(fields: DataFrame) -> DataFrame:
    """One row per document: its field names in template order."""
    first_use = F.array_sort(F.collect_list(F.struct("block_index", "seg_index", "field_name")))
    return fields.groupBy("doc_id").agg(first_use.alias("_k")).select(
        "doc_id", F.array_distinct(F.col("_k.field_name")).alias("_known")
    )


def _fields_here(text: Column, known: Column) -> Column:
    """Known fields a text shows, in template order."""
    shown = T.fields_in_text(text)
    return F.when(F.size(F.array_intersect(shown, known)) > 0, F.array_intersect(known, shown)).otherwise(
        F.array().cast("array<string>")
    )


def field_context(
    blocks: DataFrame, fields: DataFrame, forced: DataFrame | None = None,
    text_chars: int | None = None, neighbour_chars: int | None = None,
) -> DataFrame:
    """One line per block with fields: fields, position, section, text and neighbours.

    Blocks and field lists meet per document, so the windows and the join share
    one partitioning.
    """
    wanted = fields
    if forced is not None:
        renamed = forced.select("doc_id", F.col("old_name").alias("field_name"))
        wanted = fields.join(renamed, ["doc_id", "field_name"], "left_anti")
    around = B.with_neighbours(B.with_headings(blocks)).where(F.col("text").contains("«"))
    joined = around.join(known_fields(wanted), "doc_id").withColumn("_here", _fields_here(F.col("text"), F.col("_known")))
    kind = _kind(blocks)
    row, col = _cell_position(blocks)

    def near(context: str, at: int) -> Column:
        return F.coalesce(T.first_chars(F.try_element_at(context, F.lit(at)), neighbour_chars), F.lit(""))

    place = F.when(kind == "table_cell", F.concat(F.lit(" | Row:"), row, F.lit(" Col:"), col)).otherwise(
        F.concat(F.lit(" | Truoc:["), near("before_context", -1), F.lit("] Sau:["), near("after_context", 1), F.lit("]"))
    )
    section = F.when(F.col("nearest_heading") == "", F.lit("preamble")).otherwise(F.col("nearest_heading"))
    line = F.concat(
        F.lit("Fields:["), F.array_join(F.transform("_here", T.field_mark), ", "), F.lit("] | block="),
        F.col("block_index").cast("string"), F.lit(" | "), kind, F.lit(" | Section:["), section, F.lit("] | Text:["),
        T.first_chars(flat(F.col("text")), text_chars), F.lit("]"), place,
    )
    return joined.where(F.size("_here") > 0).select("doc_id", "block_index", line.alias("line"))


def _flagged_blocks(blocks: DataFrame, fields: DataFrame, requests: DataFrame) -> DataFrame:
    """Spoken blocks, renumbered, with heading and the flags ``in_halo`` and ``in_request``.

    Blocks without text stay in a group of their own (``_spoken`` false), so
    that documents without any text are not lost. Everything clusters on
    ``doc_id``.
    """
    numbers = requests.select("doc_id", T.requested_numbers(F.col("user_text")).alias("_wanted"))
    spoken = blocks.withColumn("_spoken", ~T.is_blank(F.col("text")))
    group = W.partitionBy("doc_id", "_spoken").orderBy("block_index")
    headed = B.with_headings(spoken.withColumn("_number", (F.row_number().over(group) - 1).cast("bigint")))
    joined = headed.join(known_fields(fields), "doc_id", "left").join(numbers, "doc_id", "left")
    known = F.coalesce("_known", F.array().cast("array<string>"))
    has = F.when(F.col("text").contains("«"), F.arrays_overlap(T.fields_in_text(F.col("text")), known)).otherwise(F.lit(False))
    near = F.max("_has").over(group.rowsBetween(-1, 1))
    return (
        joined.withColumn("_has", F.coalesce(has, F.lit(False)))
        .withColumn("in_halo", F.col("_spoken") & near)
        .withColumn(
            "in_request",
            F.col("_spoken") & F.coalesce(F.array_contains("_wanted", F.col("heading_number")), F.lit(False)),
        )
        .withColumn("block_index", F.col("_number"))
        .drop("_number", "_has", "_known", "_wanted")
    )


def selected_blocks(blocks: DataFrame, fields: DataFrame, requests: DataFrame) -> DataFrame:
    """Blocks in the halo of a field or in a section the user asked for.

    ``requests(doc_id, user_text)`` has at most one row per document. Blocks
    without text do not count, not even as neighbours.
    """
    return _flagged_blocks(blocks, fields, requests).where("in_halo OR in_request").drop("_spoken")


def _contexts(blocks: DataFrame, fields: DataFrame, requests: DataFrame, outline: int | None = None) -> DataFrame:
    """Both forms of context per document from a single pass: ``full`` and ``compact``."""
    heading = F.col("nearest_heading")
    first = F.min("block_index").over(W.partitionBy("doc_id", "_spoken", "nearest_heading"))
    rows = _flagged_blocks(blocks, fields, requests).withColumn("_first", first)
    text = T.strip(F.col("text"))
    section = F.when(heading == "", F.lit("preamble")).otherwise(heading)
    line = F.concat(F.lit("["), F.col("block_index").cast("string"), F.lit("] Section:["), section, F.lit("] "), text)
    opens = F.col("_spoken") & (heading != "") & (F.col("_first") == F.col("block_index"))

    def ordered(condition: Column, line_: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.struct("block_index", line_.alias("line")))))

    gathered = rows.groupBy("doc_id").agg(
        ordered(F.col("_spoken"), text).alias("_full"),
        ordered(opens, F.concat(F.lit("- "), heading)).alias("_outline"),
        ordered(F.col("in_halo") | F.col("in_request"), line).alias("_body"),
    )

    def part(lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines["line"], "\n"))).otherwise(F.lit(""))

    compact = F.concat(
        F.lit("SECTION OUTLINE:"), part(F.col("_outline") if outline is None else F.slice("_outline", 1, outline)),
        F.lit("\n\nRELEVANT TEMPLATE BLOCKS:"), part(F.col("_body")),
    )
    return gathered.select(
        "doc_id", F.array_join(F.col("_full.line"), "\n").alias("full"), T.strip(compact).alias("compact")
    )


def compact_context(blocks: DataFrame, fields: DataFrame, requests: DataFrame, outline: int | None = None) -> DataFrame:
    """Outline plus the selected blocks, as one text per document."""
    return _contexts(blocks, fields, requests, outline).select("doc_id", F.col("compact").alias("context"))


def choose_context(
    wanted: DataFrame, blocks: DataFrame, fields: DataFrame, requests: DataFrame
) -> DataFrame:
    """``wanted(doc_id, compact BOOLEAN)`` says which form a document gives: its full text or, if true, the compact context."""
    is_long = F.coalesce(F.col("wants_compact"), F.lit(False))
    both = _contexts(blocks, fields, requests)
    context = F.when(is_long, F.col("compact")).otherwise(F.col("full"))
    return wanted.select("doc_id", F.col("compact").alias("wants_compact")).join(both, "doc_id", "left").select("doc_id", F.coalesce(context, F.lit("")).alias("context"))


def quoted(text: Column) -> Column:
    """Text in quotes with escapes: single quotes unless only they occur inside."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single, double = text.contains("'"), text.contains('"')
    inner = F.when(single & double, F.replace(escaped, F.lit("'"), F.lit("\\'"))).otherwise(escaped)
    mark = F.when(single & ~double, F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, inner, mark)


def editable_blocks(blocks: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines for the editable blocks of each document, all or the first ``limit``."""
    kind = _kind(blocks)
    row, col = _cell_position(blocks)
    around = B.with_neighbours(B.with_headings(blocks)).where(
        kind.isin("paragraph", "table_cell") & ~T.is_blank(F.col("text")) & (T.strip(F.col("text")) != "[EMPTY LINE]")
    )
    neighbours = F.concat(
        F.lit(" before="), quoted(F.array_join("before_context", " | ")),
        F.lit(" after="), quoted(F.array_join("after_context", " | ")),
    )
    place = F.when(kind == "table_cell", F.concat(F.lit(" row="), row, F.lit(" col="), col)).otherwise(neighbours)
    line = F.concat(
        F.lit("["), F.col("block_index").cast("string"), F.lit("] type="), kind,
        F.lit(" section="), quoted(F.col("nearest_heading")), F.lit(" text="), quoted(T.strip(F.col("text"))), place,
    )
    if limit is not None:
        around = around.withColumn("_rank", F.row_number().over(B.doc_order())).where(F.col("_rank") <= limit)
    return around.select("doc_id", "block_index", line.alias("line"))


def annotated_blocks(blocks: DataFrame) -> DataFrame:
    """Every spoken block with section, neighbours and its existing fields marked."""
    kind = _kind(blocks)
    row, col = _cell_position(blocks)
    around = B.with_neighbours(B.with_headings(blocks)).where(~T.is_blank(F.col("text")))

    def note(label: str, value: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.lit(f" ({label}: "), value, F.lit(")"))).otherwise(F.lit(""))

    context = F.concat(
        note("Section", F.col("nearest_heading"), F.col("nearest_heading") != ""),
        note("Trước", F.array_join("before_context", " | "), F.size("before_context") > 0),
        note("Sau", F.array_join("after_context", " | "), F.size("after_context") > 0),
    )
    label = F.when(
        kind == "table_cell", F.concat(F.lit("[TABLE_CELL - Row "), row, F.lit(", Col "), col, F.lit("]"))
    ).otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    marked = F.regexp_replace(T.strip(F.col("text")), "«([^»]+)»", "【«$1»】✓")
    line = F.concat(
        F.lit("[block_index="), F.col("block_index").cast("string"), F.lit("] "), label, context, F.lit("\n"), marked
    )
    return around.select("doc_id", "block_index", line.alias("line"))


def intro_context(blocks: DataFrame, paragraphs: int | None = None) -> DataFrame:
    """All paragraphs or the first ``paragraphs``, counted before empty ones are dropped."""
    if paragraphs is not None:
        blocks = blocks.withColumn("_rank", F.row_number().over(B.doc_order())).where(F.col("_rank") <= paragraphs)
    return lines_by_document(blocks.where(~T.is_blank(F.col("text"))), T.strip(F.col("text")), "intro", " | ")


def attach_suggestions(suggestions: DataFrame | Column, blocks: DataFrame) -> DataFrame:
    """Keep suggestions whose index is a number of an existing block; context comes from that block.

    ``suggestions(doc_id, raw_index STRING, ...)``; ``blocks`` with neighbour columns. A column holds suggestions that the rows
    of ``blocks`` carry for blocks of their document, as arrays of structs. They and the blocks, each of which is there once,
    meet in a window of the document, so blocks clustered by document need no exchange.
    """
    context = ["context", "before_context", "after_context"]
    if isinstance(suggestions, Column):
        met = blocks.where("doc_id IS NOT NULL").select(
            "doc_id", "block_index", F.struct(F.col("text").alias("context"), *context[1:]).alias("_context"),
            suggestions.alias("_own"),
        )
        # A row for the block itself, and one for each suggestion; one without a number goes with no block.
        met = met.select("doc_id", "block_index", "_context", F.explode(F.concat(
            F.transform(F.array(F.lit(True)), lambda _: F.get("_own", F.lit(-1))), "_own"
        )).alias("_s"))
        at = F.when(F.col("_s").isNull(), F.col("block_index")).otherwise(F.col("_s.raw_index").try_cast("bigint"))
        met = met.select("doc_id", at.alias("block_index"), F.when(F.col("_s").isNull(), F.col("_context")).alias("_context"), "_s")
        there = F.first("_context", ignorenulls=True).over(W.partitionBy("doc_id", "block_index"))
        kept = met.withColumn("_context", there).where("_s IS NOT NULL AND block_index >= 0 AND _context IS NOT NULL")
        return kept.select("doc_id", "block_index", "_s.*", "_context.*").drop("raw_index")
    placed = suggestions.withColumn("block_index", F.col("raw_index").try_cast("bigint")).where("block_index >= 0")
    kept = placed.drop(*context, "raw_index")
    return kept.join(blocks.select("doc_id", "block_index", F.col("text").alias("context"), *context[1:]), ["doc_id", "block_index"])


def suggestion_key(context: str = "context") -> Column:
    """Identity of a suggestion: block, contexts and insertion text."""
    joined = F.concat_ws(
        "::",
        F.coalesce(F.col("block_index").cast("string"), F.lit("na")),
        F.coalesce(F.col(context), F.lit("")),
        F.coalesce(F.to_json("before_context"), F.lit("[]")),
        F.coalesce(F.to_json("after_context"), F.lit("[]")),
        F.coalesce(F.col("insert_after"), F.lit("")),
    )
    return F.sha2(joined, 256)


def dedup_suggestions(suggestions: DataFrame, edits: DataFrame | Column | None = None) -> DataFrame:
    """One suggestion per key (the lowest ``suggestion_id``); user edits of name and position overlay it.

    The pick is an aggregate with map-side combine, so a key shared by very
    many suggestions never gathers in one task. Suggestions may bring their ``suggestion_key``, and then need no contexts.
    ``edits(doc_id, suggestion_key, suggested_name, position)``, or a column of ``suggestions`` with the edit of each row's key,
    a struct of name and position, which is then gathered beside the pick.
    """
    keyed = suggestions if "suggestion_key" in suggestions.columns else suggestions.withColumn("suggestion_key", suggestion_key())
    payload = [c for c in keyed.columns if c not in ("doc_id", "suggestion_key")]
    pick = F.min_by(F.struct(*payload), "suggestion_id").alias("_s")
    overlay = [F.col("suggested_name").alias("_name"), F.col("position").alias("_position")]
    if isinstance(edits, Column):
        picked = keyed.withColumn("_edit", edits).groupBy("doc_id", "suggestion_key").agg(pick, F.collect_set("_edit").alias("_edits"))
        edited = picked.select("doc_id", "suggestion_key", "_s.*", F.explode_outer("_edits").alias("_e"))
        edited = edited.withColumn("_name", F.col("_e.suggested_name")).withColumn("_position", F.col("_e.position")).drop("_e")
    else:
        edited = keyed.groupBy("doc_id", "suggestion_key").agg(pick).select("doc_id", "suggestion_key", "_s.*")
        if edits is None:
            return edited
        edited = edited.join(edits.select("doc_id", "suggestion_key", *overlay), ["doc_id", "suggestion_key"], "left")
    return (
        edited
        .withColumn("suggested_name", F.coalesce(F.nullif("_name", F.lit("")), "suggested_name"))
        .withColumn("position", F.coalesce(F.nullif("_position", F.lit("")), "position"))
        .drop("_name", "_position")
    )
