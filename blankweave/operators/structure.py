"""Edits that change blocks as a whole, and the checks before any edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.functions import naming as N
from blankweave.functions import text as T
from blankweave.operators import fields as FL
from blankweave.operators.ranking import with_op_index
from blankweave.operators.skew import salted_join

BLOCK = ["doc_id", "block_index"]
DOCUMENT_END = 2**40


def _renumber(blocks: DataFrame, *order: str) -> DataFrame:
    window = W.partitionBy("doc_id").orderBy("block_index", *order)
    return blocks.withColumn("block_index", (F.row_number().over(window) - 1).cast("bigint")).drop(*order)


# --- text updates ------------------------------------------------------------
def search_pattern(text: Column) -> Column:
    """Regular expression that finds normalised text in raw text.

    Any white space matches a space, and dot leaders match the dots they stand
    for, so the match has raw offsets from the start.
    """
    literal = F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    spaced = F.replace(literal, F.lit(" "), F.lit("\\E[\\s\\x{200b}]+\\Q"))
    three = F.replace(spaced, F.lit("..."), F.lit("\\E(?:\\.\\.\\.|…|\\.‥|‥\\.)\\Q"))
    two = F.replace(three, F.lit(".."), F.lit("\\E(?:\\.\\.|‥)\\Q"))
    return F.concat(F.lit("(?U)\\Q"), two, F.lit("\\E"))


def _spliced(text: Column, start: Column, end: Column, new: Column) -> Column:
    """``text`` with [start, end) replaced; a field it cuts into is replaced as a whole."""
    before, upto = F.left(text, start.cast("int")), F.left(text, end.cast("int"))
    rest = F.substring(text, (end + 1).cast("int"), F.length(text))
    head = F.regexp_replace(before, "«[^«»]*$", "")
    tail = F.when(upto.rlike("«[^»]*$"), F.regexp_replace(rest, "^[^«»]*»", "")).otherwise(rest)
    return F.concat(F.when(before.rlike("«[^»]*$") & text.rlike("«[^»]+»"), head).otherwise(before), new, tail)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _prepared(edits: DataFrame) -> DataFrame:
    """One array per document: its edits in order, each with the patterns it searches for."""
    rows = with_op_index(edits).withColumn("_e", F.struct("op_index", "block_index", "old_text", "new_text"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(prepared_update(F.col("_e")))).alias("_edits"))


def prepared_update(e: Column) -> Column:
    old = F.coalesce(e["old_text"], F.lit(""))
    texts = F.struct(T.normalize_text(old).alias("search"), T.normalize_without_fields(old).alias("bare"))
    return let(texts, lambda t: F.struct(
        e["op_index"].alias("op_index"), e["block_index"].alias("block_index"), F.coalesce(e["new_text"], F.lit("")).alias("new"), (t["search"] == "").alias("sets"),
        F.when(t["search"] != "", search_pattern(t["search"])).alias("pattern"),
        F.when((t["search"] != "") & (t["bare"] != ""), search_pattern(t["bare"])).alias("loose"),
    ))


def _set_text(text: Column, new: Column) -> Column:
    """A block whose text before its first field is set, or which keeps only its fields if the new text is blank."""
    marks = F.array_join(F.regexp_extract_all(text, F.lit("«[^»]+»"), F.lit(0)), "")
    lead = r"^((?:«[^»]+»)*)[^«]+"
    setting = F.regexp_replace(new, r"^ +", "")
    before = F.regexp_extract(text, lead, 1)
    set_text = F.when(text.rlike(lead), F.concat(before, setting, F.regexp_replace(text, lead, ""))).otherwise(F.concat(text, setting))
    return F.when(T.is_blank(new), marks).otherwise(set_text)


def _replaced(text: Column, hit: Column, new: Column) -> Column:
    return let(F.instr(text, hit) - 1, lambda at: _spliced(text, at, at + F.length(hit), new))


def _loosely_replaced(text: Column, hit: Column, new: Column) -> Column:
    """Found without its fields, the old text ends before them: those that follow are taken in."""
    def spliced(at: Column) -> Column:
        end = at + F.length(hit)
        last_mark = F.length(text) - F.instr(F.reverse(text), F.lit("«"))
        last_close = F.length(text) - F.instr(F.reverse(text), F.lit("»")) + 1
        stretched = F.when(text.rlike("«[^»]+»") & (last_mark >= at), F.greatest(end, last_close)).otherwise(end)
        return _spliced(text, at, stretched, new)

    return let(F.instr(text, hit) - 1, spliced)


_UPDATES = "array<struct<op_index:bigint,block_index:bigint,target_block:bigint,how:string>>"


def folded_updates(numbers: Column, texts: Column, edits: Column, look_ahead: int | None = None) -> Column:
    """``texts`` of a document's blocks, whose ``numbers`` go with them, after all prepared ``edits``, and what was ``done`` by each."""
    def outcome(ahead: Column, how: str, updated: Column) -> Column:
        return F.struct(ahead.cast("int").alias("ahead"), F.lit(how).alias("how"), updated.alias("updated"))

    def judged(text: Column, later: Column, edit: Column) -> Column:
        here = F.regexp_substr(text, edit["pattern"])
        loose = F.regexp_substr(text, edit["loose"])
        hits = F.transform(later, lambda t, i: F.struct(i.alias("i"), t.alias("text"), F.regexp_substr(t, edit["pattern"]).alias("hit")))
        ahead = F.get(F.filter(hits, lambda h: h["hit"].isNotNull()), 0)
        elsewhere = let(ahead, lambda found: (
            F.when(found.isNotNull(), outcome(found["i"] + 1, "exact", _replaced(found["text"], found["hit"], edit["new"])))
            .when(loose.isNotNull(), outcome(F.lit(0), "without fields", _loosely_replaced(text, loose, edit["new"])))
            .when(~text.rlike("«[^»]+»"), outcome(F.lit(0), "rewrite", edit["new"]))
        ))
        return F.when(edit["sets"], outcome(F.lit(0), "set", _set_text(text, edit["new"]))).when(
            here.isNotNull(), outcome(F.lit(0), "exact", _replaced(text, here, edit["new"]))
        ).otherwise(elsewhere)

    def step(state: Column, edit: Column) -> Column:
        def applied(at: Column) -> Column:
            reach = F.size(state["texts"]) if look_ahead is None else F.lit(look_ahead)
            later = F.slice(state["texts"], at + 2, reach)
            found = F.when(at >= 0, judged(F.get(state["texts"], at), later, edit))
            return let(found, lambda o: F.struct(
                F.when(o.isNull(), state["texts"]).otherwise(
                    F.transform(state["texts"], lambda t, i: F.when(i == at + o["ahead"], o["updated"]).otherwise(t))
                ).alias("texts"),
                F.concat(state["done"], F.array(F.struct(
                    edit["op_index"].alias("op_index"), edit["block_index"].alias("block_index"),
                    F.when(o.isNotNull(), F.get(numbers, at + o["ahead"])).alias("target_block"), F.coalesce(o["how"], F.lit("failed")).alias("how"),
                ))).alias("done"),
            ))

        return let((F.array_position(numbers, edit["block_index"]) - 1).cast("int"), applied)

    return F.aggregate(edits, F.struct(texts.alias("texts"), F.array().cast(_UPDATES).alias("done")), step)


def updated_texts(texts: DataFrame, edits: DataFrame, look_ahead: int | None = None) -> DataFrame:
    """Per document ``_blocks`` as given and ``_end``: their texts after all edits, and the outcome of each edit.

    ``texts(doc_id, block_index, text, ...)``; ``edits(doc_id, op_index,
    block_index, old_text, new_text)``, any number per block. The edits of a
    document are one request and are applied one after the other inside its row,
    so the corpus is passed once. An edit reads its own block, and later ones
    only where it isn't found there.
    """
    documents = texts.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("block_index", *[c for c in texts.columns if c not in BLOCK]))).alias("_blocks")
    )
    requests = documents.join(_prepared(edits), "doc_id", "left").withColumn("_numbers", F.col("_blocks.block_index"))

    texts = F.col("_blocks.text")
    start = F.struct(texts.alias("texts"), F.array().cast(_UPDATES).alias("done"))
    end = F.when(F.col("_edits").isNull(), start).otherwise(folded_updates(F.col("_numbers"), texts, F.col("_edits"), look_ahead))
    return requests.withColumn("_end", end).select("doc_id", "_blocks", "_end")


def find_updates(texts: DataFrame, edits: DataFrame, look_ahead: int | None = None) -> DataFrame:
    """Where each text update lands and how it was found.

    The old text is looked for in the block and the ``look_ahead`` ones after it,
    by default all, then without fields in the block itself; what is not found
    replaces a block that has no fields. Blank old text sets or clears the block.
    """
    return _outcomes(updated_texts(texts, edits, look_ahead), edits)


def _outcomes(updated: DataFrame, edits: DataFrame) -> DataFrame:
    found = updated.select("doc_id", F.explode("_end.done").alias("d")).select("doc_id", "d.*")
    asked = with_op_index(edits).select(*BLOCK, "op_index")
    return asked.join(found, [*BLOCK, "op_index"], "left").withColumn("how", F.coalesce("how", F.lit("failed")))


def update_text(segments: DataFrame, edits: DataFrame, look_ahead: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply text updates; fields named in the new text keep their switch and original text.

    A field new to the block takes the switch of the block's first field. The
    segments of a block travel as one nested row; blocks whose text changed get
    theirs cut anew. Everything clusters on ``doc_id``.
    """
    nested = nested_blocks(segments)
    updated = updated_texts(nested, edits, look_ahead)
    pairs = F.zip_with("_blocks", F.col("_end.texts"), lambda b, text: F.struct(b.alias("b"), F.nullif(text, b["text"]).alias("_text")))
    changed = updated.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.b.block_index", "p.b.segs", "p._text")
    rows = F.when(F.col("_text").isNull(), F.transform("segs", _piece)).otherwise(rebuilt_pieces(F.col("segs"), F.col("_text")))
    exploded = changed.select(*BLOCK, F.posexplode(rows).alias("pos", "_s")).select(
        *BLOCK, F.col("pos").cast("bigint").alias("seg_index"), "_s.kind", "_s.text", "_s.field_name", "_s.switch", "_s.original_text"
    )
    return FL.with_offsets(exploded).select(*segments.columns), _outcomes(updated, edits)


def _piece(s: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in ("kind", "text", "field_name", "switch", "original_text")])


def rebuilt_pieces(segs: Column, text: Column) -> Column:
    """The segments, without numbers, of a block that had ``segs`` and has a new ``text``."""
    none = F.lit(None).cast("string")

    def made(b: Column) -> Column:
        def pair(piece: Column, i: Column) -> Column:
            def field(name: Column) -> Column:
                own = F.get(F.filter(b["fields"], lambda s: s["field_name"] == name), 0)
                return F.struct(
                    F.lit("field").alias("kind"), T.field_mark(name).alias("text"), name.alias("field_name"),
                    F.coalesce(own["switch"], F.get(b["fields"], 0)["switch"], F.lit(V.SWITCH_KEEP)).alias("switch"),
                    F.coalesce(own["original_text"], F.lit("")).alias("original_text"),
                )

            before = F.struct(F.lit("text").alias("kind"), piece.alias("text"), none.alias("field_name"), none.alias("switch"), none.alias("original_text"))
            return F.array(before, let(F.get(b["names"], i), field))

        # Texts between fields may be empty; a block left without any text keeps one empty segment.
        return F.filter(
            F.flatten(F.transform(b["parts"], pair)),
            lambda s: F.coalesce((s["text"] != "") | ((b["text"] == "") & (s["kind"] == "text")), F.lit(False)),
        )

    return let(F.struct(
        text.alias("text"), F.filter(segs, lambda s: s["kind"] == "field").alias("fields"),
        F.split(text, "«[^»]+»", -1).alias("parts"), F.regexp_extract_all(text, F.lit("«([^»]+)»"), F.lit(1)).alias("names"),
    ), made)


def nested_blocks(segments: DataFrame) -> DataFrame:
    """One row per block: its shown text and its segments in order."""
    segment = F.struct("seg_index", "kind", "text", "field_name", "switch", "original_text")
    return segments.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(segment)).alias("segs")).withColumn(
        "text", F.array_join(F.col("segs.text"), "")
    )


# --- new blocks --------------------------------------------------------------------
def _cut_at(text: Column, cuts: Column) -> Column:
    """(piece number, text) between sorted offsets; blank pieces after the first are dropped."""
    bounds = F.concat(F.array(F.lit(0).cast("bigint")), cuts, F.array(F.length(text).cast("bigint")))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda i: F.struct(
            i.alias("piece"),
            F.substring(text, (F.get(bounds, i) + 1).cast("int"), (F.get(bounds, i + 1) - F.get(bounds, i)).cast("int")).alias("text"),
        ),
    )
    return F.filter(pieces, lambda p: (p["piece"] == 0) | ~T.is_blank(p["text"]))


def _offsets(edits: DataFrame) -> DataFrame:
    """The distinct offsets asked of each block, ascending."""
    return edits.groupBy(*BLOCK).agg(F.array_sort(F.collect_set("offset")).alias("_cuts"))


def add_block(blocks: DataFrame, adds: DataFrame) -> DataFrame:
    """``adds(doc_id, add_id, block_index, position, text, offset, para_in_cell)``.

    after or before a block, at the end of the document, as a paragraph of a
    cell (``para_in_cell`` set), or splitting the block at ``offset``. Any number
    per block: offsets and paragraphs are those before the request, adds at one
    place stand in the order of ``add_id``. Adds to unknown blocks change nothing.
    """
    sizes = blocks.select(*BLOCK, F.length("text").cast("bigint").alias("_length"))
    cuts = _offsets(
        adds.where("offset IS NOT NULL AND para_in_cell IS NULL").join(sizes, BLOCK)
        .withColumn("offset", F.when(F.col("_length") == 0, F.lit(0)).otherwise(F.col("offset")).cast("bigint"))
        .where("offset BETWEEN 0 AND _length")
    )
    inner = adds.where("para_in_cell IS NOT NULL").groupBy(*BLOCK).agg(
        F.array_sort(F.collect_list(F.struct("add_id", F.col("para_in_cell").alias("para"), "text"))).alias("_paras")
    )
    joined = blocks.join(cuts, BLOCK, "left").join(inner, BLOCK, "left")
    lines = F.split("text", "\n", -1)

    def with_adds(line: Column, i: Column) -> Column:
        here = F.filter("_paras", lambda a: F.least(a["para"], F.size(lines) - 1) == i)
        return F.concat(F.array(line), F.transform(here, lambda a: a["text"]))

    grown = joined.withColumn("_grown", F.when(
        F.col("_paras").isNotNull(), F.array_join(F.flatten(F.transform(lines, with_adds)), "\n")
    ).otherwise(F.col("text")))
    parts = F.when(F.col("_cuts").isNull(), F.array(F.struct(F.lit(0).alias("piece"), F.col("_grown").alias("text")))).otherwise(
        _cut_at(F.col("text"), F.col("_cuts"))
    )
    split = grown.select(*BLOCK, F.explode(parts).alias("_p")).select(
        *BLOCK, "_p.text", F.col("_p.piece").alias("_sub"), F.lit(0).cast("bigint").alias("_add")
    )
    outer = adds.where("offset IS NULL AND para_in_cell IS NULL")
    beside = outer.where("position <> 'end'").join(blocks.select(*BLOCK), BLOCK, "left_semi").select(
        *BLOCK, "text", F.when(F.col("position") == "before", -1).otherwise(2**30).alias("_sub"), F.col("add_id").alias("_add")
    )
    known = blocks.select("doc_id").distinct()
    ending = outer.where("position = 'end'").join(known, "doc_id", "left_semi").select(
        "doc_id", F.lit(DOCUMENT_END).cast("bigint").alias("block_index"), "text", F.lit(0).alias("_sub"), F.col("add_id").alias("_add")
    )
    return _renumber(split.unionByName(beside).unionByName(ending), "_sub", "_add")


def insert_structure(blocks: DataFrame, inserts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page breaks, image references or empty tables between the pieces of a split block.

    ``blocks(doc_id, block_index, type, text)``; ``inserts(doc_id, op_index,
    block_index, offset, what, rows, cols, image_path, width)``, any number per
    block, at offsets before the request. Blank pieces after the first are
    dropped; a page break splits paragraphs only.
    """
    sized = with_op_index(inserts).join(blocks.select(*BLOCK, "type", F.length("text").alias("_length")), BLOCK, "left")
    what = F.col("what")
    error = (
        F.when(F.col("type").isNull(), F.lit("unknown block"))
        .when((what == "page_break") & (F.col("type") != "paragraph"), F.lit("page breaks need a paragraph"))
        .when((F.col("_length") > 0) & ~F.col("offset").between(0, F.col("_length")), F.lit("offset not found"))
        .when((what == "table") & ((F.col("rows") < 1) | (F.col("cols") < 1)), F.lit("table size"))
        .when((what == "image") & (F.col("width") < 1), F.lit("image width"))
    )
    judged = sized.withColumn("error", error)
    good = judged.where("error IS NULL").select(
        *BLOCK, "op_index", F.when(F.col("_length") == 0, F.lit(0)).otherwise(F.col("offset")).cast("bigint").alias("offset"),
        "what", "rows", "cols", "image_path", "width",
    )
    none = lambda kind: F.lit(None).cast(kind)
    cuts = _offsets(good)
    pieces = F.when(F.col("_cuts").isNull(), F.array(F.struct(F.lit(0).alias("piece"), F.col("text").alias("text")))).otherwise(
        _cut_at(F.col("text"), F.col("_cuts"))
    )
    halves = blocks.join(cuts, BLOCK, "left").select(*BLOCK, "type", F.explode(pieces).alias("_p")).select(
        *BLOCK, (F.col("_p.piece") * 2).alias("_sub"), F.lit(0).cast("bigint").alias("_op"), "type", "_p.text",
        none("bigint").alias("row"), none("bigint").alias("col"), none("string").alias("image_path"), none("double").alias("width"),
    )
    # An insert stands between the pieces that its offset parts.
    between = good.join(cuts, BLOCK).withColumn("_sub", (2 * F.array_position("_cuts", F.col("offset")) - 1).cast("int"))
    marks = between.where("what <> 'table'").select(
        *BLOCK, "_sub", F.col("op_index").alias("_op"), F.col("what").alias("type"), F.lit("").alias("text"),
        none("bigint").alias("row"), none("bigint").alias("col"),
        F.when(what == "image", F.col("image_path")).alias("image_path"), F.when(what == "image", F.col("width")).alias("width"),
    )
    cells = (
        between.where("what = 'table'")
        .withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
        .withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cols") - 1)))
        .select(
            *BLOCK, "_sub", F.col("op_index").alias("_op"), F.lit("table_cell").alias("type"), F.lit("").alias("text"), "row", "col",
            none("string").alias("image_path"), none("double").alias("width"),
        )
    )
    everything = halves.unionByName(marks).unionByName(cells)
    numbered = everything.withColumn("_r", F.col("row")).withColumn("_c", F.col("col"))
    status = judged.select(
        *BLOCK, "op_index", F.when(F.col("error").isNull(), F.lit("executed")).otherwise(F.lit("failed")).alias("status"), "error"
    )
    return _renumber(numbered, "_sub", "_op", "_r", "_c"), status


def reverse_apply_order(targets: DataFrame) -> DataFrame:
    """Deletions from the end of a document backwards, with their rank per document.

    ``targets(doc_id, paragraph_index, order)``. The edits themselves do not
    need this: their offsets are those before the edit.
    """
    backwards = W.partitionBy("doc_id").orderBy(F.desc("paragraph_index"), F.desc("order"))
    return targets.withColumn("apply_rank", F.row_number().over(backwards).cast("bigint"))


def plan_to_edits(plans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Planned edits -> update_text rows in plan order.

    ``plans(doc_id, plan_order, raw_index STRING, old_text, new_text)``; kept
    are those whose index is a number of an editable block and whose old text
    shows something.
    """
    kinds = blocks.where(F.col("type").isin("paragraph", "table_cell")) if "type" in blocks.columns else blocks
    usable = plans.withColumn("block_index", F.col("raw_index").try_cast("bigint")).where(~T.is_blank(F.col("old_text")))
    kept = usable.join(kinds.select(*BLOCK), BLOCK, "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("plan_order")) - 1
    return kept.select(
        "doc_id", nth.cast("bigint").alias("op_index"), F.lit("update_text").alias("type"), "block_index",
        T.strip(F.col("old_text")).alias("old_text"), F.coalesce("new_text", F.lit("")).alias("new_text"),
    )


# --- checks -----------------------------------------------------------------------
def template_info(segments: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row per document: its field names, number of blocks and table sizes.

    ``cells(doc_id, table_index, row, col)`` when there are tables.
    """
    info = segments.groupBy("doc_id").agg(
        F.collect_set("field_name").alias("fields"), (F.max("block_index") + 1).alias("n_blocks")
    )
    if cells is None:
        empty = F.array().cast("array<struct<table_index:bigint,n_rows:bigint,n_cols:bigint>>")
        return info.withColumn("tables", empty)
    return info.join(table_sizes(cells), "doc_id", "left")


def table_sizes(cells: DataFrame) -> DataFrame:
    """The ``tables`` of each document with their sizes."""
    sizes = cells.groupBy("doc_id", "table_index").agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")
    )
    return sizes.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("table_index", "n_rows", "n_cols"))).alias("tables")
    )


def validate_edits(edits: DataFrame, info: DataFrame) -> DataFrame:
    """First error of each edit against the state of its document, NULL when it may run.

    One join per document; every test is then on the row. Rows and columns are compared with the size of their table;
    edits without ``row_index`` or ``col_index`` columns name none.
    """
    for name in ("row_index", "col_index"):
        if name not in edits.columns:
            edits = edits.withColumn(name, F.lit(None).cast("bigint"))
    joined = salted_join(edits, info, ["doc_id"], F.col("op_index"), how="left")
    error = edit_error(F.col, F.col("fields"), F.col("n_blocks"), F.col("tables"))
    return joined.withColumn("error", error).drop("fields", "n_blocks", "tables")


def edit_error(of, fields: Column, n_blocks: Column, tables: Column) -> Column:
    """First error of an edit, whose columns ``of`` gives by name, against the state of its document."""
    kind, fields = of("type"), F.coalesce(fields, F.array().cast("array<string>"))

    def known(name: str) -> Column:
        return F.coalesce(F.array_contains(fields, of(name)) | F.array_contains(fields, N.strip_suffix(of(name))), F.lit(False))

    def used(name: str) -> Column:
        return F.coalesce(F.array_contains(fields, of(name)), F.lit(False))

    def among(*kinds: str) -> Column:
        return kind.isin(*kinds)

    no_block = ~F.coalesce(of("block_index").between(0, n_blocks - 1), F.lit(False))
    table = F.get(F.filter(tables, lambda t: t["table_index"] == of("table_index")), 0)
    table_kinds = ("add_table_row", "delete_table_row", "add_table_column", "delete_table_column", "format_table_cell")
    row_kinds = ("add_table_row", "delete_table_row", "format_table_cell")
    col_kinds = ("add_table_column", "delete_table_column", "format_table_cell")
    in_cell = of("table_index").isNotNull() & of("row_index").isNotNull() & of("col_index").isNotNull()
    needs_block = (
        "add_placeholder", "add_placeholder_by_offset", "update_text", "delete_text_range", "format_text", "format_paragraph",
        "add_page_break", "add_table_at_cursor", "add_image_at_cursor", "add_hyperlink", "delete_paragraph",
    )
    bad_targets = F.exists(
        F.coalesce(of("blocks"), F.array().cast("array<map<string,bigint>>")),
        lambda b: ~F.coalesce(F.try_element_at(b, F.lit("block_index")).between(0, n_blocks - 1), F.lit(False)),
    )
    part = lambda b, key: F.try_element_at(b, F.lit(key))
    bad_cells = F.exists(
        F.coalesce(of("blocks"), F.array().cast("array<map<string,bigint>>")),
        lambda b: (part(b, "table_index").isNotNull() | part(b, "row_index").isNotNull() | part(b, "col_index").isNotNull())
        & (
            part(b, "table_index").isNull() | part(b, "row_index").isNull() | part(b, "col_index").isNull()
            | part(b, "para_in_cell").isNull()
        ),
    )
    empty = lambda name: F.coalesce(F.size(of(name)), F.lit(0)) <= 0
    return F.coalesce(
        F.when(n_blocks.isNull(), F.lit("unknown document")),
        F.when(among("rename_placeholder") & ~known("old_name"), F.lit("unknown field")),
        F.when(among("rename_placeholder") & used("new_name") & (of("new_name") != of("old_name")), F.lit("name in use")),
        F.when(among("delete_placeholder") & ~known("field_name"), F.lit("unknown field")),
        F.when(among(*needs_block) & no_block, F.lit("unknown block")),
        F.when(among("add_paragraph") & of("block_index").isNotNull() & no_block, F.lit("unknown block")),
        F.when(among("add_placeholder", "add_placeholder_by_offset") & used("field_name"), F.lit("name in use")),
        F.when(
            among("delete_text_range") & ((of("start_offset") < 0) | (of("end_offset") <= of("start_offset"))),
            F.lit("bad range"),
        ),
        F.when(among("format_text") & empty("format_config"), F.lit("no settings")),
        F.when(among("format_paragraph") & empty("paragraph_format"), F.lit("no settings")),
        F.when(among("delete_multiple_paragraphs") & bad_targets, F.lit("unknown block")),
        F.when(among("delete_multiple_paragraphs") & bad_cells, F.lit("cell address is incomplete")),
        F.when(among("add_hyperlink") & T.is_blank(of("url")), F.lit("no url")),
        F.when(among("add_hyperlink") & ~T.url_ok(of("url")), F.lit("bad url")),
        F.when(among(*table_kinds) & table.isNull(), F.lit("unknown table")),
        F.when(among("add_paragraph", "delete_paragraph") & in_cell & table.isNull(), F.lit("unknown table")),
        F.when(among("add_paragraph", "delete_paragraph") & in_cell & (of("row_index") >= table["n_rows"]), F.lit("unknown row")),
        F.when(among("add_paragraph", "delete_paragraph") & in_cell & (of("col_index") >= table["n_cols"]), F.lit("unknown column")),
        F.when(among("delete_table_row") & (table["n_rows"] <= 1), F.lit("the last row stays")),
        F.when(among("delete_table_column") & (table["n_cols"] <= 1), F.lit("the last column stays")),
        F.when(among(*row_kinds) & (of("row_index") >= table["n_rows"]), F.lit("unknown row")),
        F.when(among(*col_kinds) & (of("col_index") >= table["n_cols"]), F.lit("unknown column")),
        F.when(among("format_table_cell") & empty("format_options"), F.lit("no settings")),
    )


def batch_outcome(results: DataFrame) -> DataFrame:
    """``results(template_id, op_index, status)`` -> counts, success flag and message per template.

    Any failed validation means that nothing was applied.
    """
    invalid = F.count_if(F.col("status") == "validation_failed")
    failed = F.count_if(F.col("status") == "failed")
    done = F.count_if(F.col("status").isin("executed", "validated"))
    checked = F.count_if(F.col("status") == "validated")
    counted = results.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("total"), done.alias("successful"), failed.alias("failed"),
        invalid.alias("invalid"), checked.alias("checked"),
    )
    return counted.select(
        "template_id", "total", "successful", "failed", "invalid",
        ((F.col("invalid") == 0) & (F.col("failed") == 0)).alias("success"),
        F.when(F.col("invalid") > 0, F.lit("Validation failed - no changes made"))
        .when(F.col("checked") > 0, F.lit("Validation passed - no changes made (validate_only mode)"))
        .otherwise(
            F.concat(
                F.lit("Batch update completed: "), F.col("successful").cast("string"), F.lit(" succeeded, "),
                F.col("failed").cast("string"), F.lit(" failed"),
            )
        )
        .alias("message"),
    )
