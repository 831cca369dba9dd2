"""Tables inside documents: structure, growth and grid edits.

``cells(table_id, row, col, text)``, one row per visible cell. Counting and
planning aggregate with map-side combine, and lines of text are rows with their
place in the whole, so a very large table never has to sit in one task. Only who
asks for the text of a table as one value (summary, grid) gathers its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blankweave.functions import naming as N
from blankweave.functions import text as T
from blankweave.operators.ranking import numbered, running_total, with_op_index
from blankweave.operators.skew import even_join, salted_join

ROW_BAND = 4096


# --- reading -------------------------------------------------------------------
def logical_columns(xml_cells: DataFrame) -> DataFrame:
    """``(table_id, row, pos, colspan, ...)`` -> start column of each cell from the spans before it."""
    before = W.partitionBy("table_id", "row").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return xml_cells.withColumn("col", F.coalesce(F.sum("colspan").over(before), F.lit(0)).cast("bigint"))


def cell_at_column(xml_cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Logical column -> the cell that covers it.

    Each cell is repeated for the columns it spans, so the range test becomes
    an equi-join.
    """
    covered = logical_columns(xml_cells).withColumn("start_col", F.col("col")).withColumn(
        "col", F.explode(F.sequence(F.col("start_col"), F.col("start_col") + F.col("colspan") - 1))
    )
    return wanted.join(covered, ["table_id", "row", "col"])


def _rows(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "text"))).alias("_c"),
        F.max(~T.is_blank(F.col("text"))).alias("_spoken"),
    )


def summary_lines(cells: DataFrame) -> DataFrame:
    """``(table_id, row, line, spoken)``: the cells of a row joined by `` | ``; ``spoken`` if any shows something."""
    trimmed = cells.withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
    return _rows(trimmed).select("table_id", "row", F.array_join(F.col("_c.text"), " | ").alias("line"), F.col("_spoken").alias("spoken"))


def grid_lines(cells: DataFrame) -> DataFrame:
    """``(table_id, row, line)`` with lines ``Row i: "a" | [EMPTY] | ...``."""
    shown = F.when(T.is_blank(F.col("text")), F.lit("[EMPTY]")).otherwise(F.concat(F.lit('"'), T.strip(F.col("text")), F.lit('"')))
    line = F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), F.array_join(F.col("_c.text"), " | "))
    return _rows(cells.withColumn("text", shown)).select("table_id", "row", line.alias("line"))


def with_line_starts(lines: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Lines with ``start_pos``, their place in the text that the lines of a table make when joined by newlines.

    A table may hold any share of all rows: starts of such are prefix sums in two levels, and no table is gathered.
    ``counted`` are the cells that the lines were made of.
    """
    return running_total(
        lines, ["table_id"], F.floor(F.col("row") / ROW_BAND), ["row"], F.length("line") + 1, "start_pos", counted=counted
    )


def _joined(lines: DataFrame, name: str) -> DataFrame:
    """The lines of each table as one text, which the caller asks for: it has to fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("row", "line")))
    return lines.groupBy("table_id").agg(F.array_join(parts["line"], "\n").alias(name))


def table_summary(cells: DataFrame) -> DataFrame:
    """``summary_lines`` of each table as one text without the rows that show nothing, and ``has_content``."""
    lines = summary_lines(cells)
    shown = F.array_sort(F.collect_list(F.when(F.col("spoken"), F.struct("row", "line"))))
    return lines.groupBy("table_id").agg(F.array_join(shown["line"], "\n").alias("summary"), F.max("spoken").alias("has_content"))


def table_grid_text(cells: DataFrame) -> DataFrame:
    """``grid_lines`` of each table as one text."""
    return _joined(grid_lines(cells), "grid")


def table_structure(cells: DataFrame) -> DataFrame:
    counted = cells.groupBy("table_id").agg(
        (F.max("row") + 1).alias("total_rows"), (F.max("col") + 1).alias("columns")
    )
    return counted.select(
        "table_id", F.greatest(F.col("total_rows") - 1, F.lit(0)).alias("data_rows"),
        (F.col("total_rows") > 0).alias("has_header"), "columns",
    )


def empty_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.count_if(T.is_cell_empty(F.col("text"))).alias("empty_cells"))


# --- growth ---------------------------------------------------------------------
def expansion_plan(cells: DataFrame, required: DataFrame) -> DataFrame:
    """Rows to add so that every table has ``required(table_id, required)`` empty cells.

    Two aggregations, row then table: the last row is the maximum of a struct,
    so no window and no self join.
    """
    rows = cells.groupBy("table_id", "row").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(T.is_cell_empty(F.col("text"))).alias("empties"),
        F.max("col").alias("last_col"),
    )
    tables = rows.groupBy("table_id").agg(
        F.sum("empties").alias("empty_cells"),
        F.max(F.struct("row", "empties", "cells")).alias("_last"),
        (F.max("last_col") + 1).alias("columns"),
    )
    total = F.col("_last.row") + 1
    per_row = F.when(F.col("_last.empties") == 0, F.col("_last.cells")).otherwise(F.col("_last.empties"))
    lacking = F.col("required") - F.col("empty_cells")
    # Whole-number ceiling: no detour over doubles.
    to_add = F.when((lacking > 0) & (total > 1), F.expr("(_lacking + _per_row - 1) DIV _per_row")).otherwise(F.lit(0))
    return (
        tables.join(required, "table_id")
        .withColumn("_lacking", lacking).withColumn("_per_row", per_row)
        .select(
            "table_id", total.alias("total_rows"), "columns", "empty_cells", "required",
            (lacking > 0).alias("needs_expansion"),
            to_add.cast("bigint").alias("rows_to_add"),
            (F.col("empty_cells") + to_add * F.col("_per_row")).cast("bigint").alias("empty_after"),
        )
    )


def growth_summary(plan: DataFrame, template_of: Column) -> DataFrame:
    """Tables expanded and rows added per template, with its message."""
    grown = F.col("rows_to_add") > 0
    return plan.groupBy(template_of.alias("template_id")).agg(
        F.count_if(grown).alias("tables_expanded"), F.sum("rows_to_add").cast("bigint").alias("total_rows_added")
    ).withColumn(
        "message",
        F.concat(
            F.lit("Merge completed: "), F.col("tables_expanded").cast("string"), F.lit(" tables expanded, "),
            F.col("total_rows_added").cast("string"), F.lit(" rows added"),
        ),
    )


def record_requirements(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every table of a template against the number of fields its request needs."""
    return tables.join(wanted, "template_id")


def row_clone_names(field_cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Field cells of the last row repeated on each added row under bumped names."""
    growing = plan.where("rows_to_add > 0").select("table_id", (F.col("total_rows") - 1).alias("row"), "rows_to_add")
    return (
        field_cells.join(growing, ["table_id", "row"])
        .withColumn("clone", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows_to_add") - 1)))
        .select(
            "table_id", (F.col("row") + F.col("clone") + 1).alias("row"), "col",
            N.bump_suffix(F.col("field_name"), F.col("clone")).alias("field_name"),
        )
    )


def merge_with_expansion(
    field_cells: DataFrame, cells: DataFrame, required: DataFrame, values: DataFrame, preview_only: bool = False
) -> DataFrame:
    """Grow tables, then show the value of every field cell, old and cloned.

    ``field_cells(table_id, row, col, field_name, switch, original_text)``;
    ``values(table_id, field_name, value)``. A preview shows the plan's tables
    untouched.
    """
    shown = field_cells
    if not preview_only:
        clones = row_clone_names(field_cells, expansion_plan(cells, required))
        source = field_cells.select("table_id", F.col("row").alias("_from"), "col", "switch", "original_text")
        last = source.groupBy("table_id", "col").agg(
            F.max_by(F.struct("switch", "original_text"), "_from").alias("_s")
        )
        grown = clones.join(last, ["table_id", "col"]).select(
            "table_id", "row", "col", "field_name", "_s.switch", "_s.original_text"
        )
        shown = field_cells.select(*grown.columns).unionByName(grown)
    merged = shown.join(values, ["table_id", "field_name"], "left")
    return merged.select(
        "table_id", "row", "col", "field_name",
        T.merged_value(
            F.col("field_name"), F.col("switch"), F.col("original_text"), F.col("value"), F.lit(False)
        ).alias("shown"),
    )


# --- filling empty cells ----------------------------------------------------------
def fill_empty_cells(cells: DataFrame) -> DataFrame:
    """Every empty cell below the header of a table with two rows or more becomes a field."""
    # A cell below the header shows that its table has two rows.
    targets = cells.where((F.col("row") >= 1) & T.is_cell_empty(F.col("text"))).select("table_id", "row", "col")
    ranked = numbered(
        targets.withColumn("_band", F.floor(F.col("row") / ROW_BAND)), ["table_id"], ["_band"], ["row", "col"], "_nth", counted=cells
    )
    name = F.when(F.col("_nth") == 1, F.lit("field")).otherwise(F.concat(F.lit("field_"), F.col("_nth").cast("string")))
    return ranked.select("table_id", "row", "col", name.alias("field_name"))


def fill_proposed_cells(cells: DataFrame, proposals: DataFrame) -> DataFrame:
    """Only proposed cells that lie in the grid and hold no text."""
    blank = cells.where(T.is_blank(F.col("text"))).select("table_id", "row", "col")
    named = proposals.where(~T.is_blank(F.col("field_name")))
    return named.join(blank, ["table_id", "row", "col"], "left_semi")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def best_matching_cell(cells: DataFrame, hints: DataFrame) -> DataFrame:
    """``hints(table_id, hint, name)`` -> the cell and the paragraph in it whose words fit best, first one on ties, none at score 0.

    Every paragraph of a cell counts by itself.

    The pieces of a hint stay an array on the row, so no pairs are emitted; whole cells meet their hint and fall into words
    there. The pick is a max over a struct, combined before the shuffle.
    """
    pieces = F.transform(F.split("hint", r" \| ", -1), T.strip)
    prepared = hints.select(
        "table_id", F.transform(pieces, _words).alias("_pieces"), F.array_distinct(F.split(F.lower("name"), "_", -1)).alias("_parts")
    )
    paired = even_join(cells.select("table_id", "row", "col", "text"), prepared, ["table_id"], F.struct("row", "col"), counted=cells)
    lines = paired.select("table_id", "row", "col", "_pieces", "_parts", F.posexplode(F.split("text", "\n", -1)).alias("para_in_cell", "text"))
    spoken = lines.where(~T.is_blank(F.col("text"))).withColumn("_words", _words(F.col("text")))
    bonus = F.size(F.array_intersect("_parts", "_words")) * F.lit(0.2)
    usable = F.filter(F.col("_pieces"), lambda piece: F.size(piece) > 0)
    scores = F.transform(
        usable, lambda piece: F.size(F.array_intersect(piece, F.col("_words"))) / F.size(piece) + F.col("_bonus")
    )
    scored = (
        spoken.where(F.size("_words") > 0).withColumn("_bonus", bonus).withColumn("score", F.array_max(scores)).where("score > 0")
    )
    return scored.groupBy("table_id").agg(
        F.max(F.struct("score", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"), (-F.col("para_in_cell")).alias("p"))).alias("_b")
    ).select("table_id", (-F.col("_b.r")).alias("row"), (-F.col("_b.c")).alias("col"), (-F.col("_b.p")).cast("bigint").alias("para_in_cell"))


# --- grid edits ---------------------------------------------------------------------
def _edit_lines(cells: DataFrame, edits: DataFrame, axis: str, other: str, after: str) -> tuple[DataFrame, DataFrame]:
    """Inserts and deletes of grid lines, one after the other per table; returns new cells and a status per edit.

    ``edits(table_id, op_index, action, at, position)``; ``at`` NULL inserts at
    the end. Positions are those after the edits before. The last line of a
    table is protected. The edits of a table travel as one array: they move the
    position of each cell inside its row, so a table may hold any share of all cells.
    """
    sizes = cells.groupBy("table_id").agg(
        (F.max(axis) + 1).alias("_lines"), (F.max(other) + 1).alias("_others")
    )
    requests = with_op_index(edits).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("op_index", "action", "at", "position"))).alias("_edits"))

    def judged(state: Column, edit: Column) -> Column:
        lines, inserting = state["lines"], edit["action"] == "insert"
        at = F.coalesce(edit["at"], lines)
        target = F.when(inserting & edit["at"].isNotNull() & (edit["position"] == after), at + 1).otherwise(at).cast("bigint")
        last = F.when(inserting, lines).otherwise(lines - 1)
        error = (
            F.when(lines.isNull(), F.lit("unknown table"))
            .when(~inserting & (lines <= 1), F.lit(f"the last {axis} stays"))
            .when(~target.between(0, last), F.lit(f"{axis} is out of range"))
        )
        step = F.when(error.isNotNull(), 0).when(inserting, 1).otherwise(-1)
        done = F.struct(edit["op_index"].alias("op_index"), edit["action"].alias("action"), target.alias("target"), error.alias("error"))
        return F.struct((lines + step).cast("bigint").alias("lines"), F.concat(state["done"], F.array(done)).alias("done"))

    empty = F.struct(
        F.col("_lines").cast("bigint").alias("lines"),
        F.array().cast("array<struct<op_index:bigint,action:string,target:bigint,error:string>>").alias("done"),
    )
    planned = requests.join(sizes, "table_id", "left").select(
        "table_id", "_others", F.aggregate("_edits", empty, judged)["done"].alias("_done")
    )
    status = planned.select("table_id", F.explode("_done").alias("e")).select(
        "table_id", "e.op_index", F.when(F.col("e.error").isNull(), F.lit("executed")).otherwise(F.lit("failed")).alias("status"), "e.error"
    )
    steps = F.transform(
        F.filter("_done", lambda e: e["error"].isNull()), lambda e: F.struct(e["target"].alias("target"), (e["action"] == "insert").alias("grows"))
    )
    good = planned.select("table_id", "_others", steps.alias("_good")).where(F.size("_good") > 0)

    def moved(position: Column, edit: Column) -> Column:
        target = edit["target"]
        return (
            F.when(edit["grows"], F.when(position >= target, position + 1).otherwise(position))
            .when(position > target, position - 1).when(position < target, position)
        )

    joined = even_join(cells, good.select("table_id", "_good"), ["table_id"], F.struct("row", "col"), how="left")
    start = F.col(axis).cast("bigint")
    kept = joined.withColumn(axis, F.when(F.col("_good").isNull(), start).otherwise(F.aggregate("_good", start, moved))).where(
        F.col(axis).isNotNull()
    ).select("table_id", "row", "col", "text")
    later = F.slice("_good", F.col("_i") + 2, F.size("_good"))
    fresh = (
        good.select("table_id", "_others", "_good", F.posexplode("_good").alias("_i", "e")).where("e.grows")
        .withColumn(axis, F.aggregate(later, F.col("e.target"), moved)).where(F.col(axis).isNotNull())
        .select("table_id", axis, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_others") - 1)).alias(other), F.lit("").alias("text"))
        .select("table_id", "row", "col", "text")
    )
    return kept.unionByName(fresh), status


def edit_table_rows(cells: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _edit_lines(cells, edits, "row", "col", "below")


def edit_table_columns(cells: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _edit_lines(cells, edits, "col", "row", "right")
