"""Segments and fields: cutting text at blanks, labels, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.functions import naming as N
from blankweave.functions import text as T

BLOCK = ["doc_id", "block_index"]


def in_block() -> WindowSpec:
    return W.partitionBy(*BLOCK).orderBy("seg_index")


def _leaders(blocks: DataFrame) -> Column | None:
    return F.col("tab_leaders") if "tab_leaders" in blocks.columns else None


def leader_tab_spans(blocks: DataFrame) -> DataFrame:
    """[start, end) of each run of adjacent tabs that draw a visible leader."""
    marked = T.mark_leader_tabs(F.col("text"), F.col("tab_leaders"))
    run = V.LEADER_MARK + "+"
    gaps = F.split(marked, run, -1)
    runs = F.regexp_extract_all(marked, F.lit(run), F.lit(0))
    parts = F.transform(
        gaps,
        lambda gap, i: F.struct(F.length(gap).alias("gap"), F.length(F.get(runs, i)).alias("run")),
    )
    window = W.partitionBy(*BLOCK).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    reached = F.sum(F.col("part.gap") + F.coalesce(F.col("part.run"), F.lit(0))).over(window)
    return (
        blocks.where(marked.contains(V.LEADER_MARK))
        .select(*BLOCK, F.posexplode(parts).alias("pos", "part"))
        .withColumn("end_pos", reached)
        .where(F.col("part.run").isNotNull())
        .select(
            *BLOCK,
            (F.col("end_pos") - F.col("part.run")).cast("bigint").alias("start_pos"),
            F.col("end_pos").cast("bigint").alias("end_pos"),
        )
    )


def with_offsets(segments: DataFrame) -> DataFrame:
    """Character offsets of each segment inside its block."""
    before = F.sum(F.length("text")).over(in_block().rowsBetween(W.unboundedPreceding, -1))
    return segments.withColumn("start_pos", F.coalesce(before, F.lit(0)).cast("bigint")).withColumn(
        "end_pos", F.col("start_pos") + F.length("text")
    )


def cut_at_blanks(blocks: DataFrame) -> DataFrame:
    """Alternating text and blank segments, in order, without offsets.

    Blank rows also carry the case switch, the text right before and right
    after them. All of it comes from one pass over the row.
    """
    marked = T.mark_leader_tabs(F.col("text"), _leaders(blocks))
    ends_in_break = r"(?U)[:\-–—\._…□■]\s*$"
    speaks = r"(?U)[^:\-–—\._…□■\s]"

    def opened(row: Column) -> Column:
        """The row with ``starts``: pieces that say something right behind a break, where the search for a label ends at the latest."""
        closed = lambda i: (i == 0) | F.coalesce(F.get(row["blanks"], i - 1).rlike(ends_in_break), F.lit(False))
        starts = F.transform(row["pieces"], lambda piece, i: closed(i) & piece.rlike(speaks))
        return F.struct(row["pieces"].alias("pieces"), row["blanks"].alias("blanks"), starts.alias("starts"))

    def segments_of(row: Column) -> Column:
        pieces, blanks, starts = row["pieces"], row["blanks"], row["starts"]

        def label_context(piece: Column, i: Column) -> Column:
            # The piece itself, or the text from the last start before it: what lies in front of that never tells a label,
            # so a long block isn't copied once for each of its blanks.
            back = F.when(F.get(starts, i - 1), F.lit(1).cast("bigint")).otherwise(F.array_position(F.reverse(F.slice(starts, 1, i)), F.lit(True)))

            def text_from(first: Column) -> Column:
                parts = F.transform(
                    F.slice(pieces, first + 1, i - first + 1),
                    lambda p, j: F.concat(p, F.when(first + j < i, F.get(blanks, first + j)).otherwise("")),
                )
                return F.array_join(parts, "")

            reached = F.transform(F.array(back), lambda b: text_from(F.when(b > 0, i - b.cast("int")).otherwise(0)))
            return F.when(F.get(starts, i), piece).otherwise(F.get(reached, 0))

        def pair(piece: Column, i: Column) -> Column:
            blank = F.get(blanks, i)
            none = F.lit(None).cast("string")
            text_row = F.struct(
                F.lit("text").alias("kind"), piece.alias("text"), none.alias("label_context"),
                none.alias("before"), none.alias("after"),
            )
            field_row = F.struct(
                F.lit("field").alias("kind"),
                blank.alias("text"),
                F.when(blank.isNotNull(), label_context(piece, i)).alias("label_context"),
                piece.alias("before"),
                F.get(pieces, i + 1).alias("after"),
            )
            return F.array(text_row, field_row)

        # A block without any text keeps one empty segment, so no block gets lost.
        lone = F.size(blanks) == 0
        return F.filter(
            F.flatten(F.transform(pieces, pair)),
            lambda s: F.coalesce((s["text"] != "") | (lone & (s["kind"] == "text")), F.lit(False)),
        )

    cut = F.struct(F.split(marked, V.BLANK, -1).alias("pieces"), T.detect_blanks(marked).alias("blanks"))
    exploded = blocks.withColumn("_marked", marked).select(
        *blocks.columns, F.posexplode(F.flatten(F.transform(F.transform(F.array(cut), opened), segments_of))).alias("seg_index", "_seg")
    )
    kept = [c for c in blocks.columns if c not in ("text", "tab_leaders")]
    labelled = exploded.withColumn("_label", T.last_label(F.col("_seg.label_context")))
    return labelled.select(
        *kept,
        F.col("seg_index").cast("bigint").alias("seg_index"),
        F.col("_seg.kind").alias("kind"),
        T.unmark_leader_tabs(F.col("_seg.text")).alias("text"),
        F.when(F.col("_seg.kind") == "field", T.switch_for(F.col("_label"))).alias("switch"),
        F.col("_seg.before").alias("before"),
        F.col("_seg.after").alias("after"),
    )


def segmentize(blocks: DataFrame) -> DataFrame:
    """Text and blank segments with offsets in the block text."""
    return with_offsets(cut_at_blanks(blocks)).select(
        *BLOCK, "seg_index", "kind", "text", "start_pos", "end_pos"
    )


def unique_labels(fields: DataFrame, base: Column, *order: str) -> DataFrame:
    """First use of a base keeps it, the n-th becomes ``base_n``, in document order."""
    window = W.partitionBy("doc_id", "_base").orderBy(*(order or ("block_index", "seg_index")))
    nth = F.row_number().over(window)
    return (
        fields.withColumn("_base", base)
        .withColumn("_nth", nth)
        .withColumn(
            "field_name",
            F.when(F.col("_nth") == 1, F.col("_base")).otherwise(
                F.concat(F.col("_base"), F.lit("_"), F.col("_nth").cast("string"))
            ),
        )
        .drop("_base", "_nth")
    )


def label_collisions(fields: DataFrame) -> DataFrame:
    """Names that two fields of one document share after numbering (a literal ``x_2`` base)."""
    return (
        fields.groupBy("doc_id", "field_name")
        .agg(F.count(F.lit(1)).alias("uses"))
        .where("uses > 1")
    )


def label_segments(cut: DataFrame, base: Column | None = None) -> DataFrame:
    """Give each blank a unique name and show it as ``«name»``, with fresh offsets."""
    base = T.base_label(F.col("text")) if base is None else base
    # Text segments get a numbering of their own, so they never touch the names.
    named = unique_labels(cut, F.when(F.col("kind") == "field", base))
    is_field = F.col("kind") == "field"
    return with_offsets(
        named.withColumn("original_text", F.when(is_field, F.col("text")))
        .withColumn("field_name", F.when(is_field, F.col("field_name")))
        .withColumn("text", F.when(is_field, T.field_mark(F.col("field_name"))).otherwise(F.col("text")))
    )


SEGMENT_COLUMNS = [
    "doc_id", "block_index", "seg_index", "kind", "text", "field_name",
    "switch", "original_text", "start_pos", "end_pos",
]


def convert_blocks(blocks: DataFrame) -> DataFrame:
    """Blank form blocks -> template segments.

    Names count per document and offsets per block: give blocks clustered by
    ``doc_id`` (``by_document`` or a bucketed table) and neither needs an exchange.
    """
    return label_segments(cut_at_blanks(blocks)).select(*SEGMENT_COLUMNS)


def rule_labels(blocks: DataFrame, max_words: int | None = None) -> DataFrame:
    """Name every blank from its label, date words or section heading; all words or the last ``max_words`` make the name."""
    from blankweave.operators.blocks import with_headings

    headed = with_headings(blocks).withColumn(
        "_only", T.is_blank_only(F.col("text"), _leaders(blocks))
    )
    # One step per column: each costly expression is evaluated once per row.
    named = (
        cut_at_blanks(headed).where("kind = 'field'")
        .withColumn("_quiet", N.quiet_label(F.col("before")))
        .withColumn("_phrase", N.label_phrase(F.col("_quiet")))
        .withColumn("_slug", N.slugify(F.col("_phrase"), max_words))
        .withColumn("_section", F.when(F.col("_only") & F.col("_slug").isNull(), F.col("nearest_heading")))
        .withColumn(
            "base",
            F.coalesce(N.date_part(F.col("_quiet")), "_slug", N.slugify(F.col("_section"), max_words), F.lit("field")),
        )
    )
    return unique_labels(named, F.col("base")).select(*BLOCK, "seg_index", "base", "field_name")


def kind_prefixes(cut: DataFrame) -> DataFrame:
    """``loai_`` names for blanks that stand for a kind of paper."""
    return cut.where("kind = 'field'").select(
        *BLOCK, "seg_index", N.kind_prefix(F.col("before"), F.col("after")).alias("prefix")
    )


def fields_of(segments: DataFrame) -> DataFrame:
    """The field rows of a template, numbered per block, with their instruction."""
    return segments.where("kind = 'field'").select(
        *BLOCK, "seg_index", "field_name", "switch", "original_text",
        T.format_instr(F.col("field_name"), F.col("switch"), F.col("original_text")).alias("instr"),
    )


def occurrence_index(fields: DataFrame) -> DataFrame:
    """0-based rank of a field among those of the same name in its document."""
    window = W.partitionBy("doc_id", "field_name").orderBy("block_index", "seg_index")
    return fields.withColumn("occurrence", (F.row_number().over(window) - 1).cast("bigint"))


def label_counts(fields: DataFrame, base: Column) -> DataFrame:
    return fields.groupBy("doc_id", base.alias("base")).agg(F.count(F.lit(1)).alias("uses"))


def template_fields(fields: DataFrame) -> DataFrame:
    """Ordered field names per template, occurrences kept."""
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "seg_index", "field_name")))
    return fields.groupBy("doc_id").agg(ordered.alias("_f")).select(
        "doc_id", F.col("_f.field_name").alias("fields")
    )


def fields_in_blocks(blocks: DataFrame) -> DataFrame:
    """(block, field) pairs shown as ``«field»``: explode instead of a contains join."""
    return blocks.where(F.col("text").contains("«")).select(
        *BLOCK, F.explode(T.fields_in_text(F.col("text"))).alias("field_name")
    )


def field_blocks(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """Blocks that show one of the template's known fields."""
    known = fields.select("doc_id", "field_name").distinct()
    return fields_in_blocks(blocks).join(known, ["doc_id", "field_name"], "left_semi")


def date_line_renames(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """Forced names for ``place, ngày .. tháng .. năm ..`` lines; the later block wins."""
    pattern = "(?iuU)" + V.DATE_LINE
    text = F.col("text")
    pairs = F.array(*[
        F.struct(
            F.lit(slot).alias("slot"),
            F.regexp_extract(text, pattern, slot + 1).alias("old_name"),
            F.lit(new).alias("new_name"),
        )
        for slot, new in enumerate(V.DATE_LINE_TARGETS)
    ])
    known = fields.select("doc_id", F.col("field_name").alias("old_name")).distinct()
    return (
        blocks.where(text.rlike(pattern))
        .select("doc_id", "block_index", F.explode(pairs).alias("p"))
        .select("doc_id", "block_index", "p.*")
        .where("old_name <> new_name")
        .groupBy("doc_id", "old_name")
        .agg(F.max_by("new_name", F.struct("block_index", "slot")).alias("new_name"))
        .join(known, ["doc_id", "old_name"], "left_semi")
        .select("doc_id", "old_name", "new_name")
    )


def overlay_renames(forced: DataFrame, suggested: DataFrame) -> DataFrame:
    """One rename per old name: suggestions win over forced renames."""
    ranked = forced.withColumn("_prio", F.lit(0)).unionByName(suggested.withColumn("_prio", F.lit(1)))
    return ranked.groupBy("doc_id", "old_name").agg(F.max_by("new_name", "_prio").alias("new_name"))


def apply_renames(fields: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename map over fields; unmapped names stay."""
    pairs = renames.select("doc_id", F.col("old_name").alias("field_name"), "new_name")
    return (
        fields.join(pairs, ["doc_id", "field_name"], "left")
        .withColumn("renamed", F.coalesce("new_name", "field_name"))
        .drop("new_name")
    )


def fuzzy_field_match(wanted: DataFrame, fields: DataFrame) -> DataFrame:
    """Exact name, else the name without its number, else NULL.

    Both candidates are exploded so that a single equi-join answers them.
    """
    known = fields.select("doc_id", F.col("field_name").alias("candidate")).distinct()
    tries = F.array_distinct(F.array(F.col("wanted"), N.strip_suffix(F.col("wanted"))))
    return (
        wanted.select("doc_id", "wanted", F.posexplode(tries).alias("try", "candidate"))
        .join(known.withColumn("_hit", F.lit(True)), ["doc_id", "candidate"], "left")
        .groupBy("doc_id", "wanted")
        .agg(
            F.min_by(
                F.when(F.col("_hit"), F.col("candidate")), F.when(F.col("_hit"), F.col("try"))
            ).alias("matched")
        )
    )
