"""Edits inside blocks, as maps over the segments of a template.

Segments are those of ``convert_blocks``. An edit names a block and a character
range or point in its shown text; the equi-join on ``(doc_id, block_index)``
comes first, the range test after it. A removed segment stays as an empty one
until ``settle`` drops it, so a block that loses all its text keeps its place.
All offsets are those before the request, so one request may hold any number of
edits for a block: they are gathered per target and folded inside the row, in the
order of ``op_index``, which also decides which of two edits fails where both
can't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.functions import naming as N
from blankweave.functions import text as T
from blankweave.operators import fields as FL
from blankweave.operators.context import shown_blocks
from blankweave.operators.ranking import by_op_index, with_op_index

BLOCK = ["doc_id", "block_index"]
FIELD_PROPS = ["field_name", "switch", "original_text"]


def settle(segments: DataFrame, *order: str) -> DataFrame:
    """Drop empty segments (one stays in an empty block), renumber, recompute offsets."""
    block = W.partitionBy(*BLOCK)
    ordered = block.orderBy(*(order or ("seg_index",)))
    kept = (
        segments.withColumn("_rank", F.row_number().over(ordered))
        .withColumn("_spoken", F.count_if(F.col("text") != "").over(block))
        .where((F.col("text") != "") | ((F.col("_spoken") == 0) & (F.col("_rank") == 1)))
    )
    numbered = kept.withColumn("seg_index", (F.row_number().over(block.orderBy("_rank")) - 1).cast("bigint"))
    return FL.with_offsets(numbered.drop("_rank", "_spoken", *[c for c in order if c != "seg_index"]))


def clear_when(segments: DataFrame, gone: Column) -> DataFrame:
    """Empty the segments for which ``gone`` holds; a cleared field is no field any more."""
    gone = F.coalesce(gone, F.lit(False))
    out = segments.withColumn("_gone", gone)
    for name in FIELD_PROPS:
        out = out.withColumn(name, F.when(~F.col("_gone"), F.col(name)))
    return (
        out.withColumn("kind", F.when(F.col("_gone"), F.lit("text")).otherwise(F.col("kind")))
        .withColumn("text", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("text")))
        .drop("_gone")
    )


def overlap(start: Column, end: Column) -> Column:
    """Half-open overlap of a segment with [start, end)."""
    return (F.col("end_pos") > start) & (F.col("start_pos") < end)


def overlap_segments(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments touched by ``ranges(doc_id, block_index, start_offset, end_offset)`` and the part touched."""
    return (
        segments.join(ranges, BLOCK)
        .where(overlap(F.col("start_offset"), F.col("end_offset")))
        .withColumn("overlap_start", F.greatest("start_pos", "start_offset"))
        .withColumn("overlap_end", F.least("end_pos", "end_offset"))
    )


# --- fields -----------------------------------------------------------------
def judged_renames(edits: Column, names: Column) -> Column:
    """``edits<op_index, old_name, new_name, nth>`` in order, each with the field it ``matched`` and an ``error``, decided from the names
    of the document's fields and the edits before it."""
    def judged(done: Column, edit: Column) -> Column:
        has = lambda name: F.array_contains(names, name)
        base = N.strip_suffix(edit["old_name"])
        matched = F.when(has(edit["old_name"]), edit["old_name"]).when(has(base), base)
        same_name = F.exists(done, lambda e: e["error"].isNull() & (e["new_name"] == edit["new_name"]))
        same_place = F.exists(done, lambda e: e["error"].isNull() & (e["matched"] == matched) & (e["nth"].isNull() | (e["nth"] == edit["nth"])))
        error = (
            F.when(matched.isNull(), F.lit("unknown field"))
            .when(has(edit["new_name"]) & (edit["new_name"] != edit["old_name"]), F.lit("name in use"))
            .when(edit["nth"] >= F.size(F.filter(names, lambda n: n == matched)), F.lit("no such occurrence"))
            .when(same_name, F.lit("name in use"))
            .when(same_place, F.lit("renamed before"))
        )
        fields = [edit[c].alias(c) for c in ("op_index", "old_name", "new_name", "nth")]
        return F.concat(done, F.array(F.struct(*fields, matched.alias("matched"), error.alias("error"))))

    nothing = F.array().cast("array<struct<op_index:bigint,old_name:string,new_name:string,nth:bigint,matched:string,error:string>>")
    return F.aggregate(edits, nothing, judged)


def rename_field(segments: DataFrame, renames: DataFrame, keep_switch: bool = False) -> tuple[DataFrame, DataFrame]:
    """``renames(doc_id, op_index, old_name, new_name, occurrence_index)`` -> segments and a status per rename.

    All occurrences, or only the given one. The name falls back to its base
    without a number. Of two renames to one new name, or of one occurrence, the
    earlier holds. A single rename resets the case switch, the bulk path keeps it.
    """
    names = segments.where("kind = 'field'").groupBy("doc_id").agg(F.collect_list("field_name").alias("_names"))
    requests = with_op_index(renames).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("op_index", "old_name", "new_name", F.col("occurrence_index").cast("bigint").alias("nth")))).alias("_edits")
    )

    outcome = requests.join(names, "doc_id", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>"))).select(
        "doc_id", judged_renames(F.col("_edits"), F.col("_names")).alias("_done")
    )
    status = outcome.select("doc_id", F.explode("_done").alias("e")).select(
        "doc_id", "e.op_index", "e.old_name", "e.new_name", "e.matched",
        F.when(F.col("e.error").isNull(), F.lit("executed")).otherwise(F.lit("failed")).alias("status"), "e.error",
    )
    occurrence = F.row_number().over(W.partitionBy("doc_id", "kind", "field_name").orderBy("block_index", "seg_index")) - 1
    joined = segments.withColumn("_occ", occurrence).join(outcome, "doc_id", "left")
    hits = F.filter("_done", lambda e: e["error"].isNull() & (e["matched"] == F.col("field_name")) & (e["nth"].isNull() | (e["nth"] == F.col("_occ"))))
    renamed = (
        joined.withColumn("_new", F.when(F.col("kind") == "field", F.get(hits, 0)["new_name"]))
        .withColumn("field_name", F.coalesce("_new", "field_name"))
        .withColumn("text", F.when(F.col("_new").isNotNull(), T.field_mark(F.col("_new"))).otherwise(F.col("text")))
    )
    if not keep_switch:
        renamed = renamed.withColumn("switch", F.when(F.col("_new").isNotNull(), F.lit(V.SWITCH_KEEP)).otherwise(F.col("switch")))
    return FL.with_offsets(renamed.drop("_new", "_occ", "_done")).select(*segments.columns), status


def delete_field(segments: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove every occurrence of ``deletes(doc_id, field_name)``; the original text does not come back."""
    fields = segments.where("kind = 'field'").select("doc_id", "field_name").distinct()
    wanted = deletes.select("doc_id", F.col("field_name").alias("wanted")).distinct()
    matched = FL.fuzzy_field_match(wanted, fields)
    status = matched.select(
        "doc_id", F.col("wanted").alias("field_name"),
        F.when(F.col("matched").isNull(), F.lit("failed")).otherwise(F.lit("executed")).alias("status"),
    )
    gone = matched.where("matched IS NOT NULL").select("doc_id", F.col("matched").alias("field_name")).distinct()
    marked = segments.join(gone.withColumn("_del", F.lit(True)), ["doc_id", "field_name"], "left")
    return settle(clear_when(marked, F.col("_del")).drop("_del")).select(*segments.columns), status


def _new_field(name: Column, original: Column) -> list[Column]:
    return [
        F.lit("field").alias("kind"), T.field_mark(name).alias("text"), name.alias("field_name"),
        F.lit(V.SWITCH_KEEP).alias("switch"), original.alias("original_text"),
    ]


def _name_errors(adds: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds with the block they hit and an error for unknown blocks and used names; of two equal names the earlier holds."""
    good = F.col("error").isNull()
    same_name = W.partitionBy("doc_id", "field_name", good).orderBy("op_index", "block_index")
    fields = segments.where("kind = 'field'").select("doc_id", "field_name").distinct().withColumn("_taken", F.lit(True))
    blocks = segments.groupBy(*BLOCK).agg(F.max("end_pos").alias("_length"))
    return (
        adds.join(blocks, BLOCK, "left").join(fields, ["doc_id", "field_name"], "left")
        .withColumn(
            "error",
            F.when(F.col("_length").isNull(), F.lit("unknown block"))
            .when(T.is_blank(F.col("field_name")), F.lit("no field name"))
            .when(F.col("_taken"), F.lit("name in use")),
        )
        .withColumn("error", F.when(good & (F.row_number().over(same_name) > 1), F.lit("name in use")).otherwise(F.col("error")))
        .drop("_taken")
    )


def add_field(segments: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``adds(doc_id, op_index, block_index, field_name, position)``.

    left, right or new_line; fields added at one side stand in the order of the
    request. A blank that ends the last text of the block is cut off and becomes
    the original text of the block's first added field.
    """
    judged = _name_errors(with_op_index(adds), segments)
    nth = F.row_number().over(W.partitionBy(*BLOCK).orderBy("op_index", "field_name"))
    good = judged.where("error IS NULL").select(*BLOCK, F.col("field_name").alias("_name"), "position", nth.alias("_nth"))
    is_text = (F.col("kind") == "text") & (F.col("text") != "")
    last_text = F.max(F.when(is_text, F.col("seg_index"))).over(W.partitionBy(*BLOCK))
    pieces = F.split("text", V.BLANK, -1)
    # One blank, nothing behind it.
    trailing = (F.size(pieces) == 2) & (F.get(pieces, 1) == "")
    joined = (
        segments.withColumn("_last", last_text).join(good.where("_nth = 1").select(*BLOCK, "_name"), BLOCK, "left")
        .withColumn("_cut", F.col("_name").isNotNull() & (F.col("seg_index") == F.col("_last")) & trailing)
        .withColumn("_blank", F.when(F.col("_cut"), F.regexp_extract("text", V.BLANK, 0)))
    )
    originals = joined.where("_cut").select(*BLOCK, "_blank")
    kept = joined.withColumn(
        "text", F.when(F.col("_cut"), F.get(F.split("text", V.BLANK, -1), 0)).otherwise(F.col("text"))
    ).select(*segments.columns, F.lit(0).alias("_sub"))
    position = F.col("position")
    fresh = good.join(originals, BLOCK, "left").select(
        *BLOCK,
        (F.when(position == "left", F.lit(-(2**40))).otherwise(F.lit(2**40)) + F.col("_nth")).cast("bigint").alias("seg_index"),
        *_new_field(F.col("_name"), F.coalesce(F.when(F.col("_nth") == 1, F.col("_blank")), F.lit(""))),
        F.lit(0).cast("bigint").alias("start_pos"), F.lit(0).cast("bigint").alias("end_pos"),
        F.when(position == "new_line", F.col("_nth")).otherwise(0).alias("_sub"),
    )
    everything = kept.unionByName(fresh)
    renumbered = everything.withColumn(
        "block_index",
        (F.dense_rank().over(W.partitionBy("doc_id").orderBy("block_index", "_sub")) - 1).cast("bigint"),
    ).drop("_sub")
    status = judged.select(
        *BLOCK, "op_index", "field_name",
        F.when(F.col("error").isNull(), F.lit("executed")).otherwise(F.lit("failed")).alias("status"), "error",
    )
    return settle(renumbered).select(*segments.columns), status


def _blocks_with_adds(segments: DataFrame, adds: DataFrame, *columns: str) -> DataFrame:
    """One row per block, asked or there: ``_segs`` in order, ``_length`` and ``_adds`` in the order of the request, each with what is
    wrong with it ``alone`` and whether an earlier good add has its ``name``.

    Segments and adds meet in one exchange by document. Names are compared by windows over (document, name), so the work grows
    with the rows of a document and not with the square of them.
    """
    numbered = with_op_index(adds).select(*BLOCK, "field_name", F.struct("op_index", *[F.col(c) for c in columns]).alias("_add"))
    segment = F.struct("seg_index", "kind", "text", *FIELD_PROPS, "start_pos", "end_pos")
    shown = segments.select(*BLOCK, F.col("field_name").alias("_name"), segment.alias("_seg"))
    both = shown.unionByName(numbered.withColumnRenamed("field_name", "_name"), allowMissingColumns=True).repartition("doc_id")
    there = F.coalesce(F.max(F.col("_seg").isNotNull()).over(W.partitionBy(*BLOCK)) & F.col("doc_id").isNotNull() & F.col("block_index").isNotNull(), F.lit(False))
    # Adds to blocks come in the order of the request; segments and adds to no block don't count among them.
    asks = F.col("_add").isNotNull() & F.col("_there")
    named = W.partitionBy("doc_id", "_name").orderBy(F.desc("_asks"), "_add.op_index", "block_index", *[f"_add.{c}" for c in columns])
    judged = both.withColumn("_there", there).withColumn("_asks", asks).withColumn("_nth", F.row_number().over(named)).withColumn(
        "_taken", F.max(F.col("_seg").isNotNull()).over(named.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    )
    alone = F.when(~F.col("_there"), F.lit("unknown block")).when(T.is_blank(F.col("_name")), F.lit("no field name")).when(F.col("_taken"), F.lit("name in use"))
    add = F.struct("_add.op_index", *[F.col(f"_add.{c}") for c in columns], F.col("_name").alias("name"), alone.alias("alone"), (F.col("_nth") > 1).alias("late"))
    return judged.groupBy(*BLOCK).agg(
        F.array_sort(F.collect_list("_seg")).alias("_segs"), F.max("_seg.end_pos").alias("_length"),
        F.array_sort(F.collect_list(F.when(F.col("_add").isNotNull(), add))).alias("_adds"),
    )


def placed_add(a: Column, segs: Column, length: Column) -> Column:
    """An add with its error, the first text segment at its point and the place in that."""
    point = a["point"]
    at = F.filter(segs, lambda s: (s["kind"] == "text") & (point.between(s["start_pos"], s["end_pos"]) | (length == 0)) & (point >= 0))
    return F.get(F.transform(F.array(F.get(at, 0)), lambda hit: F.struct(
        a["op_index"].alias("op_index"), a["name"].alias("name"),
        F.coalesce(
            a["alone"], F.when(a["late"], F.lit("name in use")), F.when(point.isNull(), F.lit("text not found")),
            F.when(hit.isNull(), F.lit("offset not found")),
        ).alias("error"),
        hit["seg_index"].alias("seg_index"), F.greatest(point - hit["start_pos"], F.lit(0)).cast("int").alias("local"),
    )), 0)


def _piece(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["text"].alias("text"), *[s[c].alias(c) for c in FIELD_PROPS])


def grown_pieces(segs: Column, adds: Column) -> Column:
    """The segments of a block, without numbers, cut where the fields of its placed ``adds`` come into them."""
    props = [F.lit(None).cast("string").alias(c) for c in FIELD_PROPS]

    def grown(s: Column) -> Column:
        here = F.array_sort(F.transform(F.filter(adds, lambda a: a["seg_index"] == s["seg_index"]), lambda a: F.struct(a["local"].alias("local"), a["op_index"].alias("op_index"), a["name"].alias("name"))))

        def around(a: Column, i: Column) -> Column:
            low = F.when(i > 0, F.get(here, i - 1)["local"]).otherwise(F.lit(0))
            piece = F.struct(F.lit("text").alias("kind"), F.substring(s["text"], low + 1, a["local"] - low).alias("text"), *props)
            return F.array(piece, F.struct(*_new_field(a["name"], F.lit(""))))

        rest = F.struct(F.lit("text").alias("kind"), F.substring(s["text"], F.element_at(here, -1)["local"] + 1, F.length(s["text"])).alias("text"), *props)
        return F.when(F.size(here) == 0, F.array(_piece(s))).otherwise(F.concat(F.flatten(F.transform(here, around)), F.array(rest)))

    return F.flatten(F.transform(segs, grown))


def add_field_at(segments: DataFrame, adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``adds(doc_id, op_index, block_index, field_name, offset, insert_after)``.

    The point is a character offset, or the end of the first ``insert_after``
    in the shown text. It has to touch a text segment; fields at one point stand
    in the order of the request. A block's adds are made inside its row.
    """
    blocks = _blocks_with_adds(segments, adds, "offset", "insert_after")

    def pointed(a: Column) -> Column:
        shown = F.array_join(F.col("_segs.text"), "")
        found = F.instr(shown, a["insert_after"])
        return a.withField("point", F.when(a["insert_after"].isNotNull(), F.when(found > 0, found - 1 + F.length(a["insert_after"]))).otherwise(a["offset"]).cast("bigint"))

    done = blocks.withColumn("_judged", F.transform(F.transform("_adds", pointed), lambda a: placed_add(a, F.col("_segs"), F.col("_length"))))
    status = done.select(*BLOCK, F.explode("_judged").alias("a")).select(
        *BLOCK, "a.op_index", F.col("a.name").alias("field_name"),
        F.when(F.col("a.error").isNull(), F.lit("executed")).otherwise(F.lit("failed")).alias("status"), "a.error",
    )
    per_block = done.select(*BLOCK, F.col("_segs").alias("segs"), F.filter("_judged", lambda a: a["error"].isNull()).alias("_own"))
    pieces = F.when(F.coalesce(F.size("_own"), F.lit(0)) <= 0, F.transform("segs", _piece)).otherwise(grown_pieces(F.col("segs"), F.col("_own")))
    spoken = F.filter("_pieces", lambda p: p["text"] != "")
    settled = F.when(F.size(spoken) > 0, spoken).otherwise(F.slice("_pieces", 1, 1))
    rows = per_block.withColumn("_pieces", pieces).select(*BLOCK, F.posexplode(settled).alias("_at", "p"))
    out = rows.select(*BLOCK, F.col("_at").cast("bigint").alias("seg_index"), "p.*")
    return FL.with_offsets(out).select(*segments.columns), status


def apply_suggestions(segments: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggestions applied one by one, without rollback; per document counts and the applied names.

    ``suggestions(doc_id, suggestion_id, block_index, suggested_name, position,
    insert_after)``, any number per block.
    """
    usable = suggestions.where(F.col("block_index").isNotNull() & ~T.is_blank(F.col("suggested_name")))
    named = usable.withColumnRenamed("suggested_name", "field_name").withColumn("op_index", F.col("suggestion_id").cast("bigint"))
    inline = named.where("position = 'inline'").withColumn("offset", F.lit(None).cast("bigint"))
    # A missing insertion text must miss, not fall back to an offset.
    inline = inline.withColumn("insert_after", F.coalesce("insert_after", F.lit("\x00")))
    first, inline_status = add_field_at(segments, inline.select(*BLOCK, "op_index", "field_name", "offset", "insert_after"))
    second, outer_status = add_field(first, named.where("position <> 'inline'").select(*BLOCK, "op_index", "field_name", "position"))
    outcome = inline_status.unionByName(outer_status).select("doc_id", F.col("op_index").alias("_id"), "status")
    judged = suggestions.join(
        outcome.withColumnRenamed("doc_id", "_doc"),
        (F.col("doc_id") == F.col("_doc")) & (F.col("suggestion_id").cast("bigint") == F.col("_id")), "left",
    ).drop("_doc", "_id")
    done = F.coalesce(F.col("status") == "executed", F.lit(False))
    report = judged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"),
        F.array_sort(F.collect_list(F.when(done, F.struct("suggestion_id", "suggested_name")))).alias("_a"),
    )
    return second, report.select(
        "doc_id", "total", "successful", "failed", F.col("_a.suggested_name").alias("applied_fields")
    )


# --- text --------------------------------------------------------------------
def cut_text(text: Column, start_pos: Column, ranges: Column) -> Column:
    """The text of a segment without ``ranges``, which come in descending order."""
    def cut(text: Column, r: Column) -> Column:
        low = F.greatest(r["start_offset"] - start_pos, F.lit(0)).cast("int")
        high = F.greatest(r["end_offset"] - start_pos, F.lit(0)).cast("int")
        return F.when(high <= low, text).otherwise(
            F.concat(F.left(text, low), F.substring(text, high + 1, F.length(text)))
        )

    # From the last range to the first, ends clipped to the start of the one after it.
    clipped = F.transform(
        ranges,
        lambda r, i: F.struct(
            r["start_offset"].alias("start_offset"),
            F.when(i > 0, F.least(r["end_offset"], F.get(ranges, i - 1)["start_offset"]))
            .otherwise(r["end_offset"]).alias("end_offset"),
        ),
    )
    return F.aggregate(clipped, text, cut)


def delete_ranges(segments: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut [start, end) ranges from blocks; a touched field goes as a whole.

    ``ranges(doc_id, block_index, start_offset, end_offset)``; a block may have
    several, all in original offsets.
    """
    valid = (F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset"))
    lists = ranges.where(valid).groupBy(*BLOCK).agg(
        F.sort_array(F.collect_list(F.struct("start_offset", "end_offset")), asc=False).alias("_ranges")
    )
    joined = segments.join(lists, BLOCK, "left")
    hit = F.exists(
        F.coalesce("_ranges", F.array().cast("array<struct<start_offset:bigint,end_offset:bigint>>")),
        lambda r: (F.col("end_pos") > r["start_offset"]) & (F.col("start_pos") < r["end_offset"]),
    )

    shortened = cut_text(F.col("text"), F.col("start_pos"), F.col("_ranges"))
    marked = joined.withColumn("_hit", hit)
    cleared = clear_when(marked, F.col("_hit") & (F.col("kind") == "field"))
    out = cleared.withColumn(
        "text", F.when(F.col("_hit") & (F.col("kind") == "text") & (F.col("text") != ""), shortened).otherwise(F.col("text"))
    )
    lengths = segments.groupBy(*BLOCK).agg(F.max("end_pos").alias("_length"))
    touched = F.coalesce(valid & (F.col("start_offset") < F.col("_length")), F.lit(False))
    status = ranges.join(lengths, BLOCK, "left").select(
        *BLOCK, "start_offset", "end_offset",
        F.when(touched, F.lit("executed")).otherwise(F.lit("failed")).alias("status"),
    )
    return settle(out.drop("_ranges", "_hit")).select(*segments.columns), status


def delete_blocks(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """Whole blocks or ranges of them; targets that do not exist are skipped.

    ``targets(doc_id, block_index, start_offset, end_offset)``, both offsets
    NULL for a whole block.
    """
    whole = targets.where("start_offset IS NULL OR end_offset IS NULL").select(*BLOCK).distinct()
    partial = targets.where("start_offset IS NOT NULL AND end_offset IS NOT NULL")
    left, _ = delete_ranges(segments.join(whole, BLOCK, "left_anti"), partial)
    return left.withColumn(
        "block_index", (F.dense_rank().over(W.partitionBy("doc_id").orderBy("block_index")) - 1).cast("bigint")
    )


# --- attributes ------------------------------------------------------------------
def changed_attrs(old: Column, config: Column) -> Column:
    """Character attributes after a format request; both are string maps.

    ``false`` removes; sub- and superscript exclude each other and are reset by
    every request, as is the highlight; white means no highlight.
    """
    get = lambda key: F.try_element_at(config, F.lit(key))
    on = lambda key: F.coalesce(F.lower(get(key)) == "true", F.lit(False))
    hex_of = lambda key: F.upper(F.regexp_replace(get(key), "^#+", ""))
    white = F.lower(get("highlight")).isin("#ffffff", "#fff", "")
    null = F.lit(None).cast("string")
    entries = [(key, F.when(on(key), F.lit("true"))) for key in ("bold", "italic", "underline", "strikethrough", "all_caps")]
    entries = [(key, F.when(get(key).isNull(), F.try_element_at(old, F.lit(key))).otherwise(value)) for key, value in entries]
    entries += [
        ("subscript", F.when(on("subscript") & ~on("superscript"), F.lit("true"))),
        ("superscript", F.when(on("superscript") & ~on("subscript"), F.lit("true"))),
        ("color", F.coalesce(F.nullif(hex_of("color"), F.lit("")), F.try_element_at(old, F.lit("color")))),
        ("highlight", F.when(F.coalesce(~white, F.lit(False)), hex_of("highlight")).otherwise(null)),
        ("font_name", F.coalesce(F.nullif(get("font_name"), F.lit("")), F.try_element_at(old, F.lit("font_name")))),
        ("font_size", F.coalesce(F.nullif(get("font_size"), F.lit("0")), F.try_element_at(old, F.lit("font_size")))),
        ("url", F.coalesce(get("url"), F.try_element_at(old, F.lit("url")))),
    ]
    full = F.create_map(*[part for key, value in entries for part in (F.lit(key), value)])
    return F.map_filter(full, lambda _, value: value.isNotNull())


def overlay_span_attrs(segments: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set attributes (or a ``url``) on [start, end): touched segments split at the ends of the spans.

    ``segments`` carry ``attrs MAP<STRING,STRING>``; ``spans(doc_id, op_index,
    block_index, start_offset, end_offset, config MAP)``; where several cover a
    piece they are applied in the order of the request. Offsets are mandatory and
    have to lie within the text. A touched field changes as a whole.
    """
    lengths = segments.groupBy(*BLOCK).agg(F.max("end_pos").alias("_length"))
    judged = with_op_index(spans).join(lengths, BLOCK, "left").withColumn(
        "_ok",
        F.coalesce(
            (F.col("start_offset") >= 0) & (F.col("start_offset") < F.col("end_offset"))
            & (F.col("end_offset") <= F.col("_length")),
            F.lit(False),
        ),
    )
    good = judged.where("_ok").groupBy(*BLOCK).agg(by_op_index(F.collect_list(
        F.struct("op_index", F.col("start_offset").alias("low"), F.col("end_offset").alias("high"), "config")
    )).alias("_all"))
    size, text = F.length("text").cast("bigint"), F.col("text")

    def local(s: Column) -> Column:
        inside = F.col("kind") == "text"
        return F.struct(
            F.when(inside, F.greatest(s["low"] - F.col("start_pos"), F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("low"),
            F.when(inside, F.least(s["high"] - F.col("start_pos"), size)).otherwise(size).alias("high"), s["config"].alias("config"),
        )

    joined = segments.join(good, BLOCK, "left").withColumn(
        "_spans", F.transform(F.filter("_all", lambda s: (F.col("end_pos") > s["low"]) & (F.col("start_pos") < s["high"])), local)
    )
    ends = F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0).cast("bigint"), size), F.transform("_spans", lambda s: s["low"]), F.transform("_spans", lambda s: s["high"])
    )))

    def piece(i: Column) -> Column:
        low, high = F.get("_ends", i), F.get("_ends", i + 1)
        covering = F.filter("_spans", lambda s: (s["low"] < high) & (s["high"] > low))
        return F.struct(
            F.substring(text, (low + 1).cast("int"), (high - low).cast("int")).alias("text"),
            F.aggregate(covering, F.col("attrs"), lambda attrs, s: changed_attrs(attrs, s["config"])).alias("attrs"),
        )

    touched = F.coalesce(F.size("_spans") > 0, F.lit(False)) & (text != "")
    pieces = F.when(touched, F.transform(F.sequence(F.lit(0), F.size("_ends") - 2), piece)).otherwise(
        F.array(F.struct(text.alias("text"), F.col("attrs").alias("attrs")))
    )
    others = [c for c in segments.columns if c not in ("text", "attrs")]
    split = joined.withColumn("_ends", ends).select(*others, F.posexplode(pieces).alias("_part", "_p")).select(
        *others, "_p.text", "_p.attrs", "_part"
    )
    status = judged.select(*BLOCK, "op_index", F.when(F.col("_ok"), F.lit("executed")).otherwise(F.lit("failed")).alias("status"))
    return settle(split, "seg_index", "_part").select(*segments.columns), status


# Attributes of a run that sets none itself.
RUN_DEFAULTS = {
    "bold": "false", "italic": "false", "underline": "none", "strikethrough": "false", "color": "000000",
    "highlight": None, "font_size": "12", "font_name": "Times New Roman", "superscript": "false", "subscript": "false",
}


def effective_attrs(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Attributes of the first visible segment a span touches, with defaults.

    ``spans(doc_id, block_index, start_offset, end_offset)``; without an end the
    span is a point.
    """
    point = F.col("end_offset").isNull() & (F.col("start_pos") <= F.col("start_offset")) & (F.col("start_offset") < F.col("end_pos"))
    first = (
        segments.join(spans, BLOCK)
        .where((point | overlap(F.col("start_offset"), F.col("end_offset"))) & ~T.is_blank(F.col("text")))
        .groupBy(*BLOCK, "start_offset", "end_offset").agg(F.min_by("attrs", "seg_index").alias("attrs"))
    )
    values = [
        F.coalesce(F.try_element_at("attrs", F.lit(key)), F.lit(default)).alias(key) for key, default in RUN_DEFAULTS.items()
    ]
    return first.select(*BLOCK, "start_offset", "end_offset", *values)


def set_block_attrs(blocks: DataFrame, formats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraph settings over ``blocks.attrs`` maps, in the order of the request; an unknown alignment refuses its edit."""
    formats = with_op_index(formats)
    alignment = F.try_element_at("paragraph_format", F.lit("alignment"))
    refused = alignment.isNotNull() & (alignment != "") & ~alignment.isin(*V.ALIGNMENTS)
    known = ("alignment", "line_spacing", "space_before", "space_after", "first_line_indent")
    wanted = F.map_filter(
        T.snake_keys(F.col("paragraph_format")), lambda key, value: key.isin(*known) & value.isNotNull() & (value != "")
    )
    exists = blocks.select(*BLOCK, F.lit(True).alias("_there"))
    judged = formats.join(exists, BLOCK, "left").withColumn("_ok", F.coalesce(F.col("_there") & ~F.coalesce(refused, F.lit(False)), F.lit(False)))
    good = judged.where("_ok").groupBy(*BLOCK).agg(by_op_index(F.collect_list(F.struct("op_index", wanted.alias("attrs")))).alias("_sets"))
    joined = blocks.join(good, BLOCK, "left")

    def over(attrs: Column, edit: Column) -> Column:
        return F.map_concat(F.map_filter(attrs, lambda key, _: ~F.map_contains_key(edit["attrs"], key)), edit["attrs"])

    merged = F.when(F.col("_sets").isNull(), F.col("attrs")).otherwise(F.aggregate("_sets", F.col("attrs"), over))
    status = judged.select(*BLOCK, "op_index", F.when(F.col("_ok"), F.lit("executed")).otherwise(F.lit("failed")).alias("status"))
    return joined.withColumn("attrs", merged).select(*blocks.columns), status


BORDER = "struct<style:string,size:bigint,color:string>"


def set_cell_attrs(cells: DataFrame, formats: DataFrame) -> DataFrame:
    """Fill, alignments and borders of cells.

    ``cells`` carry ``background``, ``v_align``, ``h_align`` and ``borders
    MAP<side, STRUCT<style,size,color>>``; ``formats`` the same under
    ``new_*`` names, folded per cell in the order of ``op_index``. A border of style none is removed; unknown alignments and
    an ``auto`` fill change nothing.
    """
    edits = with_op_index(formats).groupBy("table_id", "row", "col").agg(by_op_index(F.collect_list(
        F.struct("op_index", "new_background", "new_v_align", "new_h_align", "new_borders")
    )).alias("_edits"))

    def folded(column: str, change) -> Column:
        return F.when(F.col("_edits").isNull(), F.col(column)).otherwise(F.aggregate("_edits", F.col(column), change))

    def fill(old: Column, edit: Column) -> Column:
        new = edit["new_background"]
        return F.when(new.isNotNull() & ~new.isin("", "auto"), F.regexp_replace(new, "^#+", "")).otherwise(old)

    def aligned(name: str, allowed: tuple[str, ...]):
        return lambda old, edit: F.when(edit[name].isin(*allowed), edit[name]).otherwise(old)

    def bordered(old: Column, edit: Column) -> Column:
        new = edit["new_borders"]
        styled = F.transform_values(
            F.map_filter(new, lambda _, b: ~b["style"].isin("none", "")),
            lambda _, b: F.struct(
                b["style"].alias("style"), F.coalesce(b["size"], F.lit(4)).cast("bigint").alias("size"),
                F.regexp_replace(F.coalesce(b["color"], F.lit("auto")), "^#+", "").alias("color"),
            ),
        )
        kept = F.map_filter(old, lambda side, _: ~F.map_contains_key(new, side))
        return F.when(new.isNull(), old).otherwise(F.map_concat(kept, styled))

    joined = cells.join(edits, ["table_id", "row", "col"], "left")
    return (
        joined.withColumn("background", folded("background", fill))
        .withColumn("v_align", folded("v_align", aligned("new_v_align", ("top", "center", "bottom"))))
        .withColumn("h_align", folded("h_align", aligned("new_h_align", V.ALIGNMENTS)))
        .withColumn("borders", folded("borders", bordered))
        .select(*cells.columns)
    )


def effective_borders(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Border per cell and side: the cell's own, else the table's outer or inner one, else none.

    ``tables(table_id, table_borders MAP, max_row, max_col)``.
    """
    def hidden(border: Column) -> Column:
        return border.isNull() | F.coalesce(border["style"], F.lit("single")).isin("none", "nil", "")

    def parts(border: Column) -> dict[str, Column]:
        return {
            "style": F.coalesce(border["style"], F.lit("single")), "size": F.coalesce(border["size"], F.lit(4)).cast("bigint"),
            "color": F.concat(F.lit("#"), F.coalesce(F.nullif(border["color"], F.lit("")), F.lit("000000"))),
        }

    # What the borders of a table show is made once a table; a cell's sides become rows before theirs are looked up.
    edges = ("top", "bottom", "left", "right", "insideH", "insideV")
    edge = {name: F.col(f"_{name}") for name in edges}
    given = tables.select("table_id", "max_row", "max_col", *[F.try_element_at("table_borders", F.lit(name)).alias(f"_{name}") for name in edges])
    shown = given.select("table_id", "max_row", "max_col", *[
        F.when(~hidden(b), F.struct(*[c.alias(part) for part, c in parts(b).items()])).alias(f"_{name}") for name, b in edge.items()
    ])
    side = F.col("side")
    outer = (
        F.when((side == "top") & (F.col("row") == 0), edge["top"])
        .when((side == "bottom") & (F.col("row") == F.col("max_row")), edge["bottom"])
        .when((side == "left") & (F.col("col") == 0), edge["left"])
        .when((side == "right") & (F.col("col") == F.col("max_col")), edge["right"])
        .when(side.isin("top", "bottom"), edge["insideH"]).otherwise(edge["insideV"])
    )
    found = (
        cells.join(shown, "table_id").withColumn("side", F.explode(F.array(*[F.lit(name) for name in edges[:4]])))
        .select("table_id", "row", "col", "side", F.try_element_at("borders", side).alias("_own"), outer.alias("_outer"))
    )
    none = {"style": F.lit("none"), "size": F.lit(0).cast("bigint"), "color": F.lit("#000000")}
    own = parts(F.col("_own"))
    return found.select("table_id", "row", "col", "side", *[
        F.when(~hidden(F.col("_own")), own[name]).when(F.col("_outer").isNotNull(), F.col("_outer")[name]).otherwise(none[name]).alias(name)
        for name in none
    ])
