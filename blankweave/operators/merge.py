"""Merging records into templates, and reports on what is missing.

Long form inside: ``records(record_id, template_id)``, ``fields(template_id,
block_index, seg_index, field_name, switch, original_text)`` and
``values(record_id, field_name, value)``. Where a record has several values for
a field, the last one holds: by ``value_order`` if the values have it, else the
greatest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.functions import text as T
from blankweave.operators.skew import SLICE_ROWS, hot_join


def with_template(records: DataFrame, rows: DataFrame, counted: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Records joined to rows of their template.

    One popular template may serve most records: the hot ones, found by counting, are split by their share, and only
    their rows are copied. ``counted`` are the records before they were joined to anything.
    """
    return hot_join(records, rows, ["template_id"], F.col("record_id"), slice_rows=slice_rows, counted=counted)


def _value_order(values: DataFrame) -> Column:
    return F.col("value_order") if "value_order" in values.columns else F.col("value")


def last_values(values: DataFrame) -> DataFrame:
    """One value per record and field: an aggregate, combined before the shuffle that the join by these keys needs anyway."""
    return values.groupBy("record_id", "field_name").agg(F.max_by("value", F.struct(_value_order(values), "value")).alias("value"))


def merge_values(records: DataFrame, fields: DataFrame, values: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Each field occurrence of each record with the text it shows. Extra values are ignored."""
    keys = ["record_id", "field_name"]
    rows = with_template(records, fields).join(last_values(values), keys, "left")
    if locks is None:
        rows = rows.withColumn("_locked", F.lit(False))
    else:
        marks = locks.select(*keys).distinct().withColumn("_lock", F.lit(True))
        rows = rows.join(marks, keys, "left").withColumn("_locked", F.coalesce("_lock", F.lit(False)))
    shown = T.merged_value(
        F.col("field_name"), F.col("switch"), F.col("original_text"), F.col("value"), F.col("_locked")
    )
    return rows.select("record_id", "template_id", "block_index", "seg_index", "field_name", shown.alias("shown"))


def template_bodies(segments: DataFrame) -> DataFrame:
    """Template segments -> one row per template with its blocks as nested arrays.

    Each segment also knows the first character that follows it, which decides
    on the space after a merged value. A template is bounded by the ingest limit.
    """
    segment = F.struct("seg_index", "kind", "text", "field_name", "switch", "original_text")
    blocks = segments.groupBy("template_id", "block_index").agg(F.array_sort(F.collect_list(segment)).alias("_s"))

    def head(s: Column) -> Column:
        return F.when(s["kind"] == "field", F.lit("«")).otherwise(F.left(s["text"], F.lit(1)))

    linked = F.transform(
        F.col("_s"),
        lambda s, i: F.struct(
            s["kind"].alias("kind"), s["text"].alias("text"), s["field_name"].alias("field_name"),
            s["switch"].alias("switch"), s["original_text"].alias("original_text"),
            F.coalesce(head(F.get(F.col("_s"), i + 1)), F.lit("")).alias("next_char"),
        ),
    )
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "segments")))
    return (
        blocks.select("template_id", "block_index", linked.alias("segments"))
        .groupBy("template_id").agg(ordered.alias("blocks"))
    )


def pad_spaces(shown: Column, text_before: Column, next_char: Column) -> Column:
    """A space where a merged value would stick to the text on its left or right."""
    left = F.when(~shown.rlike(r"(?U)^\s") & text_before.rlike(V.PAD_AFTER), F.lit(" ")).otherwise(F.lit(""))
    right = F.when(~shown.rlike(r"(?U)\s$") & next_char.rlike(V.PAD_BEFORE), F.lit(" ")).otherwise(F.lit(""))
    return F.when(shown == "", shown).otherwise(F.concat(left, shown, right))


def _render(segments: Column, values: Column, locked: Column) -> Column:
    """Text of one block: resolve each field, then append left to right with padding."""
    resolved = F.transform(
        segments,
        lambda s: F.struct(
            s["kind"].alias("kind"),
            F.when(
                s["kind"] == "field",
                T.merged_value(
                    s["field_name"], s["switch"], s["original_text"],
                    F.try_element_at(values, s["field_name"]), F.array_contains(locked, s["field_name"]),
                ),
            ).otherwise(s["text"]).alias("shown"),
            s["next_char"].alias("next_char"),
        ),
    )
    return F.aggregate(
        resolved,
        F.lit(""),
        lambda text, s: F.concat(
            text,
            F.when(s["kind"] == "field", pad_spaces(s["shown"], F.right(text, F.lit(1)), s["next_char"])).otherwise(
                s["shown"]
            ),
        ),
    )


def records_with_values(records: DataFrame, values: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """One row per record with its values as a map and its locks as an array.

    Values and locks go through one aggregation, so the values are shuffled once.
    """
    entries = values.select("record_id", F.struct(_value_order(values).alias("o"), "field_name", "value").alias("_e"), F.lit(None).cast("string").alias("_l"))
    if locks is not None:
        entries = entries.unionByName(
            locks.select(
                "record_id", F.lit(None).cast(entries.schema["_e"].dataType).alias("_e"), F.col("field_name").alias("_l")
            )
        )
    listed = entries.groupBy("record_id").agg(F.array_sort(F.collect_list("_e")).alias("_all"), F.collect_set("_l").alias("locked"))
    names = F.array_distinct(F.col("_all.field_name"))
    last = F.transform(names, lambda n: F.element_at(F.filter("_all", lambda e: e["field_name"] == n), -1)["value"])
    gathered = listed.select("record_id", F.map_from_arrays(names, last).alias("values"), "locked")
    empty_map, empty_list = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    return records.join(gathered, "record_id", "left").select(
        "record_id", "template_id",
        F.coalesce("values", empty_map).alias("values"), F.coalesce("locked", empty_list).alias("locked"),
    )


def render_blocks(records: DataFrame, segments: DataFrame, values: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Merged text per record and block."""
    rows = with_template(records_with_values(records, values, locks), template_bodies(segments), counted=records)
    return rows.select(
        "record_id", "template_id", "values", "locked", F.explode("blocks").alias("_b")
    ).select(
        "record_id", "template_id", F.col("_b.block_index").alias("block_index"),
        _render(F.col("_b.segments"), F.col("values"), F.col("locked")).alias("text"),
    )


def render_documents(records: DataFrame, segments: DataFrame, values: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Merged text per record.

    Values are gathered per record once; the template arrives as one nested
    row, and rendering happens inside the row: no shuffle of rendered text.
    """
    rows = with_template(records_with_values(records, values, locks), template_bodies(segments), counted=records)
    texts = F.transform(
        F.col("blocks"), lambda b: _render(b["segments"], F.col("values"), F.col("locked"))
    )
    return rows.select("record_id", "template_id", F.array_join(texts, "\n").alias("text"))


# --- reports -----------------------------------------------------------------
def record_fields(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Distinct fields per record with their place in the template."""
    first = fields.groupBy("template_id", "field_name").agg(
        F.min(F.struct("block_index", "seg_index")).alias("first_use")
    )
    return with_template(records, first)


def missing_fields(wanted: DataFrame, values: DataFrame, locks: DataFrame) -> DataFrame:
    """Unlocked fields without a visible value; three inputs share one partitioning."""
    keys = ["record_id", "field_name"]
    filled = values.where(~T.is_blank(F.col("value"))).select(*keys)
    return wanted.join(filled, keys, "left_anti").join(locks.select(*keys), keys, "left_anti")


def drop_locked(wanted: DataFrame, locks: DataFrame) -> DataFrame:
    """Fields that may be extracted: all but the locked ones."""
    keys = ["record_id", "field_name"]
    return wanted.join(locks.select(*keys), keys, "left_anti")


def fields_filled(values: DataFrame) -> DataFrame:
    return values.groupBy("record_id").agg(F.count_if(~T.is_blank(F.col("value"))).alias("fields_filled"))


def status_message(
    missing: Column, updated: Column, corrected: Column,
    missing_shown: int | None = None, corrected_shown: int | None = None,
) -> Column:
    """Reply after a fill message; the arrays are in field order. A shown number shortens a list and says how many are left."""

    def preview(names: Column, limit: int | None) -> Column:
        marks = F.transform(names, T.field_mark)
        if limit is None:
            return F.array_join(marks, ", ")
        rest = F.size(names) - limit
        more = F.when(rest > 0, F.concat(F.lit(V.MORE_FIELDS[0]), rest.cast("string"), F.lit(V.MORE_FIELDS[1]))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.slice(marks, 1, limit), ", "), more)

    changed, wanted = preview(corrected, corrected_shown), preview(missing, missing_shown)
    ask = F.concat(F.lit(V.ASK_MORE), wanted, F.lit("."))
    has_corrected, has_updated = F.size(corrected) > 0, F.size(updated) > 0
    while_missing = (
        F.when(has_corrected, F.concat(F.lit(V.CORRECTED), changed, F.lit(". "), ask))
        .when(has_updated, F.concat(F.lit(V.NOTED), ask))
        .otherwise(F.concat(F.lit(V.NOTHING_FOUND), wanted, F.lit(".")))
    )
    when_complete = (
        F.when(has_corrected, F.concat(F.lit(V.CORRECTED), changed, F.lit(V.NOW_COMPLETE)))
        .when(has_updated, F.lit(V.COMPLETE_AFTER_UPDATE))
        .otherwise(F.lit(V.COMPLETE_BEFORE))
    )
    return F.when(F.size(missing) > 0, while_missing).otherwise(when_complete)


def fill_status(states: DataFrame) -> DataFrame:
    """``states(record_id, first_use, field_name, status)`` -> one message per record.

    ``status`` is missing, updated, corrected or anything else.
    """
    ordered = F.array_sort(F.collect_list(F.struct("first_use", "field_name", "status")))

    def names(status: str) -> Column:
        return F.transform(F.filter(F.col("_f"), lambda f: f["status"] == status), lambda f: f["field_name"])

    return states.groupBy("record_id").agg(ordered.alias("_f")).select(
        "record_id",
        F.size(names("missing")).cast("bigint").alias("missing"),
        status_message(names("missing"), names("updated"), names("corrected")).alias("message"),
    )


def overlay_maps(*layers: DataFrame) -> DataFrame:
    """Later layers win per (record, field); an aggregate, so repeated keys combine before the shuffle."""
    ranked = None
    for priority, layer in enumerate(layers):
        rows = layer.select("record_id", "field_name", "value", F.lit(priority).alias("_p"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked.groupBy("record_id", "field_name").agg(F.max_by("value", "_p").alias("value"))


def prune_locks(locks: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Locks on fields that still exist, each once."""
    return locks.select(*keys).distinct().join(fields.select(*keys), keys, "left_semi")
