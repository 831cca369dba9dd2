"""Ordered requests of mixed edits, each folded over its document inside one row.

Each edit is checked against the state that the edits before it in its request left, and
then applied. Edits that touch nothing in common don't depend on each other: every edit has
a footprint of names and blocks, and its level is one more than the highest level of an earlier
edit that shares part of its footprint. The edits of a level are checked against one state and
applied together, kind by kind.

A document meets its request in one equi-join on ``doc_id`` and passes through all levels in that row
(``in_row``), so segments clustered by document need no further exchange, however many levels there
are. What comes out is written once, as a row per document, and both results are read from there.

Edits that move blocks or may put fields anywhere (``update_text`` looks ahead) depend on all
before them, and all after them wait in turn; text updates that follow one another are one level, as
they are folded in order themselves.

A request is all or nothing: any failed check leaves its document as it was; so does a failed
execution under ``stop_on_error``, which also ends the request there. Without it, the edits that
worked are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blankweave.functions import naming as N
from blankweave.operators import in_row as I
from blankweave.operators import structure as ST
from blankweave.operators.structure import let
from blankweave.sources.paths import written

#: Kinds that move blocks or may put fields anywhere.
WHOLE = ("add_placeholder", "update_text", "delete_paragraph", "add_paragraph")

_NO_MAP = "cast(map() as map<string,{}>)"
_TABLES = "array<struct<table_index:bigint,n_rows:bigint,n_cols:bigint>>"
_TOLD = "array<struct<op_index:bigint,type:string,status:string,error:string>>"


def _asked(edits: DataFrame) -> DataFrame:
    """One row per document with its ``_edits`` in order."""
    for name in ("row_index", "col_index"):
        if name not in edits.columns:
            edits = edits.withColumn(name, F.lit(None).cast("bigint"))
    edit = F.struct(*[c for c in edits.columns if c != "doc_id"])
    listed = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list(edit).alias("_edits"))
    order = F.array_sort(F.transform("_edits", lambda e, i: F.struct(e["op_index"].alias("op_index"), i.alias("i"))))
    return listed.withColumn("_edits", let(order, lambda order: F.transform(order, lambda o: F.get("_edits", o["i"]))))


def _footprint(e: Column) -> Column:
    names = F.array_compact(F.array(e["old_name"], N.strip_suffix(e["old_name"]), e["new_name"], e["field_name"], N.strip_suffix(e["field_name"])))
    return F.struct(
        e["op_index"].alias("op_index"), e["type"].alias("type"), F.array_distinct(names).alias("names"), e["block_index"].alias("block"),
        e["type"].isin(*WHOLE).alias("whole"),
    )


def _places(blocks: Column, names: Column) -> Column:
    """The blocks in which fields of these names stand, by name."""
    def wanted(b: Column) -> Column:
        own = F.filter(b["segs"], lambda s: (s["kind"] == "field") & F.array_contains(names, s["field_name"]))
        return F.transform(own, lambda s: F.struct(s["field_name"].alias("name"), b["block_index"].alias("block")))

    def placed(fields: Column) -> Column:
        known = F.array_distinct(fields["name"])
        return F.map_from_entries(F.transform(known, lambda n: F.struct(n, F.array_distinct(F.filter(fields, lambda f: f["name"] == n)["block"]))))

    fields = F.flatten(F.transform(blocks, wanted))
    return F.coalesce(let(fields, placed), F.expr(_NO_MAP.format("array<bigint>")))


def _levels(edits: Column, blocks: Column) -> Column:
    """``op_index`` and ``level``, from 1, of the edits of a document; one fold over their footprints."""
    footprints = F.array_sort(F.transform(edits, _footprint))

    def put(old: Column, keys: Column, value: Column) -> Column:
        """``old`` with all ``keys`` set to ``value``."""
        fresh = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value)))
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(keys, k)), fresh)

    def step(state: Column, e: Column) -> Column:
        alone = e["whole"] | state["moved"]
        blocks = F.array_distinct(F.array_compact(F.concat(
            F.flatten(F.transform(e["names"], lambda n: F.coalesce(F.try_element_at(state["places"], n), F.array().cast("array<bigint>")))),
            F.array(e["block"]),
        )))
        touched = F.concat(F.transform(e["names"], lambda n: F.concat(F.lit("name "), n)), F.transform(blocks, lambda b: F.concat(F.lit("block "), b.cast("string"))))
        above = F.array_max(F.concat(F.array(state["floor"]), F.transform(touched, lambda t: F.coalesce(F.try_element_at(state["last"], t), F.lit(0)))))
        folded = (e["type"] == "update_text") & (state["kind"] == "update_text")
        level = F.when(folded, state["top"]).when(alone, state["top"] + 1).otherwise(above + 1)
        return F.struct(
            F.greatest(state["top"], level).alias("top"), F.when(alone, level).otherwise(state["floor"]).alias("floor"),
            put(state["last"], touched, level).alias("last"), put(state["places"], e["names"], blocks).alias("places"),
            (state["moved"] | e["whole"]).alias("moved"), e["type"].alias("kind"),
            F.concat(state["done"], F.array(F.struct(e["op_index"].alias("op_index"), level.alias("level")))).alias("done"),
        )

    def folded(footprints: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("top"), F.lit(0).alias("floor"), F.expr(_NO_MAP.format("int")).alias("last"),
            let(F.array_distinct(F.flatten(footprints["names"])), lambda names: _places(blocks, names)).alias("places"), F.lit(False).alias("moved"), F.lit("").alias("kind"),
            F.array().cast("array<struct<op_index:bigint,level:int>>").alias("done"),
        )
        return F.aggregate(footprints, start, step)["done"]

    return let(footprints, folded)


def dependency_levels(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` with their ``level``."""
    known = _asked(edits).join(I.documents(segments), "doc_id", "left")
    levels = known.select("doc_id", F.explode(_levels(F.col("_edits"), F.col("_blocks"))).alias("d"))
    return edits.join(levels.select("doc_id", "d.*"), ["doc_id", "op_index"])


def _levelled(edits: Column, levels: Column) -> Column:
    """Edits with their level; those that share an ``op_index`` have each level of it, those without one none."""
    def met(levels: Column) -> Column:
        single = (F.size(F.array_distinct(levels["op_index"])) == F.size(levels)) & ~F.exists(levels["op_index"], lambda i: i.isNull())
        many = F.flatten(F.transform(edits, lambda e: F.transform(F.filter(levels, lambda d: d["op_index"] == e["op_index"]), lambda d: F.struct(d["level"].alias("level"), e.alias("edit")))))
        return F.when(single, F.transform(edits, lambda e, i: F.struct(F.get(levels, i)["level"].alias("level"), e.alias("edit")))).otherwise(many)

    return let(levels, met)


def _applied(blocks: Column, checked: Column, clean: Column) -> Column:
    """One level: the edits that passed their checks applied kind by kind, and those that failed."""
    def step(state: Column, kind: Column) -> Column:
        own = F.filter(checked, lambda c: c["error"].isNull() & (c["edit"]["type"] == kind))["edit"]

        def after(own: Column) -> Column:
            done = I.done(state["blocks"])
            for name, apply in I.KINDS.items():
                done = F.when(kind == name, apply(state["blocks"], own, clean)).otherwise(done)
            return let(done, lambda o: F.struct(o["blocks"].alias("blocks"), F.concat(state["failed"], o["failed"]).alias("failed")))

        return let(own, after)

    asked = F.filter(F.array(*[F.lit(kind) for kind in I.KINDS]), lambda kind: F.exists(checked, lambda c: c["error"].isNull() & (c["edit"]["type"] == kind)))
    return F.aggregate(asked, I.done(blocks), step)


def _by_level(levelled: Column) -> Column:
    """The edits of each level, in order."""
    numbers = F.array_sort(F.array_distinct(levelled["level"]))
    return F.transform(numbers, lambda n: F.filter(levelled, lambda e: e["level"] == n)["edit"])


def _folded(levels: Column, blocks: Column, tables: Column, clean: Column) -> Column:
    """The blocks of a document after all levels, and what became of each edit."""
    def step(state: Column, edits: Column) -> Column:
        def told(c: Column, failed: Column) -> Column:
            def outcome(why: Column) -> Column:
                status = F.when(c["error"].isNotNull(), "validation_failed").when(why.isNotNull(), "failed").otherwise("executed")
                return F.struct(
                    c["edit"]["op_index"].alias("op_index"), c["edit"]["type"].alias("type"), status.alias("status"),
                    F.coalesce(c["error"], why["error"]).alias("error"),
                )

            return let(F.get(F.filter(failed, lambda f: f["op_index"] == c["edit"]["op_index"]), 0), outcome)

        def after(checked: Column) -> Column:
            return let(_applied(state["blocks"], checked, clean), lambda o: F.struct(
                o["blocks"].alias("blocks"), F.concat(state["done"], F.transform(checked, lambda c: told(c, o["failed"]))).alias("done")
            ))

        checked = let(I.info(state["blocks"]), lambda known: F.transform(edits, lambda e: F.struct(
            e.alias("edit"), ST.edit_error(e.__getitem__, known["fields"], known["n_blocks"], tables).alias("error")
        )))
        return let(checked, after)

    return F.aggregate(levels, F.struct(blocks.alias("blocks"), F.array().cast(_TOLD).alias("done")), step)


def _reached(done: Column, option: Column) -> Column:
    """What is told of the edits under an option, up to the one that ends the request."""
    bad = F.filter(done, lambda d: d["status"] != "executed")
    last = F.when(option["stops"], F.array_min(bad["op_index"]))

    def final(d: Column) -> Column:
        status = d["status"]
        return d.withField("status", F.when(option["dry"] & (status == "executed"), "validated").when(option["dry"] & (status == "failed"), "validation_failed").otherwise(status))

    return let(last, lambda last: F.struct(
        last.alias("last"), F.transform(F.filter(done, lambda d: last.isNull() | (d["op_index"] <= last)), final).alias("told")
    ))


def _undone(done: Column, options: Column) -> Column:
    def undone(option: Column) -> Column:
        return let(_reached(done, option), lambda r: option["dry"] | r["last"].isNotNull() | F.exists(r["told"], lambda d: d["status"] == "validation_failed"))

    return F.exists(options, undone)


def _outcome(segments: DataFrame, edits: DataFrame, requests: DataFrame | None, cells: DataFrame | None, how: str = "full") -> DataFrame:
    """One row per document: its ``blocks`` as they are in the end, and what is ``told`` of its edits."""
    documents, asked = I.documents(segments), _asked(edits)
    plain = F.struct(F.lit(False).alias("dry"), F.lit(True).alias("stops"))
    if requests is None:
        asked = asked.withColumn("_options", F.array(plain))
    else:
        option = F.struct(F.coalesce("validate_only", F.lit(False)).alias("dry"), F.coalesce("stop_on_error", F.lit(True)).alias("stops"))
        options = requests.groupBy("doc_id").agg(F.collect_list(option).alias("_options"))
        asked = asked.join(options, "doc_id", "left").withColumn("_options", F.coalesce("_options", F.array(plain)))
    if cells is None:
        asked = asked.withColumn("_tables", F.array().cast(_TABLES))
    else:
        asked = asked.join(ST.table_sizes(cells).withColumnRenamed("tables", "_tables"), "doc_id", "left")
    # A step a column, as the analyzer resolves only so many nested functions in one.
    asks = F.col("_edits").isNotNull()
    passed = (
        documents.join(asked, "doc_id", how)
        .withColumn("_levels", F.when(asks, _levels(F.col("_edits"), F.col("_blocks"))))
        .withColumn("_levels", F.when(asks, _by_level(_levelled(F.col("_edits"), F.col("_levels")))))
        .withColumn("_clean", F.when(asks, I.settled(F.col("_blocks"))))
        .withColumn("_end", F.when(asks, _folded(F.col("_levels"), F.col("_blocks"), F.col("_tables"), F.col("_clean"))))
    )
    kept = asks & ~_undone(F.col("_end.done"), F.col("_options"))
    told = F.flatten(F.transform("_options", lambda option: _reached(F.col("_end.done"), option)["told"]))
    return passed.select(
        "doc_id", F.when(kept, F.col("_end.blocks")).otherwise(F.col("_blocks")).alias("blocks"), F.when(asks, told).alias("told")
    )


def _told(outcome: DataFrame) -> DataFrame:
    # Not a bare column: Spark would test that for being empty first, and so run the fold three times.
    told = F.coalesce("told", F.array().cast(_TOLD))
    return outcome.select("doc_id", F.explode(told).alias("t")).select("doc_id", "t.*")


def apply_edits(segments: DataFrame, edits: DataFrame, requests: DataFrame | None = None, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests of mixed edits -> segments, and (doc_id, op_index, type, status, error) of every edit that was reached.

    ``edits`` has the columns of ``readers.EDIT_SCHEMA`` behind ``doc_id, op_index``; ``requests(doc_id, validate_only,
    stop_on_error)`` has options (default: false, true). Status is executed, validated, failed or validation_failed. Of
    kinds that change no segments (formats, tables, images, links) only the checks are made, in the same order.
    """
    outcome = written(_outcome(segments, edits, requests, cells), "edit-outcome")
    return I.rows_of(outcome, F.col("blocks"), *segments.columns), _told(outcome)


def edit_status(segments: DataFrame, edits: DataFrame, requests: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """The second result of ``apply_edits`` alone: all edits are applied, but the segments are not written."""
    return _told(_outcome(segments, edits, requests, cells, "right"))
