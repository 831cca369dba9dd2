"""Fill conversations over a finished table of messages.

``messages(draft_id, seq, ts, field_name, value, is_explicit)``: an explicit
value always counts, also a blank one; an extracted value counts only when it
shows something and, where ``drafts(draft_id, fields ARRAY, locked ARRAY)`` are
given, belongs to a field of the draft that isn't locked. One draft may hold any
share of all messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blankweave.functions import text as T
from blankweave.operators.ranking import previous_value
from blankweave.operators.skew import salted_join

#: Bands of a draft with more messages than one task should hold, and that number.
BANDS, BAND_ROWS = 128, 4096


def effective_value() -> Column:
    """The value a message leaves behind, NULL when it leaves the field alone."""
    value = F.coalesce("value", F.lit(""))
    return F.when(F.col("is_explicit"), value).when(F.col("_open") & ~T.is_blank(value), T.strip(value))


def _open_to(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Messages joined to ``known(draft_id, _fields, _locked, ...)``, one small row per draft; a draft may hold most of all messages."""
    joined = salted_join(messages, known, ["draft_id"], F.col("seq"))
    is_open = F.array_contains("_fields", F.col("field_name")) & ~F.array_contains("_locked", F.col("field_name"))
    return joined.withColumn("_open", is_open).drop("_fields", "_locked")


def _lists(drafts: DataFrame) -> DataFrame:
    return drafts.select("draft_id", F.col("fields").alias("_fields"), F.coalesce("locked", F.array().cast("array<string>")).alias("_locked"))


def with_open_fields(messages: DataFrame, drafts: DataFrame | None) -> DataFrame:
    """Messages with ``_open``: whether their field may be extracted. Messages of unknown drafts go."""
    return messages.withColumn("_open", F.lit(True)) if drafts is None else _open_to(messages, _lists(drafts))


def time_bands(messages: DataFrame, depth: int = BAND_ROWS) -> DataFrame:
    """``(draft_id, _edges)``: times that cut the messages of a draft into bands of about equal depth.

    A draft of ``depth`` messages or less is one band; a larger one has BANDS, however its messages lie in time. Messages
    of one instant stay together.
    """
    steps = [i / BANDS for i in range(1, BANDS)]
    counted = messages.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), steps, 20 * BANDS).alias("_cuts")
    )
    return counted.select("draft_id", F.when(F.col("_n") > depth, F.array_distinct("_cuts")).otherwise(F.array().cast("array<bigint>")).alias("_edges"))


def latest_values(messages: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """Final value per draft and field: an aggregate, combined before the shuffle."""
    return (
        with_open_fields(messages, drafts).withColumn("_v", effective_value()).where("_v IS NOT NULL")
        .groupBy("draft_id", "field_name")
        .agg(F.max_by("_v", F.struct("ts", "seq")).alias("value"))
    )


def classify(old: Column, value: Column, is_explicit: Column, is_open: Column) -> Column:
    return (
        F.when(is_explicit, F.lit("explicit"))
        .when(T.is_blank(value) | ~is_open, F.lit("ignored"))
        .when(T.is_blank(old), F.lit("updated"))
        .when(T.strip(old) != T.strip(value), F.lit("corrected"))
        .otherwise(F.lit("same"))
    )


def message_changes(messages: DataFrame, drafts: DataFrame | None = None, depth: int = BAND_ROWS) -> DataFrame:
    """Each message with the value before it and what it did; ``depth`` is about how many messages of a draft one task holds."""
    bands = time_bands(messages, depth)
    if drafts is None:
        placed = salted_join(messages, bands, ["draft_id"], F.col("seq")).withColumn("_open", F.lit(True))
    else:
        placed = _open_to(messages, _lists(drafts).join(bands, "draft_id"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    banded = placed.withColumn("_band", F.size(F.filter("_edges", lambda e: e < at))).drop("_edges")
    seen = previous_value(
        banded, ["draft_id", "field_name"], "_band", ["ts", "seq"], effective_value(), "old_value"
    ).drop("_band")
    old = F.coalesce("old_value", F.lit(""))
    return seen.withColumn("old_value", old).withColumn(
        "change", classify(F.col("old_value"), F.col("value"), F.col("is_explicit"), F.col("_open"))
    ).drop("_open")


COUNTERS = ("prompt_tokens", "completion_tokens", "total_tokens")


def complete_usage(usage: DataFrame) -> DataFrame:
    """A missing total is the sum of the two parts."""
    parts = F.col("prompt_tokens") + F.col("completion_tokens")
    return usage.withColumn("total_tokens", F.when(F.col("total_tokens") == 0, parts).otherwise(F.col("total_tokens")))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Token sums per step, per template and overall; empty steps are dropped."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTERS]
    return complete_usage(usage).rollup("template_id", "step").agg(*sums).where(
        "prompt_tokens + completion_tokens + total_tokens > 0"
    )
