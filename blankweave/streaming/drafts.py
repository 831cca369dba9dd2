"""Fill conversations as keyed streaming state.

One draft is one key. Its state is a map from field to value plus the time of
its last message. A draft that stays silent for the time to live is forgotten
by an event-time timer; messages older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from blankweave.operators import merge as M

DAY_MS = 24 * 60 * 60 * 1000

OUT_SCHEMA = (
    "draft_id bigint, kind string, seq bigint, ts timestamp, field_name string, value string, old_value string, change string, "
    "missing array<string>, updated array<string>, corrected array<string>"
)


class DraftProcessor(StatefulProcessor):
    """Overlay explicit values, then extracted ones that show something and may be extracted: those of unlocked fields of the draft."""

    def __init__(self, ttl_ms: int = DAY_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "field_name string", "value string")
        self.last = handle.getValueState("last", "ms bigint")

    def _touch(self, ms: int) -> None:
        """Move the expiry timer to a time to live after the newest message."""
        known = self.last.get()[0] if self.last.exists() else None
        if known is not None:
            if known >= ms:
                return
            self.handle.deleteTimer(known + self.ttl_ms)
        self.last.update((ms,))
        self.handle.registerTimer(ms + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = (frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)).sort_values(["ts", "seq"])
        out = []
        # The state is read once for all messages, and written once for each field that changed.
        before = {name: value for (name,), (value,) in self.values.iterator()}
        values = dict(before)
        columns = ("seq", "ts", "field_name", "value", "is_explicit", "fields", "locked")
        for seq, ts, name, value, is_explicit, fields, held in zip(*(batch[c].tolist() for c in columns), strict=True):
            value = "" if value is None or value != value else str(value)
            old, change = values.get(name, ""), "ignored"
            locked = held if held is not None else ()
            if is_explicit:
                change = "explicit"
            elif value.strip() and name not in locked and name in fields:
                change = "updated" if not old.strip() else "corrected" if old.strip() != value.strip() else "same"
                value = value.strip()
            if change != "ignored":
                values[name] = value
            missing = [f for f in fields if f not in locked and not values.get(f, "").strip()]
            out.append((
                key[0], "message", seq, ts, name, value, old, change, missing,
                [name] if change == "updated" else [], [name] if change == "corrected" else [],
            ))
        for name, value in values.items():
            if before.get(name) != value:
                self.values.updateValue((name,), (value,))
        self._touch(int(batch["ts"].iloc[-1].value // 1_000_000))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        self.values.clear()
        self.last.clear()
        gone = datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)
        yield _frame([(key[0], "expired", None, gone, None, None, None, None, [], [], [])])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.strip().split(" ")[0] for part in OUT_SCHEMA.split(",")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    frame["ts"] = pd.to_datetime(frame["ts"])
    return frame


def draft_state(messages: DataFrame, drafts: DataFrame, ttl_ms: int = DAY_MS, late_by: str = "24 hours") -> DataFrame:
    """Stream of messages -> one row per message with what it did and what is still missing.

    ``messages(draft_id, seq, ts, field_name, value, is_explicit)``;
    ``drafts(draft_id, fields ARRAY, locked ARRAY)`` is a static table. Needs
    the RocksDB state store.
    """
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late_by)
    known = timed.join(drafts, "draft_id")
    rows = known.groupBy("draft_id").transformWithStateInPandas(
        statefulProcessor=DraftProcessor(ttl_ms), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    return rows.withColumn(
        "message",
        F.when(F.col("kind") == "message", M.status_message(F.col("missing"), F.col("updated"), F.col("corrected"))),
    )


def state_values(changes: DataFrame) -> DataFrame:
    """Finished output of ``draft_state`` -> current value per draft and field.

    What lies before the expiry of a draft no longer counts.
    """
    expiry = changes.where("kind = 'expired'").groupBy("draft_id").agg(F.max("ts").alias("_gone"))
    effective = changes.where("change IN ('explicit', 'updated', 'corrected', 'same')")
    return (
        effective.join(expiry, "draft_id", "left").where("_gone IS NULL OR ts > _gone")
        .groupBy("draft_id", "field_name").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    )


def current_values(changes: DataFrame) -> DataFrame:
    """The changes of one batch as rows of a table keyed by draft and field; NULL where the draft expired after them.

    The batch is read once: a second use would run its messages through the state again.
    """
    counts, order = F.col("change").isin("explicit", "updated", "corrected", "same"), F.struct("ts", "seq")
    groups = changes.groupBy("draft_id", "field_name").agg(
        F.max_by(F.when(counts, F.struct("value", "ts")), F.when(counts, order)).alias("l"),
        F.max(F.when(F.col("kind") == "expired", F.col("ts"))).alias("_gone"),
    )
    gone = F.max("_gone").over(W.partitionBy("draft_id"))
    alive = F.col("_gone").isNull() | (F.col("l.ts") > F.col("_gone"))
    return groups.withColumn("_gone", gone).where("l IS NOT NULL").select(
        "draft_id", "field_name", F.when(alive, F.col("l.value")).alias("value"), F.col("l.ts").alias("ts")
    )


def merge_finished_drafts(values_of, segments: DataFrame, out_path: str, locks: DataFrame | None = None):
    """``foreachBatch`` function: merge the drafts of a batch of ``(draft_id, template_id)`` requests.

    ``values_of(wanted)`` gives (draft_id, field_name, value) as they are now, for the drafts of the batch; a
    ``KeyedTable`` reads only what holds those. Each batch owns one partition folder and overwrites it, so a batch that
    runs again after a failure leaves no second copy. Missing fields are listed, not refused.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.select(F.col("draft_id").alias("record_id"), "template_id").distinct()
        values = values_of(batch.select("draft_id").distinct()).select(F.col("draft_id").alias("record_id"), "field_name", "value")
        fields = segments.where("kind = 'field'")
        lock_rows = locks if locks is not None else values.select("record_id", "field_name").where("false")
        missing = (
            M.missing_fields(M.record_fields(wanted, fields), values, lock_rows)
            .groupBy("record_id").agg(
                F.array_sort(F.collect_list(F.struct("first_use", "field_name"))).alias("_m")
            )
            .select("record_id", F.col("_m.field_name").alias("missing"))
        )
        merged = M.render_documents(wanted, segments, values, locks).join(missing, "record_id", "left")
        merged.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return write
