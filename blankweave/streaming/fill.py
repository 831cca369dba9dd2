"""Fill conversations from message text to current values.

A message of free text becomes an array of extracted pairs on its own row; the pairs and the
values that the user typed are one update of the draft's keyed state. A draft that was silent for
the time to live begins anew, whether the silence ended inside a batch or a timer found it, so
results don't depend on how messages are dealt into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blankweave.operators import merge as M
from blankweave.operators.model import extracted_pairs
from blankweave.streaming.drafts import DAY_MS, DraftProcessor

OUT_SCHEMA = (
    "draft_id bigint, kind string, seq bigint, ts timestamp, missing array<string>, updated array<string>, corrected array<string>, "
    "names array<string>, held array<string>"
)


class FillProcessor(DraftProcessor):
    """One output row per message and expiry, and one ``state`` row per batch with all values the draft holds."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True).sort_values(["ts", "seq"])
        values = {name: value for (name,), (value,) in self.values.iterator()}
        before = dict(values)
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for row in batch.to_dict("records"):
            ms = int(row["ts"].value // 1_000_000)
            if last is not None and ms >= last + self.ttl_ms:
                out.append((key[0], "expired", None, _at(last + self.ttl_ms), [], [], [], None, None))
                values = {}
            last = ms if last is None else max(last, ms)
            fields, locked = list(row["fields"]), set(_items(row["locked"]))
            values.update(zip(_items(row["typed_names"]), _items(row["typed_values"])))
            given = dict(zip(_items(row["pair_names"]), _items(row["pair_values"])))
            updated, corrected = [], []
            for name in fields:
                value = (given.get(name) or "").strip()
                if not value or name in locked:
                    continue
                old = (values.get(name) or "").strip()
                values[name] = value
                if not old:
                    updated.append(name)
                elif old != value:
                    corrected.append(name)
            missing = [f for f in fields if f not in locked and not (values.get(f) or "").strip()]
            out.append((key[0], "message", row["seq"], row["ts"], missing, updated, corrected, None, None))
        for name in before.keys() - values.keys():
            self.values.removeKey((name,))
        for name, value in values.items():
            if before.get(name) != value:
                self.values.updateValue((name,), (value,))
        self._touch(last)
        out.append((key[0], "state", None, _at(last), [], [], [], list(values), list(values.values())))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        self.values.clear()
        self.last.clear()
        gone = _at(ms)
        yield _frame([(key[0], "expired", None, gone, [], [], [], None, None), (key[0], "state", None, gone, [], [], [], [], [])])


def _items(value) -> list:
    return [] if value is None else list(value)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.strip().split(" ")[0] for part in OUT_SCHEMA.split(",")]
    frame = pd.DataFrame({name: pd.Series([row[i] for row in rows], dtype=object) for i, name in enumerate(names)})
    frame["ts"] = pd.to_datetime(frame["ts"])
    return frame


def with_pairs(messages: DataFrame, fields: list[str], text: str = "message") -> DataFrame:
    """Messages of free text with ``pair_names`` and ``pair_values``: what the rules extract, on the row itself."""
    pairs = extracted_pairs(F.col(text), fields)
    return messages.withColumn("_pairs", pairs).withColumn("pair_names", F.col("_pairs.field_name")).withColumn("pair_values", F.col("_pairs.value")).drop("_pairs")


def fill_state(messages: DataFrame, drafts: DataFrame, ttl_ms: int = DAY_MS, late_by: str = "24 hours") -> DataFrame:
    """Stream of messages -> what each did and what is missing, expiries, and the state of each touched draft per batch.

    ``messages(draft_id, seq, ts, typed_names, typed_values, pair_names, pair_values)``, names and values being arrays
    in step; ``drafts(draft_id, fields, locked)`` is a static table. Needs the RocksDB state store.
    """
    columns = ["draft_id", "seq", "ts", "typed_names", "typed_values", "pair_names", "pair_values", "fields", "locked"]
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late_by)
    rows = timed.join(drafts, "draft_id").select(*columns).groupBy("draft_id").transformWithStateInPandas(
        statefulProcessor=FillProcessor(ttl_ms), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    return rows.withColumn("message", F.when(F.col("kind") == "message", M.status_message(F.col("missing"), F.col("updated"), F.col("corrected"))))


def states(rows: DataFrame) -> DataFrame:
    """The last state of each draft in a batch of ``fill_state``: (draft_id, names, held)."""
    # A timer fires after the messages of its batch, with an empty state.
    order = F.struct(F.col("ts"), F.size("names") == 0)
    return rows.where("kind = 'state'").groupBy("draft_id").agg(F.max_by(F.struct("names", "held"), order).alias("s")).select("draft_id", "s.names", "s.held")


def held_values(current: DataFrame) -> DataFrame:
    """(draft_id, field_name, value) of current states."""
    return current.select("draft_id", F.explode(F.arrays_zip("names", "held")).alias("p")).select("draft_id", F.col("p.names").alias("field_name"), F.col("p.held").alias("value"))
