"""Text model hook and its model-free default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blankweave.functions import naming as N
from blankweave.functions import text as T

ModelFn = Callable[[list[str]], list[str]]


def map_model(prompts: DataFrame, make_fn: Callable[[], ModelFn], batch_size: int = 16) -> DataFrame:
    """``prompts(prompt_id, prompt)`` -> ``(prompt_id, raw, reply MAP, tokens)``.

    ``make_fn`` runs once per partition and returns the function that answers a
    list of prompts. A failed batch gives empty replies; callers see NULL raw.
    """

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                texts = part["prompt"].tolist()
                try:
                    replies = list(fn(texts))
                    if len(replies) != len(texts):
                        raise ValueError("one reply per prompt is needed")
                except Exception:  # the hook is foreign code: its failure must not end the job
                    replies = [None] * len(texts)
                yield pd.DataFrame({"prompt_id": part["prompt_id"].to_numpy(), "raw": replies})

    kind = prompts.schema["prompt_id"].dataType.simpleString()
    raw = prompts.select("prompt_id", "prompt").mapInPandas(answer, f"prompt_id {kind}, raw string")
    return raw.withColumn("reply", T.extract_json(F.col("raw")))


def reply_values(replies: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(prompt_id, field_name)`` with the value each reply gives, '' when it gives none."""
    return wanted.join(replies.select("prompt_id", "reply"), "prompt_id", "left").select(
        "prompt_id", "field_name",
        F.coalesce(F.try_element_at("reply", F.col("field_name")), F.lit("")).alias("value"),
    )


def planned_edits(replies: DataFrame) -> DataFrame:
    """Replies with an ``edits`` list -> ``(prompt_id, plan_order, raw_index, old_text, new_text, reason)``."""
    item = "block_index: STRING, old_text: STRING, new_text: STRING, reason: STRING"
    edits = F.from_json(F.try_element_at("reply", F.lit("edits")), f"ARRAY<STRUCT<{item}>>")
    return replies.select("prompt_id", F.posexplode(edits).alias("pos", "e")).select(
        "prompt_id", F.col("pos").cast("bigint").alias("plan_order"),
        F.col("e.block_index").alias("raw_index"), "e.old_text", "e.new_text", "e.reason",
    )


def suggested_renames(replies: DataFrame) -> DataFrame:
    """Replies with a ``renames`` list -> usable ``(prompt_id, old_name, new_name)`` pairs; the last one wins."""
    items = F.from_json(
        F.try_element_at("reply", F.lit("renames")), "ARRAY<STRUCT<current_name: STRING, suggested_name: STRING>>"
    )
    return (
        replies.select("prompt_id", F.posexplode(items).alias("pos", "r"))
        .select("prompt_id", "pos", F.col("r.current_name").alias("old_name"), F.col("r.suggested_name").alias("new_name"))
        .where("old_name <> '' AND new_name <> '' AND old_name <> new_name")
        .groupBy("prompt_id", "old_name").agg(F.max_by("new_name", "pos").alias("new_name"))
    )


def extracted_pairs(message: Column, fields: list[str]) -> Column:
    """``label: value`` pairs whose slug is a field, and the first date as day, month and year, as an array on the row.

    The last pair of a name wins, pairs win over the date; pairs without a value don't count.
    """
    pair = r"(?U)([^:;\n]+):[ \t]*([^;\n]*)"
    labels = F.regexp_extract_all(message, F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(message, F.lit(pair), F.lit(2))

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("field_name"), value.alias("value"))

    pairs = F.zip_with(labels, values, lambda label, value: entry(N.slugify(label), T.strip(value)))
    day_first = r"(?:^|\D)(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)"
    year_first = r"(?:^|\D)(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?!\d)"
    iso = message.rlike(year_first)

    def part(name: str, of_iso: int, of_day_first: int) -> Column:
        return entry(F.lit(name), F.when(iso, F.regexp_extract(message, year_first, of_iso)).otherwise(F.regexp_extract(message, day_first, of_day_first)))

    dates = F.array(part("ngay", 3, 1), part("thang", 2, 2), part("nam", 1, 3))
    known = F.filter(F.concat(dates, pairs), lambda p: F.coalesce(p["field_name"].isin(*fields) & (p["value"] != ""), F.lit(False)))

    def last_of(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["field_name"] == p["field_name"]))

    # The pairs are made once a message, and not again for each of them that is compared with those after it.
    last = F.get(F.transform(F.array(known), last_of), 0)
    return F.coalesce(last, F.array().cast("array<struct<field_name:string,value:string>>"))


def rule_extract(messages: DataFrame, fields: list[str]) -> DataFrame:
    """``extracted_pairs`` of ``messages(message_id, message)`` as rows ``(message_id, field_name, value)``.

    Of messages with one id the greatest value of a field is kept.
    """
    pairs = messages.select("message_id", F.explode(extracted_pairs(F.col("message"), fields)).alias("p"))
    return pairs.groupBy("message_id", "p.field_name").agg(F.max("p.value").alias("value"))
