"""Likely places for a missing blank, found by rules instead of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cues in order of precedence (field type, cue, portable pattern).
RULES = (
    ("checkbox", "box", r"\[ \]|□"),
    ("date", "date words", r"(?i)ngày\s.*tháng|tháng\s.*năm"),
    ("number", "number label", r"(?i)(^|[^\p{L}])(số|mã|cmnd|cccd|id)\s*:?\s*$|(?i)(^|[^\p{L}])(mã số|số điện thoại)"),
    ("text", "name label", r"(?i)tôi tên|họ và tên|họ tên|người ký"),
    ("text", "address label", r"(?i)địa chỉ|đơn vị|công ty"),
    ("text", "dots", r"__|\.\.\."),
    ("text", "gap", r"[^\s.,:;!?]  +[^\s]"),
)


def first_rule(text: Column, part: int) -> Column:
    """Field type (0) or cue (1) of the first rule that fires, NULL without one."""
    result = None
    for rule in RULES:
        # Unicode character classes so that white space and case rules match the text's language.
        fires = text.rlike("(?Uu)" + rule[2])
        result = F.when(fires, F.lit(rule[part])) if result is None else result.when(fires, F.lit(rule[part]))
    return result


def rule_suggestions(blocks: DataFrame) -> DataFrame:
    """At most one suggestion per block; blocks that already show a field get none.

    The rules are a fixed CASE over each row: no join, no ranking, no shuffle.
    """
    text = F.col("text")
    return (
        blocks.where(~text.rlike("«[^»]+»"))
        .select("doc_id", "block_index", first_rule(text, 0).alias("field_type"), first_rule(text, 1).alias("cue"))
        .where("cue IS NOT NULL")
    )
