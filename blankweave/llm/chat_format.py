"""Chat examples by prefix-target expansion, in DataFrame functions only.

Every assistant turn of a conversation becomes one example: all turns before it are the
context, and only its own text is under the loss. Turns after the last assistant turn, or a
conversation without one, make one more example without a target, so that nothing is lost.

A turn is written as ``### Role: text</turn>`` and a line feed. Inside roles and texts the
signs that control strings are made of are escaped: backslash, ``<`` and ``#`` (in roles also
``:``) become a backslash and a letter. So no control string can arise from a text, and plain
replacement turns everything back.

Defined results: null text and null role are empty; turns are ordered by turn, then role and
text; repeated rows are turns of their own; a null conv_id is a conversation of its own; an
empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
#: Sign and escape, in the order of escaping.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def _replaced(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(value: Column, pairs=ESCAPES) -> Column:
    return _replaced(value, pairs)


def unescape(value: Column, pairs=ESCAPES) -> Column:
    """The backslash comes back last, so it can't combine with a letter of the text."""
    return _replaced(value, [(new, old) for old, new in reversed(pairs)])


def format_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars, last): loss offsets are code points from 0; ``last`` marks the
    example that holds the whole conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    body = escape(text)
    turn = F.struct(
        F.col("turn").alias("turn"), role.alias("role"), body.alias("body"),
        F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(SEPARATOR)).alias("head"),
    )
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    targets = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["role"] == "assistant")
    ends = F.when(F.get("turns", F.size("turns") - 1)["role"] == "assistant", F.col("targets")).otherwise(F.concat("targets", F.array(F.size("turns") - 1)))
    examples = whole.withColumn("targets", targets).select("conv_id", "turns", F.posexplode(ends).alias("example", "at"))
    written = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    final = F.get("turns", F.col("at"))
    rows = examples.select(
        "conv_id", F.col("example").cast("long").alias("example"),
        F.array_join(F.slice(written, F.lit(1), F.col("at")), "").alias("context"), final["head"].alias("head"), final["body"].alias("body"),
        (final["role"] == "assistant").alias("trained"), (F.col("at") == F.size("turns") - 1).alias("last"),
    )
    return rows.select(
        "conv_id", "example", F.concat("context", "head", "body", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("trained"), F.char_length("context") + F.char_length("head")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.char_length("body")).otherwise(0).cast("long").alias("loss_chars"), "last",
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, SEPARATOR)
        head, body = F.substring(piece, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1)), F.substring(piece, at + len(SEPARATOR), F.char_length(piece))
        return F.struct(unescape(head, ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask; empty without a target."""
    return F.coalesce(unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int"))), F.lit(""))


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    examples = format_examples(conversations)
    read = examples.select(
        "conv_id", "example", F.when(F.col("last"), read_turns(F.col("formatted"))).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    found = read.select("conv_id", "example", F.size("turns").alias("n"), F.array_join(lines, "").alias("lines"), "loss", "chars").groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("lines").alias("lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: DuckDB SQL for the query's rows: all conversations and one that quotes the template.
REPORT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n,
    -- '### ', ': ', '</turn>' and a line feed are 14 signs; every escaped sign counts twice
    14 + length(role) + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
      + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS chars
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM numbered
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
