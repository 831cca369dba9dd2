"""Streams run to their end over the given tables, edit batches and the model hook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.functions.register import register_functions
from blankweave.plans.duck import duck, slug, title
from blankweave.plans.merge_queries import FILLED_SQL, MERGE_NEEDS, MERGED_SQL, PADDED_SQL
from blankweave.plans.registry import query
from blankweave.sources import fixtures as X
from blankweave.sources.writers import write_results
from blankweave.streaming import drafts as SD
from blankweave.streaming import fill as SF
from blankweave.streaming import runs
from blankweave.streaming.usage import usage_meter as meter


def _draft_changes(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKSDB)
    events = runs.stream_table(spark, d, "events")
    messages = X.draft_messages_of(events)
    drafts = X.drafts(spark, d)
    # The end of input moves the watermark past every draft, so keep them beyond it here.
    return SD.draft_state(messages, drafts, ttl_ms=100 * 365 * SD.DAY_MS)


@query("draft_state", duck("""
  SELECT draft_id, seq, field_name, coalesce(old, '') AS old_value, CASE WHEN is_explicit THEN 'explicit' WHEN trim(value) = '' OR NOT is_open THEN 'ignored'
    WHEN coalesce(trim(old), '') = '' THEN 'updated' WHEN old <> value THEN 'corrected' ELSE 'same' END AS change
  FROM (SELECT *, last_value(CASE WHEN is_explicit OR (trim(value) <> '' AND is_open) THEN value END IGNORE NULLS) OVER (
      PARTITION BY draft_id, field_name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM draft_messages)
""", "draft_messages"))
def draft_state(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_append(_draft_changes(spark, d), "draft-state").where("kind = 'message'").select("draft_id", "seq", "field_name", "old_value", "change")


@query("usage_meter", duck("""
  SELECT template_id, step, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
    CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM usage_rows GROUP BY ALL""", "usage_rows"))
def usage_meter(spark: SparkSession, d: str) -> DataFrame:
    totals = meter(X.usage_of(runs.stream_table(spark, d, "events")))
    return runs.run_keyed(totals, "usage-meter", ["template_id", "step"]).current()


@query("draft_merge", duck("""
  SELECT record_id, template_id, text, missing FROM (SELECT record_id, template_id, string_agg(text, chr(10) ORDER BY block_index) AS text FROM block_texts GROUP BY ALL)
  LEFT JOIN (SELECT record_id, string_agg(field_name, ',' ORDER BY first_use) AS missing FROM (
      SELECT record_id, field_name, min(block_index * 1000 + seg_index) AS first_use FROM joined WHERE kind = 'field' AND coalesce(trim(value), '') = '' GROUP BY ALL) GROUP BY record_id)
    USING (record_id)""", "letters", "draft_messages",
  held="""SELECT draft_id, field_name, value FROM (SELECT *, row_number() OVER (PARTITION BY draft_id, field_name ORDER BY ts DESC, seq DESC) AS rn
      FROM draft_messages WHERE is_explicit OR (trim(value) <> '' AND is_open)) WHERE rn = 1""",
  asked="SELECT DISTINCT user_id AS record_id, user_id % 3 AS template_id FROM events",
  renamed="SELECT * REPLACE (CASE field_name WHEN 'ho_ten' THEN 'click' WHEN 'nam' THEN 'view' ELSE field_name END AS field_name) FROM letters",
  joined="""SELECT a.record_id, a.template_id, l.block_index, l.seg_index, l.kind, l.text, l.field_name, l.switch, l.original_text, h.value, false AS is_locked
      FROM asked a JOIN renamed l USING (template_id) LEFT JOIN held h ON h.draft_id = a.record_id AND h.field_name = l.field_name""",
  filled=FILLED_SQL, **PADDED_SQL))
def draft_merge(spark: SparkSession, d: str) -> DataFrame:
    """Requests arrive as a stream and are merged with the values the drafts hold; a batch reads those of its drafts."""
    from blankweave.sources.paths import fresh_path, remove_folder

    held = runs.run_keyed(_draft_changes(spark, d), "draft-values", ["draft_id", "field_name"], SD.current_values, "append")
    letters = X.letter_templates(spark, d).withColumn(
        "field_name", F.expr("CASE field_name WHEN 'ho_ten' THEN 'click' WHEN 'nam' THEN 'view' ELSE field_name END")
    )
    wanted = runs.stream_table(spark, d, "events").select(
        F.col("user_id").alias("draft_id"), (F.col("user_id") % 3).alias("template_id")
    )
    path = fresh_path(spark, "draft-merge")
    query_ = (
        wanted.writeStream.foreachBatch(SD.merge_finished_drafts(lambda ids: held.current_of(ids, ["draft_id"]).where("value IS NOT NULL"), letters, f"{path}/merged"))
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    remove_folder(spark, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/merged").select(
        "record_id", "template_id", "text", F.array_join("missing", ",").alias("missing")
    )


# --- conversations ------------------------------------------------------------------------------
_FIELDS = ("ho_ten", "dia_chi", "ngay", "thang", "nam")
# A message of a user turn: two labels and a date, each left out at times; every fourth types the address in by hand.
_TALK = """concat(CASE WHEN turn % 3 <> 1 THEN concat('Họ tên: ', w1, '; ') ELSE '' END, CASE WHEN turn % 5 <> 2 THEN concat('Địa chỉ: ', w2, ' ', turn) ELSE 'không rõ' END,
  '. ', CASE WHEN (conv_id + turn) % 4 = 0 THEN concat('sinh ', 1 + turn % 28, '/', 1 + conv_id % 12, '/', 1990 + conv_id % 20) ELSE '' END)"""


def _talk(spark: SparkSession, d: str) -> DataFrame:
    """User turns of ``conversations`` as a stream of messages, a minute a turn."""
    turns = runs.stream_table(spark, d, "conversations").where("role = 'user' AND conv_id IS NOT NULL").selectExpr(
        "conv_id", "turn", "regexp_extract(text, '[A-Za-z]{3,}', 0) AS w1", "regexp_extract(text, '([A-Za-z]{2,})[^A-Za-z]*$', 1) AS w2",
    )
    return turns.selectExpr(
        "conv_id AS draft_id", "cast(turn AS bigint) AS seq", "timestamp_seconds(1700000000 + turn * 60) AS ts", f"{_TALK} AS message",
        "CASE WHEN turn % 8 = 4 THEN array('dia_chi') ELSE array() END AS typed_names",
        "CASE WHEN turn % 8 = 4 THEN array(CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'nhà' END) ELSE array() END AS typed_values",
    )


_TALK_SQL = dict(
    turns="""SELECT conv_id, CAST(turn AS BIGINT) AS turn, regexp_extract(text, '[A-Za-z]{3,}', 0) AS w1, regexp_extract(text, '([A-Za-z]{2,})[^A-Za-z]*$', 1) AS w2
      FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL""",
    dated="SELECT *, (conv_id + turn) % 4 = 0 AS d FROM turns",
    # What each message gives: typed values before extracted ones; a missing date or label gives nothing.
    given="""SELECT conv_id, turn, 0 AS step, 'dia_chi' AS f, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'nhà' END AS v FROM turns WHERE turn % 8 = 4
      UNION ALL SELECT conv_id, turn, 1, 'ho_ten', w1 FROM turns WHERE turn % 3 <> 1 AND w1 <> ''
      UNION ALL SELECT conv_id, turn, 1, 'dia_chi', trim(w2 || ' ' || turn) || '.' || CASE WHEN d THEN ' sinh ' || (1 + turn % 28) || '/' || (1 + conv_id % 12) || '/' || (1990 + conv_id % 20) ELSE '' END
        FROM dated WHERE turn % 5 <> 2
      UNION ALL SELECT conv_id, turn, 1, 'ngay', CAST(1 + turn % 28 AS VARCHAR) FROM dated WHERE d
      UNION ALL SELECT conv_id, turn, 1, 'thang', CAST(1 + conv_id % 12 AS VARCHAR) FROM dated WHERE d
      UNION ALL SELECT conv_id, turn, 1, 'nam', CAST(1990 + conv_id % 20 AS VARCHAR) FROM dated WHERE d AND conv_id % 10 <> 0""",
    ordered="""SELECT *, coalesce(lag(v) OVER (PARTITION BY conv_id, f ORDER BY turn, step), '') AS old FROM given""",
    names="SELECT * FROM (VALUES ('ho_ten', 1), ('dia_chi', 2), ('ngay', 3), ('thang', 4), ('nam', 5)) AS t(f, n)",
    changed="""SELECT conv_id, turn, string_agg(f, ',' ORDER BY n) FILTER (old = '') AS updated, string_agg(f, ',' ORDER BY n) FILTER (old <> '' AND old <> v) AS corrected
      FROM ordered JOIN names USING (f) WHERE step = 1 GROUP BY ALL""",
    held="""SELECT t.conv_id, t.turn, f, n, (SELECT arg_max(g.v, g.turn * 2 + g.step) FROM given g WHERE g.conv_id = t.conv_id AND g.f = names.f AND g.turn <= t.turn) AS v
      FROM turns t, names WHERE NOT (f = 'nam' AND t.conv_id % 10 = 0)""",
    lacking="SELECT conv_id, turn, string_agg(f, ',' ORDER BY n) FILTER (coalesce(v, '') = '') AS missing FROM held GROUP BY ALL",
)


def _fill_rows(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKSDB)
    names = ", ".join(f"'{f}'" for f in _FIELDS)
    drafts = X.table(spark, d, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("draft_id")).distinct().selectExpr(
        "draft_id", f"array({names}) AS fields", "CASE WHEN draft_id % 10 = 0 THEN array('nam') ELSE array() END AS locked"
    )
    return SF.fill_state(SF.with_pairs(_talk(spark, d), list(_FIELDS)), drafts, ttl_ms=100 * 365 * SD.DAY_MS)


@query("fill_conversation", duck("""
  SELECT t.conv_id AS draft_id, t.turn AS seq, coalesce(updated, '') AS updated, coalesce(corrected, '') AS corrected, coalesce(missing, '') AS missing
  FROM turns t LEFT JOIN changed USING (conv_id, turn) LEFT JOIN lacking USING (conv_id, turn)""", **_TALK_SQL))
def fill_conversation(spark: SparkSession, d: str) -> DataFrame:
    """Message text, extraction and draft state in one stream."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    rows = runs.run_append(_fill_rows(spark, d), "fill-conversation").where("kind = 'message'")
    return rows.select("draft_id", "seq", joined("updated"), joined("corrected"), joined("missing"))


@query("conversation_values", duck("""
  SELECT conv_id AS draft_id, f AS field_name, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, f ORDER BY turn DESC, step DESC) AS r FROM given) WHERE r = 1""", **_TALK_SQL))
def conversation_values(spark: SparkSession, d: str) -> DataFrame:
    """What the drafts of the conversations hold, from the table of current states that the stream keeps."""
    table = runs.run_keyed(_fill_rows(spark, d), "fill-values", ["draft_id"], SF.states, "append")
    return SF.held_values(table.current())


_TTL_HOURS, _LATE_HOURS = 12, 24


@query("draft_expiry", duck(f"""
  SELECT draft_id, 'message' AS kind, seq, ms AS at_ms, CASE WHEN row_number() OVER (PARTITION BY draft_id, session, field_name ORDER BY ts, seq) = 1 THEN field_name ELSE '' END AS updated FROM sessions
  UNION ALL SELECT draft_id, 'expired', NULL, ms + {_TTL_HOURS * 3600000}, '' FROM gaps
  WHERE next_ms >= ms + {_TTL_HOURS * 3600000} OR (next_ms IS NULL AND ms + {_TTL_HOURS * 3600000} < (SELECT max(ms) FROM stamped) - {_LATE_HOURS * 3600000})""",
  stamped="SELECT user_id AS draft_id, event_id AS seq, ts, epoch_us(ts) // 1000 AS ms, event_type AS field_name FROM events",
  gaps="SELECT *, lead(ms) OVER (PARTITION BY draft_id ORDER BY ts, seq) AS next_ms, lag(ms) OVER (PARTITION BY draft_id ORDER BY ts, seq) AS last_ms FROM stamped",
  sessions=f"""SELECT *, count(*) FILTER (ms >= last_ms + {_TTL_HOURS * 3600000}) OVER (PARTITION BY draft_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM gaps"""))
def draft_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Drafts that fall silent for half a day begin anew: sessions by gap, and timers for the last of each draft."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKSDB)
    events = runs.stream_table(spark, d, "events")
    messages = events.selectExpr(
        "user_id AS draft_id", "event_id AS seq", "ts", "array() AS typed_names", "array() AS typed_values", "array(event_type) AS pair_names", "array('v') AS pair_values"
    )
    drafts = X.table(spark, d, "events").select(F.col("user_id").alias("draft_id")).distinct().selectExpr(
        "draft_id", "array('click', 'error', 'purchase', 'signup', 'view') AS fields", "cast(array() AS array<string>) AS locked"
    )
    rows = SF.fill_state(messages, drafts, ttl_ms=_TTL_HOURS * 3600000, late_by=f"{_LATE_HOURS} hours")
    out = runs.run_append(rows, "draft-expiry").where("kind <> 'state'")
    return out.select("draft_id", "kind", "seq", F.unix_millis("ts").alias("at_ms"), F.array_join("updated", ",").alias("updated"))


# --- functions ---------------------------------------------------------------------------------
@query("registered_functions", duck(f"""
  SELECT doc_id, block_index, CAST(len(blanks) AS BIGINT) AS blanks, {slug('block_text')} AS slug, {title('block_text')} AS title
  FROM cut""", "cut"))
def registered_functions(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    return X.form_lines(spark, d).selectExpr(
        "doc_id", "block_index", "bigint(size(blank_spans(text))) AS blanks", "slugify_vi(text) AS slug",
        "title_py(text) AS title",
    )


@query("write_results", duck("""
  SELECT sha256(template_id || chr(31) || record_id) AS result_id, record_id, template_id, string_agg(text, chr(10) ORDER BY block_index) AS text
  FROM block_texts GROUP BY record_id, template_id""", *MERGE_NEEDS, **MERGED_SQL, **PADDED_SQL))
def write_merged(spark: SparkSession, d: str) -> DataFrame:
    """Merged documents written per template under keys that a rerun repeats."""
    from blankweave.operators.merge import render_documents
    from blankweave.sources.paths import fresh_path

    merged = render_documents(X.records(spark, d), X.letter_templates(spark, d), X.merge_values(spark, d), X.locks(spark, d))
    path = fresh_path(spark, "results")
    write_results(merged, path)
    return spark.read.parquet(path).select("result_id", "record_id", F.col("template_id").cast("bigint").alias("template_id"), "text")
