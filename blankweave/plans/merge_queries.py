"""Queries over merge records, fill messages and JSON inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.operators import drafts as D
from blankweave.operators import fields as FL
from blankweave.operators import merge as M
from blankweave.plans.duck import duck, merged
from blankweave.plans.registry import query
from blankweave.sources import fixtures as X
from blankweave.sources import readers as R


def letter_fields(spark: SparkSession, d: str) -> DataFrame:
    return X.letter_templates(spark, d).where("kind = 'field'").drop("kind", "text")


FILLED_SQL = f"""SELECT *, CASE WHEN kind = 'text' THEN text ELSE {merged('original_text', 'value', 'is_locked')} END AS shown FROM joined"""
MERGED_SQL = dict(
    joined="""SELECT r.record_id, r.template_id, l.block_index, l.seg_index, l.kind, l.text, l.field_name, l.switch, l.original_text,
        v.value, k.record_id IS NOT NULL AS is_locked
      FROM records r JOIN letters l ON r.template_id = l.template_id
      LEFT JOIN merge_values v ON v.record_id = r.record_id AND v.field_name = l.field_name
      LEFT JOIN locks k ON k.record_id = r.record_id AND k.field_name = l.field_name""",
    filled=FILLED_SQL,
)
MERGE_NEEDS = ("records", "letters", "merge_values", "locks")


@query("merge_values", duck("""
  SELECT record_id, template_id, CAST(block_index AS BIGINT) AS block_index, CAST(seg_index AS BIGINT) AS seg_index, field_name, shown
  FROM filled WHERE kind = 'field'""", *MERGE_NEEDS, **MERGED_SQL))
def merge_values(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_values(X.records(spark, d), letter_fields(spark, d), X.merge_values(spark, d), X.locks(spark, d))


PADDED_SQL = dict(
    near=r"""SELECT *, coalesce(last_value(nullif(right(shown, 1), '') IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev,
        coalesce(lead(CASE WHEN kind = 'field' THEN '«' ELSE left(text, 1) END) OVER b, '') AS nxt
      FROM filled WINDOW b AS (PARTITION BY record_id, block_index ORDER BY seg_index)""",
    padded=r"""SELECT *, CASE WHEN kind = 'text' OR shown = '' THEN shown ELSE
        CASE WHEN NOT regexp_matches(shown, '^\s') AND regexp_matches(prev, '[\p{L}.,:;>)\]}]') THEN ' ' ELSE '' END || shown ||
        CASE WHEN NOT regexp_matches(shown, '\s$') AND regexp_matches(nxt, '[\p{L}<(\[{]') THEN ' ' ELSE '' END END AS piece FROM near""",
    block_texts="SELECT record_id, template_id, block_index, string_agg(piece, '' ORDER BY seg_index) AS text FROM padded GROUP BY ALL",
)


@query("pad_spaces", duck(
    "SELECT record_id, template_id, CAST(block_index AS BIGINT) AS block_index, text FROM block_texts",
    *MERGE_NEEDS, **MERGED_SQL, **PADDED_SQL))
def pad_spaces(spark: SparkSession, d: str) -> DataFrame:
    return M.render_blocks(
        X.records(spark, d), X.letter_templates(spark, d), X.merge_values(spark, d), X.locks(spark, d)
    )


@query("render_documents", duck(
    "SELECT record_id, template_id, string_agg(text, chr(10) ORDER BY block_index) AS text FROM block_texts GROUP BY ALL",
    *MERGE_NEEDS, **MERGED_SQL, **PADDED_SQL))
def render_documents(spark: SparkSession, d: str) -> DataFrame:
    return M.render_documents(
        X.records(spark, d), X.letter_templates(spark, d), X.merge_values(spark, d), X.locks(spark, d)
    )


# Forms converted from documents serve as templates; one of them serves two thirds of all records.
_FORM_RECORDS = "CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE o_orderkey % 1009 END"
_FORM_VALUES = "CASE {f} WHEN 'field' THEN c_name WHEN 'field_2' THEN o_orderstatus WHEN 'ck_field' THEN CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE '' END ELSE lower(c_mktsegment) END"
_FORM_NAMES = ("field", "field_2", "ck_field", "field_7", "no_such_field")


@query("render_forms", duck(
    "SELECT record_id, template_id, count(*) AS blocks, md5(string_agg(text, chr(10) ORDER BY block_index)) AS text_md5 FROM block_texts GROUP BY ALL", "tseg",
    records=f"SELECT o_orderkey AS record_id, {_FORM_RECORDS} AS template_id FROM orders",
    letters="SELECT doc_id AS template_id, block_index, seg_index, kind, text, field_name, switch, original_text FROM tseg",
    merge_values=f"""SELECT o_orderkey AS record_id, f.field_name, {_FORM_VALUES.format(f='f.field_name')} AS value FROM orders JOIN customer ON o_custkey = c_custkey
      CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in _FORM_NAMES)}) AS f(field_name)""",
    locks="SELECT record_id, 'field_7' AS field_name FROM records WHERE record_id % 10 = 0", **MERGED_SQL, **PADDED_SQL))
def render_forms(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = X.table(spark, d, "orders"), X.table(spark, d, "customer")
    records = orders.selectExpr("o_orderkey AS record_id", f"{_FORM_RECORDS} AS template_id")
    names = F.explode(F.array(*map(F.lit, _FORM_NAMES))).alias("field_name")
    values = orders.join(customer, orders.o_custkey == customer.c_custkey).select("*", names).selectExpr(
        "o_orderkey AS record_id", "field_name", f"{_FORM_VALUES.format(f='field_name')} AS value"
    )
    forms = FL.convert_blocks(X.form_blocks(spark, d)).withColumnRenamed("doc_id", "template_id")
    locks = records.where("record_id % 10 = 0").select("record_id", F.lit("field_7").alias("field_name"))
    rows = M.render_documents(records, forms, values, locks)
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    return rows.select("record_id", "template_id", lines.alias("blocks"), F.md5("text").alias("text_md5"))


_WANTED = dict(wanted="""SELECT DISTINCT r.record_id, r.template_id, l.field_name FROM records r JOIN letters l USING (template_id)
  WHERE l.kind = 'field'""")


@query("missing_fields", duck("""
  SELECT record_id, field_name FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM merge_values v WHERE v.record_id = w.record_id
      AND v.field_name = w.field_name AND trim(v.value) <> '')
    AND NOT EXISTS (SELECT 1 FROM locks k WHERE k.record_id = w.record_id AND k.field_name = w.field_name)
""", *MERGE_NEEDS, **_WANTED))
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    wanted = M.record_fields(X.records(spark, d), letter_fields(spark, d))
    return M.missing_fields(wanted, X.merge_values(spark, d), X.locks(spark, d)).select("record_id", "field_name")


@query("drop_locked", duck("""
  SELECT record_id, field_name FROM wanted WHERE NOT (record_id % 10 = 0 AND field_name = 'nam')""", "records", "letters", **_WANTED))
def drop_locked(spark: SparkSession, d: str) -> DataFrame:
    wanted = M.record_fields(X.records(spark, d), letter_fields(spark, d))
    return M.drop_locked(wanted, X.locks(spark, d)).select("record_id", "field_name")


@query("fields_filled", duck("""
  SELECT record_id, count(*) FILTER (trim(value) <> '') AS fields_filled FROM merge_values GROUP BY record_id""", "merge_values"))
def fields_filled(spark: SparkSession, d: str) -> DataFrame:
    return M.fields_filled(X.merge_values(spark, d))


_STATES = dict(
    states="""SELECT r.record_id, l.field_name, min(l.block_index * 100 + l.seg_index) AS first_use,
        CASE WHEN coalesce(trim(v.value), '') = '' THEN 'missing' WHEN r.record_id % 5 = 0 THEN 'corrected'
          WHEN r.record_id % 3 <> 0 THEN 'updated' ELSE 'kept' END AS status
      FROM records r JOIN letters l ON r.template_id = l.template_id AND l.kind = 'field'
      LEFT JOIN merge_values v ON v.record_id = r.record_id AND v.field_name = l.field_name
      WHERE NOT (r.record_id % 2 = 0 AND l.template_id <> 1 AND coalesce(v.value, '') = '') GROUP BY ALL""",
    lists="""SELECT record_id, coalesce(list('«' || field_name || '»' ORDER BY first_use) FILTER (status = 'missing'), []) AS m,
        coalesce(list('«' || field_name || '»' ORDER BY first_use) FILTER (status = 'updated'), []) AS u,
        coalesce(list('«' || field_name || '»' ORDER BY first_use) FILTER (status = 'corrected'), []) AS c
      FROM states GROUP BY record_id""",
    previews="""SELECT *, array_to_string(m, ', ') AS mp,
        array_to_string(c, ', ') AS cp FROM lists""",
)


@query("fill_status_message", duck("""
  SELECT record_id, CAST(len(m) AS BIGINT) AS missing, CASE
    WHEN len(m) > 0 AND len(c) > 0 THEN 'Đã sửa ' || cp || '. Anh/chị vui lòng cung cấp thêm: ' || mp || '.'
    WHEN len(m) > 0 AND len(u) > 0 THEN 'Đã ghi nhận thông tin mới. Anh/chị vui lòng cung cấp thêm: ' || mp || '.'
    WHEN len(m) > 0 THEN 'Chưa tìm thấy thông tin phù hợp. Anh/chị vui lòng cung cấp: ' || mp || '.'
    WHEN len(c) > 0 THEN 'Đã sửa ' || cp || '. Thông tin hiện đã đủ để tạo tài liệu.'
    WHEN len(u) > 0 THEN 'Đã đủ thông tin để tạo tài liệu. Anh/chị có thể kiểm tra lại các giá trị và thực hiện merge.'
    ELSE 'Các thông tin bắt buộc hiện đã đủ. Anh/chị có thể thực hiện merge.' END AS message FROM previews
""", "records", "letters", "merge_values", **_STATES))
def fill_status_message(spark: SparkSession, d: str) -> DataFrame:
    rows = M.record_fields(X.records(spark, d), letter_fields(spark, d)).join(
        X.merge_values(spark, d), ["record_id", "field_name"], "left"
    ).where("NOT (record_id % 2 = 0 AND template_id <> 1 AND coalesce(value, '') = '')")
    status = F.expr("""CASE WHEN coalesce(trim(value), '') = '' THEN 'missing' WHEN record_id % 5 = 0 THEN 'corrected'
      WHEN record_id % 3 <> 0 THEN 'updated' ELSE 'kept' END""")
    return M.fill_status(rows.withColumn("status", status))


@query("overlay_maps", duck("""
  SELECT record_id, field_name, coalesce(max(value) FILTER (layer = 1), max(value) FILTER (layer = 0)) AS value FROM (
    SELECT record_id, field_name, value, 0 AS layer FROM merge_values
    UNION ALL SELECT record_id, 'nam', '' || record_id % 7, 1 FROM records WHERE record_id % 4 = 0
    UNION ALL SELECT record_id, 'moi', 'x', 1 FROM records WHERE record_id % 6 = 0) GROUP BY ALL""", "merge_values", "records"))
def overlay_maps(spark: SparkSession, d: str) -> DataFrame:
    records = X.records(spark, d)
    later = records.where("record_id % 4 = 0").selectExpr("record_id", "'nam' AS field_name", "string(record_id % 7) AS value").union(
        records.where("record_id % 6 = 0").selectExpr("record_id", "'moi'", "'x'")
    )
    return M.overlay_maps(X.merge_values(spark, d), later)


# --- JSON inputs ---------------------------------------------------------------
@query("read_values", duck("""
  SELECT DISTINCT r.record_id, l.field_name, CASE l.field_name WHEN 'nam' THEN strftime(o_orderdate, '%Y')
    WHEN 'ho_ten' THEN CASE WHEN r.record_id % 2 = 0 THEN o_orderpriority ELSE '' END ELSE '' END AS value
  FROM records r JOIN letters l ON r.template_id = l.template_id AND l.kind = 'field' JOIN orders ON o_orderkey = record_id
""", "records", "letters"))
def read_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.create_map(
        F.lit("nam"), F.date_format("o_orderdate", "yyyy"), F.lit("thua"), F.lit("x"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("ho_ten")).otherwise(F.lit("khac")), F.col("o_orderpriority"),
    ))
    requests = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 3).alias("template_id"), raw.alias("field_values")
    )
    return R.read_values(requests, letter_fields(spark, d))


_LOCK_LISTS = """CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '["a", null, ' || user_id || ']'
  WHEN 3 THEN '{"bad": 1}' ELSE '["' || event_type || '"]' END"""


@query("read_locks", """
  SELECT event_id, 'a' AS field_name FROM events WHERE event_id % 5 = 2
  UNION ALL SELECT event_id, CAST(user_id AS VARCHAR) FROM events WHERE event_id % 5 = 2
  UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 5 = 4""")
def read_locks(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "events").select("event_id", F.expr(_LOCK_LISTS).alias("raw"))
    return R.read_locks(rows, "event_id", "raw")[0]


@query("read_locks_rejects", """SELECT event_id, 'expected a JSON list' AS reason FROM events WHERE event_id % 5 = 3""")
def read_locks_rejects(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "events").select("event_id", F.expr(_LOCK_LISTS).alias("raw"))
    return R.read_locks(rows, "event_id", "raw")[1].select("event_id", "reason")


@query("read_requirements", """
  SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS total_fields,
    CASE event_id % 3 WHEN 0 THEN event_type || ',x,x' WHEN 1 THEN event_type ELSE '' END AS table_fields FROM events""")
def read_requirements(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"bang": ["' || event_type || '", "x"], "khac": ["x"]}'
      WHEN 1 THEN '{"bang": ["' || event_type || '"], "rong": []}' ELSE '{}' END""")
    rows = X.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return R.read_requirements(rows, "event_id", "raw").withColumn("table_fields", F.array_join("table_fields", ","))


@query("read_edits", """
  SELECT event_id AS template_id, CAST(0 AS BIGINT) AS op_index, 'rename_placeholder' AS type, CAST(NULL AS VARCHAR) AS position FROM events WHERE event_id % 4 <> 3
  UNION ALL SELECT event_id, 1, 'add_placeholder', 'right' FROM events WHERE event_id % 4 <> 3 AND event_id % 5 > 0
  UNION ALL SELECT event_id, 2, 'delete_text_range', NULL FROM events WHERE event_id % 4 <> 3 AND event_id % 7 > 0""")
def read_edits(spark: SparkSession, d: str) -> DataFrame:
    return R.read_edits(_edit_requests(spark, d))[0].select("template_id", "op_index", "type", "position")


@query("read_edits_rejects", """
  SELECT event_id AS template_id, CAST(-1 AS BIGINT) AS op_index, CAST(NULL AS VARCHAR) AS type, 'no operation' AS reason FROM events WHERE event_id % 4 = 3
  UNION ALL SELECT event_id, 1, 'add_placeholder', 'block_index is negative' FROM events WHERE event_id % 4 <> 3 AND event_id % 5 = 0
  UNION ALL SELECT event_id, 2, 'delete_text_range', 'end_offset is not positive' FROM events WHERE event_id % 4 <> 3 AND event_id % 7 = 0""")
def read_edits_rejects(spark: SparkSession, d: str) -> DataFrame:
    return R.read_edits(_edit_requests(spark, d))[1].withColumn("op_index", F.coalesce("op_index", F.lit(-1)))


def _edit_requests(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""CASE WHEN event_id % 4 = 3 THEN '[]' ELSE concat('[{"type": "rename_placeholder", "old_name": "a", "new_name": "',
      event_type, '"}, {"type": "add_placeholder", "field_name": "b", "block_index": ', event_id % 5 - 1,
      '}, {"type": "delete_text_range", "block_index": 1, "start_offset": 0, "end_offset": ', event_id % 7, '}]') END""")
    return X.table(spark, d, "events").select(F.col("event_id").alias("template_id"), raw.alias("operations"))


@query("resolve_artifact", """
  SELECT o_orderkey AS file_id, purpose, CASE
      WHEN purpose = 'download' THEN CASE WHEN t THEN 'template' WHEN r THEN 'result' END
      ELSE CASE WHEN r THEN 'result' WHEN t THEN 'template' END END AS store
  FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS t, o_orderkey % 3 = 0 AS r FROM orders) CROSS JOIN (VALUES ('download'), ('preview')) AS p(purpose)""")
def resolve_artifact(spark: SparkSession, d: str) -> DataFrame:
    ids = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"))
    path = F.concat(F.lit("f/"), F.col("file_id").cast("string"))
    templates, results = ids.where("file_id % 2 = 0").withColumn("path", path), ids.where("file_id % 3 = 0").withColumn("path", path)
    both = [
        R.resolve_artifact(ids, templates, results, purpose).select("file_id", F.lit(purpose).alias("purpose"), "store")
        for purpose in ("download", "preview")
    ]
    return both[0].unionByName(both[1])


# --- fill conversations, batch form ---------------------------------------------
@query("latest_value", duck("""
  SELECT draft_id, field_name, value FROM (
    SELECT *, row_number() OVER (PARTITION BY draft_id, field_name ORDER BY ts DESC, seq DESC) AS rn FROM draft_messages
    WHERE is_explicit OR (trim(value) <> '' AND is_open)) WHERE rn = 1""", "draft_messages"))
def latest_value(spark: SparkSession, d: str) -> DataFrame:
    return D.latest_values(X.draft_messages(spark, d), X.drafts(spark, d))


@query("message_changes", duck("""
  SELECT draft_id, seq, field_name, coalesce(old, '') AS old_value, CASE WHEN is_explicit THEN 'explicit' WHEN trim(value) = '' OR NOT is_open THEN 'ignored'
    WHEN coalesce(trim(old), '') = '' THEN 'updated' WHEN old <> value THEN 'corrected' ELSE 'same' END AS change
  FROM (SELECT *, last_value(CASE WHEN is_explicit OR (trim(value) <> '' AND is_open) THEN value END IGNORE NULLS) OVER (
      PARTITION BY draft_id, field_name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM draft_messages)
""", "draft_messages"))
def message_changes(spark: SparkSession, d: str) -> DataFrame:
    return D.message_changes(X.draft_messages(spark, d), X.drafts(spark, d)).select("draft_id", "seq", "field_name", "old_value", "change")


@query("usage_rollup", duck("""
  SELECT coalesce(template_id, -1) AS template_id, coalesce(step, 'all') AS step, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
    CAST(sum(CASE WHEN total_tokens = 0 THEN prompt_tokens + completion_tokens ELSE total_tokens END) AS BIGINT) AS total_tokens
  FROM usage_rows GROUP BY ROLLUP (template_id, step) HAVING sum(prompt_tokens + completion_tokens + total_tokens) > 0""", "usage_rows"))
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return D.usage_rollup(X.usage(spark, d)).withColumn("template_id", F.coalesce("template_id", F.lit(-1))).withColumn(
        "step", F.coalesce("step", F.lit("all"))
    )


@query("rule_extract", r"""
  SELECT event_id AS message_id, 'ho_ten' AS field_name, event_type || ' ' || user_id AS value FROM events
  UNION ALL SELECT event_id, 'so_nha', props->>'$.k' FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT event_id, 'ngay', strftime(ts, '%d') FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 'thang', strftime(ts, '%m') FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 'nam', strftime(ts, '%Y') FROM events WHERE event_id % 3 <> 0""")
def rule_extract(spark: SparkSession, d: str) -> DataFrame:
    from blankweave.operators.model import rule_extract as extract

    text = F.concat(
        F.lit("Họ tên: "), F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("; Số nhà: "), F.get_json_object("props", "$.k"))).otherwise(F.lit("")),
        F.lit("\nlạ: 7"),
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("\nhôm nay "), F.date_format("ts", "dd/MM/yyyy")))
        .when(F.col("event_id") % 3 == 2, F.concat(F.lit("\nhôm nay "), F.date_format("ts", "yyyy-MM-dd")))
        .otherwise(F.lit("")),
    )
    messages = X.table(spark, d, "events").select(F.col("event_id").alias("message_id"), text.alias("message"))
    return extract(messages, ["ho_ten", "so_nha", "ngay", "thang", "nam", "vang"])
