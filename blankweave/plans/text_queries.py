"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.functions import naming as N
from blankweave.functions import text as T
from blankweave.operators import fields as FL
from blankweave.operators import suggest
from blankweave.plans.duck import BLANK, HEADING, HEADING_NO, blank, duck, normalize, slug, strip, switch_of, title
from blankweave.plans.registry import query
from blankweave.sources import fixtures as X
from blankweave.sources import readers as R

@query("detect_blanks", duck(f"""
  SELECT doc_id, block_index, CAST(i AS BIGINT) AS blank_index, blanks[i + 1] AS blank
  FROM cut, unnest(range(len(blanks))) AS u(i)""", "cut"))
def detect_blanks(spark: SparkSession, d: str) -> DataFrame:
    return X.form_lines(spark, d).select(
        "doc_id", "block_index", F.posexplode(T.detect_blanks(F.col("text"))).alias("blank_index", "blank")
    ).withColumn("blank_index", F.col("blank_index").cast("bigint"))


# A tab is a blank only where its stop draws a leader and the line shows something.
_TABS = dict(
    tabs=r"""SELECT doc_id, block_index, text, tab_leaders, pos, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY pos) AS nth
      FROM (SELECT doc_id, block_index, text, tab_leaders, unnest(range(1, length(text) + 1)) AS pos FROM tab_blocks WHERE contains(text, chr(9)))
      WHERE substring(text, pos, 1) = chr(9)""",
    tab_runs=r"""SELECT doc_id, block_index, min(pos) - 1 AS start_pos, max(pos) AS end_pos
      FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, block_index ORDER BY pos) AS island FROM tabs
            WHERE tab_leaders[nth] IN ('dot', 'middleDot', 'heavy', 'underscore') AND regexp_matches(text, '\S'))
      GROUP BY doc_id, block_index, island""",
)


@query("has_blank", duck(f"""
  SELECT doc_id, block_index, regexp_matches(text, '{BLANK}') OR EXISTS (
    SELECT 1 FROM tab_runs r WHERE r.doc_id = t.doc_id AND r.block_index = t.block_index) AS has_blank
  FROM tab_blocks t""", "tab_blocks", **_TABS))
def has_blank(spark: SparkSession, d: str) -> DataFrame:
    return X.tab_blocks(spark, d).select(
        "doc_id", "block_index", T.has_blank(F.col("text"), F.col("tab_leaders")).alias("has_blank")
    )


@query("strip_blanks", duck(
    f"SELECT doc_id, block_index, regexp_replace(text, '{BLANK}', ' ', 'g') AS stripped FROM form_blocks", "form_blocks"))
def strip_blanks(spark: SparkSession, d: str) -> DataFrame:
    return X.form_lines(spark, d).select("doc_id", "block_index", T.strip_blanks(F.col("text")).alias("stripped"))


@query("leader_tab_spans", duck(
    "SELECT doc_id, block_index, start_pos, end_pos FROM tab_runs", "tab_blocks", **_TABS))
def leader_tab_spans(spark: SparkSession, d: str) -> DataFrame:
    return FL.leader_tab_spans(X.tab_blocks(spark, d))


@query("segmentize", duck("""
  SELECT doc_id, block_index, seg_index, kind, text, start_pos, start_pos + length(text) AS end_pos FROM segs""", "segs"))
def segmentize(spark: SparkSession, d: str) -> DataFrame:
    return FL.segmentize(X.form_blocks(spark, d))


@query("infer_switch", duck(f"""
  SELECT doc_id, block_index, seg_index, {switch_of('left(block_text, start_pos)')} AS switch
  FROM segs WHERE kind = 'field'""", "segs"))
def infer_switch(spark: SparkSession, d: str) -> DataFrame:
    return FL.cut_at_blanks(X.form_lines(spark, d)).where("kind = 'field'").select(
        "doc_id", "block_index", "seg_index", "switch"
    )


@query("checkbox_prefix", duck("""
  SELECT doc_id, block_index, seg_index, CASE WHEN text = '□' OR text = '■' THEN 'ck_' ELSE '' END AS prefix
  FROM segs WHERE kind = 'field'""", "segs"))
def checkbox_prefix(spark: SparkSession, d: str) -> DataFrame:
    return FL.cut_at_blanks(X.form_lines(spark, d)).where("kind = 'field'").select(
        "doc_id", "block_index", "seg_index", T.checkbox_prefix(F.col("text")).alias("prefix")
    )


@query("format_instr", duck(r"""
  SELECT doc_id, block_index, seg_index,
    concat(' MERGEFIELD ', field_name, ' ', switch, ' \z "', replace(original_text, '"', '\"'), '" ') AS instr
  FROM tfields""", "tfields"))
def format_instr(spark: SparkSession, d: str) -> DataFrame:
    fields = FL.fields_of(FL.convert_blocks(X.form_blocks(spark, d)))
    return fields.select("doc_id", "block_index", "seg_index", "instr")


@query("parse_instr", duck(
    "SELECT doc_id, block_index, seg_index, field_name AS name, original_text AS original, switch FROM tfields", "tfields"))
def parse_instr(spark: SparkSession, d: str) -> DataFrame:
    instr = F.col("instr")
    return FL.fields_of(FL.convert_blocks(X.form_blocks(spark, d))).select(
        "doc_id", "block_index", "seg_index", T.instr_name(instr).alias("name"),
        T.instr_original(instr).alias("original"), T.instr_switch(instr).alias("switch"),
    )


@query("fields_in_text", duck("""
  SELECT doc_id, block_index, field_name FROM (
    SELECT doc_id, block_index, trim(unnest(regexp_extract_all(text, '«([^»]+)»', 1))) AS field_name FROM tblocks)
  GROUP BY ALL""", "tblocks"))
def fields_in_text(spark: SparkSession, d: str) -> DataFrame:
    return FL.fields_in_blocks(_template_blocks(spark, d))


def _template_blocks(spark: SparkSession, d: str) -> DataFrame:
    from blankweave.operators.context import shown_blocks

    return shown_blocks(FL.convert_blocks(X.form_blocks(spark, d)))


@query("slugify", duck(f"SELECT doc_id, block_index, {slug('text')} AS slug FROM form_blocks", "form_blocks"))
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return X.form_lines(spark, d).select("doc_id", "block_index", N.slugify(F.col("text")).alias("slug"))


@query("base_field_name", duck(rf"""
  SELECT doc_id, block_index, coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_replace(
    {strip(r"lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'))")}, '\s+', '_', 'g'),
    '(_lưu|_ghi_chú|_note)$', ''), '_'), '_+', '_', 'g'), ''), 'field') AS base
  FROM form_blocks""", "form_blocks"))
def base_field_name(spark: SparkSession, d: str) -> DataFrame:
    return X.form_lines(spark, d).select("doc_id", "block_index", N.base_field_name(F.col("text")).alias("base"))


_QUIET = r"regexp_replace(before, '(?i)\((?:nếu có|ghi rõ)[^)]*\)', ' ', 'g')"
_RULES = dict(
    lines=f"""SELECT s.*, {_QUIET} AS q, h.nearest_heading,
        regexp_matches(h.text, '{BLANK}') AND {blank(f"regexp_replace(h.text, '{BLANK}', ' ', 'g')")} AS only_blanks
      FROM segs s JOIN headed h USING (doc_id, block_index) WHERE kind = 'field'""",
    words=r"""SELECT *, lower(regexp_extract(q, '(?i)(ngày|tháng|năm)\s*(?:20)?\s*$', 1)) AS dw,
        string_split(q, ':') AS colons, string_split(q, '-') AS dashes FROM lines""",
    based=f"""SELECT *, coalesce(CASE dw WHEN 'ngày' THEN 'ngay' WHEN 'tháng' THEN 'thang' WHEN 'năm' THEN 'nam' END,
        {slug(r"(CASE WHEN len(colons) > 1 AND regexp_matches(colons[-2], '\S') THEN colons[-2] WHEN len(dashes) > 1 AND regexp_matches(dashes[-2], '\S') THEN dashes[-2] ELSE q END)")},
        CASE WHEN only_blanks THEN {slug('nearest_heading')} END, 'field') AS base FROM words""",
)


@query("rule_label", duck("""
  SELECT doc_id, block_index, seg_index, base, base || CASE WHEN nth = 1 THEN '' ELSE '_' || nth END AS field_name
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY block_index, seg_index) AS nth FROM based)
""", "segs", "headed", **_RULES))
def rule_label(spark: SparkSession, d: str) -> DataFrame:
    return FL.rule_labels(X.form_blocks(spark, d))


@query("normalize_text", duck(f"SELECT doc_id, block_index, {normalize('text')} AS normal FROM tab_blocks", "tab_blocks"))
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return X.tab_blocks(spark, d).select("doc_id", "block_index", T.normalize_text(F.col("text")).alias("normal"))


@query("normalize_without_fields", duck(f"""
  SELECT doc_id, block_index, trim(regexp_replace({normalize('text')}, '«[^»]+»', '', 'g')) AS normal
  FROM tblocks""", "tblocks"))
def normalize_without_fields(spark: SparkSession, d: str) -> DataFrame:
    return _template_blocks(spark, d).select("doc_id", "block_index", T.normalize_without_fields(F.col("text")).alias("normal"))


_STYLED = """CASE block_index % 6 WHEN 1 THEN 'Heading 2' WHEN 2 THEN 'Normal' END"""


@query("is_heading", duck(f"""
  SELECT doc_id, block_index, regexp_matches({strip('text')}, '{HEADING}')
    OR (coalesce(lower({_STYLED}) LIKE '%heading%', false) AND regexp_matches(text, '\\S')) AS is_heading
  FROM form_blocks""", "form_blocks"))
def is_heading(spark: SparkSession, d: str) -> DataFrame:
    blocks = X.form_lines(spark, d).withColumn("style", F.expr(_STYLED))
    return blocks.select("doc_id", "block_index", T.is_heading(F.col("text"), F.col("style")).alias("is_heading"))


@query("heading_number", duck(f"""
  SELECT doc_id, block_index, lower(regexp_extract({strip('text')}, '{HEADING_NO}', 1)) AS number
  FROM form_blocks WHERE regexp_matches({strip('text')}, '{HEADING_NO}')""", "form_blocks"))
def heading_number(spark: SparkSession, d: str) -> DataFrame:
    return X.form_lines(spark, d).select(
        "doc_id", "block_index", T.heading_number(F.col("text")).alias("number")
    ).where("number IS NOT NULL")


@query("requested_numbers", rf"""
  SELECT DISTINCT event_id AS request_id, lower(unnest(regexp_extract_all(
    'xem mục ' || (event_id % 12) || ', Điều ' || (event_id % 5) || ' và mục ' || (props->>'$.k'),
    '(?i)(?:{V.HEADING_WORDS})\s+([0-9IVXLCDM]+)', 1))) AS number FROM events""")
def requested_numbers(spark: SparkSession, d: str) -> DataFrame:
    request = F.concat(
        F.lit("xem mục "), (F.col("event_id") % 12).cast("string"), F.lit(", Điều "),
        (F.col("event_id") % 5).cast("string"), F.lit(" và mục "), F.get_json_object("props", "$.k"),
    )
    return X.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.explode(T.requested_numbers(request)).alias("number")
    )


_DATE_LINES = """
  SELECT doc_id, block_index, concat('Tại «', f1, '», ngày «', f2, '» tháng «', f3, '» năm «', f4, '»') AS text
  FROM (SELECT doc_id, block_index, min(field_name) FILTER (seg_index % 4 = 1) AS f1,
      min(field_name) FILTER (seg_index % 4 = 3) AS f2, max(field_name) AS f3,
      CASE WHEN block_index % 3 = 0 THEN 'nam_lam_don' ELSE 'la_' || min(field_name) END AS f4
    FROM tfields GROUP BY doc_id, block_index) WHERE f1 IS NOT NULL AND f2 IS NOT NULL"""


@query("date_line_renames", duck(r"""
  SELECT doc_id, old_name, new_name FROM (
    SELECT doc_id, old_name, new_name, row_number() OVER (PARTITION BY doc_id, old_name ORDER BY block_index DESC, slot DESC) AS rn
    FROM (SELECT doc_id, block_index, 0 AS slot, g[1] AS old_name, 'dia_diem_lam_don' AS new_name FROM groups
      UNION ALL SELECT doc_id, block_index, 1, g[2], 'ngay_lam_don' FROM groups
      UNION ALL SELECT doc_id, block_index, 2, g[3], 'thang_lam_don' FROM groups
      UNION ALL SELECT doc_id, block_index, 3, g[4], 'nam_lam_don' FROM groups) WHERE old_name <> new_name)
  WHERE rn = 1 AND (doc_id, old_name) IN (SELECT doc_id, field_name FROM tfields)""", "tfields",
    date_lines=_DATE_LINES,
    groups="SELECT doc_id, block_index, regexp_extract_all(text, '«([^»]+)»', 1) AS g FROM date_lines"))
def date_line_renames(spark: SparkSession, d: str) -> DataFrame:
    fields = FL.fields_of(FL.convert_blocks(X.form_blocks(spark, d)))
    lines = fields.groupBy("doc_id", "block_index").agg(
        F.min(F.when(F.col("seg_index") % 4 == 1, F.col("field_name"))).alias("f1"),
        F.min(F.when(F.col("seg_index") % 4 == 3, F.col("field_name"))).alias("f2"),
        F.max("field_name").alias("f3"),
        F.min("field_name").alias("low"),
    ).where("f1 IS NOT NULL AND f2 IS NOT NULL")
    f4 = F.when(F.col("block_index") % 3 == 0, F.lit("nam_lam_don")).otherwise(F.concat(F.lit("la_"), F.col("low")))
    text = F.concat(
        F.lit("Tại «"), F.col("f1"), F.lit("», ngày «"), F.col("f2"), F.lit("» tháng «"), F.col("f3"),
        F.lit("» năm «"), f4, F.lit("»"),
    )
    return FL.date_line_renames(lines.select("doc_id", "block_index", text.alias("text")), fields)


@query("extract_json", duck(r"""
  SELECT prompt_id, CAST(len(json_keys(body)) AS BIGINT) AS n_keys, json_extract_string(body, '$.k') AS k
  FROM (SELECT prompt_id, coalesce(nullif(regexp_extract(raw, '(?s)\{.*\}'), ''), '{}') AS body FROM model_outputs)
""", "model_outputs"))
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    return X.model_outputs(spark, d).withColumn("j", T.extract_json(F.col("raw"))).select(
        "prompt_id", F.size("j").cast("bigint").alias("n_keys"), F.try_element_at("j", F.lit("k")).alias("k")
    )


@query("snake_keys", """
  SELECT event_id, CASE key WHEN 'fontSize' THEN 'font_size' WHEN 'allCaps' THEN 'all_caps'
    WHEN 'lineSpacing' THEN 'line_spacing' WHEN 'spaceBefore' THEN 'space_before' ELSE key END AS key, value
  FROM (SELECT event_id, 'fontSize' AS key, props->>'$.k' AS value FROM events
    UNION ALL SELECT event_id, 'allCaps', event_type FROM events
    UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'lineSpacing' WHEN 1 THEN 'spaceBefore' ELSE 'bold' END,
      CAST(user_id AS VARCHAR) FROM events)""")
def snake_keys(spark: SparkSession, d: str) -> DataFrame:
    third = F.when(F.col("event_id") % 3 == 0, F.lit("lineSpacing")).when(
        F.col("event_id") % 3 == 1, F.lit("spaceBefore")
    ).otherwise(F.lit("bold"))
    options = F.create_map(
        F.lit("fontSize"), F.get_json_object("props", "$.k"), F.lit("allCaps"), F.col("event_type"),
        third, F.col("user_id").cast("string"),
    )
    return X.table(spark, d, "events").select("event_id", F.explode(T.snake_keys(options)).alias("key", "value"))


@query("strip_suffix", duck(
    r"SELECT doc_id, block_index, seg_index, regexp_replace(field_name, '_\d+$', '') AS base FROM tfields", "tfields"))
def strip_suffix(spark: SparkSession, d: str) -> DataFrame:
    return FL.convert_blocks(X.form_blocks(spark, d)).where("kind = 'field'").select(
        "doc_id", "block_index", "seg_index", N.strip_suffix(F.col("field_name")).alias("base")
    )


@query("bump_suffix", duck(r"""
  SELECT doc_id, block_index, seg_index, regexp_replace(field_name, '_\d+$', '') || '_' || CASE
    WHEN regexp_matches(field_name, '_\d+$') THEN CAST(regexp_extract(field_name, '_(\d+)$', 1) AS BIGINT) + k + 1
    ELSE k + 2 END AS bumped
  FROM (SELECT *, block_index % 4 AS k FROM tfields)""", "tfields"))
def bump_suffix(spark: SparkSession, d: str) -> DataFrame:
    return FL.convert_blocks(X.form_blocks(spark, d)).where("kind = 'field'").select(
        "doc_id", "block_index", "seg_index",
        N.bump_suffix(F.col("field_name"), F.col("block_index") % 4).alias("bumped"),
    )


@query("has_content", duck(r"""
  SELECT doc_id, block_index, regexp_replace(text, '[\s._]+', '', 'g') <> '' AS has_content FROM form_blocks""", "form_blocks"))
def has_content(spark: SparkSession, d: str) -> DataFrame:
    return X.form_lines(spark, d).select("doc_id", "block_index", T.has_content(F.col("text")).alias("has_content"))


@query("is_cell_empty", duck(r"""
  SELECT table_id, "row", col, NOT regexp_matches(text, '[\p{L}\p{N}]') AS is_empty FROM table_cells""", "table_cells"))
def is_cell_empty(spark: SparkSession, d: str) -> DataFrame:
    return X.table_cells(spark, d).select("table_id", "row", "col", T.is_cell_empty(F.col("text")).alias("is_empty"))


@query("checkbox_value", duck("""
  SELECT record_id, field_name, CASE WHEN value IN ('x') OR (length(value) = 1 AND contains('1v', value))
    THEN '☑' ELSE '☐' END AS box FROM merge_values""", "merge_values"))
def checkbox_value(spark: SparkSession, d: str) -> DataFrame:
    return X.merge_values(spark, d).select("record_id", "field_name", T.checkbox_value(F.col("value")).alias("box"))


@query("apply_switch", duck(rf"""
  SELECT doc_id, block_index, CASE block_index % 3 WHEN 0 THEN upper(replace(text, 'ß', 'ss')) WHEN 1 THEN {title('text')} ELSE text END AS value
  FROM form_blocks""", "form_blocks"))
def apply_switch(spark: SparkSession, d: str) -> DataFrame:
    switch = F.when(F.col("block_index") % 3 == 0, F.lit(V.SWITCH_UPPER)).when(
        F.col("block_index") % 3 == 1, F.lit(V.SWITCH_CAPS)
    ).otherwise(F.lit(V.SWITCH_KEEP))
    return X.form_lines(spark, d).select("doc_id", "block_index", T.apply_switch(F.col("text"), switch).alias("value"))


@query("url_ok", """
  SELECT page_id, starts_with(u, 'http://') OR starts_with(u, 'https://') OR starts_with(u, 'mailto:') AS url_ok
  FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'mailto:' || url
    WHEN 2 THEN replace(url, 'http', 'ftp') ELSE '' END AS u FROM pages)""")
def url_ok(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    link = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("mailto:"), F.col("url"))).when(
        k == 2, F.replace("url", F.lit("http"), F.lit("ftp"))
    ).otherwise(F.lit(""))
    return X.table(spark, d, "pages").select("page_id", T.url_ok(link).alias("url_ok"))


@query("split_at_offset", duck(f"""
  SELECT doc_id, block_index, left(text, p) AS before, CASE WHEN {blank('substring(text, p + 1)')} THEN NULL
    ELSE substring(text, p + 1) END AS after
  FROM (SELECT *, CASE WHEN text = '' THEN 0 ELSE block_index % 17 END AS p FROM form_blocks)""", "form_blocks"))
def split_at_offset(spark: SparkSession, d: str) -> DataFrame:
    cut = T.split_at_offset(F.col("text"), F.col("block_index") % 17)
    return X.form_lines(spark, d).withColumn("cut", cut).select("doc_id", "block_index", "cut.before", "cut.after")


_CUES = """concat(regexp_replace(text, '[._□■]', ''), CASE block_index % 9 WHEN 0 THEN ' họ và tên ' WHEN 1 THEN ' ngày   tháng '
  WHEN 2 THEN ' Địa chỉ' WHEN 3 THEN ' mã số ' WHEN 4 THEN '   [ ]' WHEN 5 THEN ' __ ' WHEN 6 THEN ' a   b' WHEN 7 THEN ' «x» ngày tháng' ELSE '' END)"""


@query("rule_suggestions", duck(f"""
  SELECT doc_id, block_index, CASE WHEN box THEN 'checkbox' WHEN dated THEN 'date' WHEN counted THEN 'number' ELSE 'text' END AS field_type,
    CASE WHEN box THEN 'box' WHEN dated THEN 'date words' WHEN counted THEN 'number label' WHEN person THEN 'name label' WHEN place THEN 'address label' WHEN dots THEN 'dots' ELSE 'gap' END AS cue
  FROM found WHERE box OR dated OR counted OR person OR place OR dots OR gap""", "form_blocks",
  cues=f"SELECT doc_id, block_index, {_CUES.replace("'[._□■]', ''", "'[._□■]', '', 'g'")} AS text FROM form_blocks",
  # What a reader would look for, in words of its own: the words in lower case, bounded by what is no letter.
  found=r"""SELECT doc_id, block_index, strpos(text, '[ ]') > 0 OR strpos(text, '□') > 0 AS box,
      regexp_matches(t, 'ngày\s') AND regexp_matches(regexp_extract(t, 'ngày\s(.*)$', 1), 'tháng') OR regexp_matches(t, 'tháng\s') AND regexp_matches(regexp_extract(t, 'tháng\s(.*)$', 1), 'năm') AS dated,
      list_contains(['số', 'mã', 'cmnd', 'cccd', 'id'], regexp_extract(regexp_replace(t, '\s*:?\s*$', ''), '([\pL]*)$', 1)) OR regexp_matches(' ' || t, '[^\pL](mã số|số điện thoại)') AS counted,
      strpos(t, 'tôi tên') + strpos(t, 'họ và tên') + strpos(t, 'họ tên') + strpos(t, 'người ký') > 0 AS person,
      strpos(t, 'địa chỉ') + strpos(t, 'đơn vị') + strpos(t, 'công ty') > 0 AS place, strpos(text, '__') + strpos(text, '...') > 0 AS dots,
      regexp_matches(text, '[^\s.,:;!?]  +[^\s]') AS gap
    FROM (SELECT *, lower(text) AS t FROM cues WHERE NOT (strpos(text, '«') > 0 AND strpos(substring(text, strpos(text, '«') + 2), '»') > 0))"""))
def rule_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return suggest.rule_suggestions(X.form_lines(spark, d).withColumn("text", F.expr(_CUES)))


# Files as a folder scan gives them, derived from documents: names, lengths and the properties of a saved file.
_FILES = """doc_id, concat('s3a://forms/', doc_id, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.DOCX' ELSE '.docx' END) AS path, octet_length({text}) AS length,
  concat('<Properties><', CASE doc_id % 3 WHEN 0 THEN 'Pages>' ELSE 'ap:Pages>' END, CASE doc_id % 7 WHEN 3 THEN 'many' WHEN 4 THEN '99999999999' ELSE concat(' ', doc_id % 50) END,
    CASE doc_id % 3 WHEN 0 THEN '</Pages>' ELSE '</ap:Pages>' END, '</Properties>') AS app_xml"""


@query("scan_templates", duck(f"""
  SELECT path, length, CASE WHEN right(path, 5) <> '.docx' THEN 'not a .docx file' WHEN length > 4000 THEN 'file is too large' END AS reason
  FROM (SELECT {_FILES.format(text="encode(coalesce(text, ''))")} FROM documents)"""))
def scan_templates(spark: SparkSession, d: str) -> DataFrame:
    files = X.table(spark, d, "documents").selectExpr(*_split(_FILES.format(text="coalesce(text, '')"))).select(
        "path", F.col("length").cast("bigint").alias("length"), F.lit(b"").alias("content")
    )
    good, bad = R.scan_templates(files, max_bytes=4000)
    return good.select("path", "length", F.lit(None).cast("string").alias("reason")).unionByName(bad)


@query("page_count", duck(f"""
  SELECT path, TRY_CAST(nullif(regexp_extract(app_xml, 'Pages>[ ]*([0-9]+)<', 1), '') AS INTEGER) AS page_count FROM (SELECT {_FILES.format(text="encode(coalesce(text, ''))")} FROM documents)"""))
def page_count(spark: SparkSession, d: str) -> DataFrame:
    files = X.table(spark, d, "documents").selectExpr(*_split(_FILES.format(text="coalesce(text, '')")))
    return files.select("path", R.page_count(F.col("app_xml")).alias("page_count"))


def _split(columns: str) -> list[str]:
    """The four expressions of ``_FILES``, each with its name."""
    first, path, rest = columns.split(", ", 1)[0], *columns.split(", ", 1)[1].split(" AS path, ")
    length, xml = rest.split(" AS length,\n")
    return [first, f"{path} AS path", f"{length} AS length", xml]


@query("usage_value", duck("""
  SELECT prompt_id, coalesce(TRY_CAST(k AS BIGINT), TRY_CAST(mod_text AS BIGINT), 0) AS prompt_tokens,
    coalesce(TRY_CAST(mod_text AS BIGINT), 0) AS completion_tokens,
    coalesce(nullif(TRY_CAST(k AS BIGINT), 0), 0) + coalesce(TRY_CAST(mod_text AS BIGINT), 0)
      + CASE WHEN k IS NULL THEN coalesce(TRY_CAST(mod_text AS BIGINT), 0) ELSE 0 END AS total_tokens
  FROM (SELECT prompt_id, json_extract_string(nullif(regexp_extract(raw, '(?s)\\{.*\\}'), ''), '$.k') AS k,
    CASE WHEN prompt_id % 3 = 0 THEN 'none' ELSE CAST(prompt_id % 11 AS VARCHAR) END AS mod_text FROM model_outputs)
""", "model_outputs"))
def usage_value(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_element_at(T.extract_json(F.col("raw")), F.lit("k"))
    other = F.when(F.col("prompt_id") % 3 == 0, F.lit("none")).otherwise((F.col("prompt_id") % 11).cast("string"))
    return X.model_outputs(spark, d).select(
        "prompt_id", T.usage_value(k, other).alias("prompt_tokens"), T.usage_value(other).alias("completion_tokens")
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


_KIND_LINES = """
  SELECT doc_id, block_index, concat(text, CASE block_index % 3 WHEN 0 THEN ' số: ' ELSE ' loại ' END, '......',
    CASE block_index % 2 WHEN 0 THEN ' (Giấy tờ tùy thân)' ELSE ' (khác)' END, ' mã: ......') AS text FROM form_blocks"""


@query("type_or_value_prefix", duck(rf"""
  SELECT doc_id, block_index, CAST(i AS BIGINT) AS blank_index, CASE
    WHEN NOT regexp_matches(pieces[i + 1], '(?i)(số|mã|mã số|ngày cấp|nơi cấp|giá trị)\s*:\s*$')
     AND regexp_matches(pieces[i + 2], '(?i)^\s*\([^)]*(tài liệu|giấy tờ|pháp lý|chứng từ|text|type)[^)]*\)') THEN 'loai_'
    ELSE '' END AS prefix
  FROM (SELECT doc_id, block_index, string_split_regex(text, '{BLANK}') AS pieces FROM kind_lines),
    unnest(range(len(pieces) - 1)) AS u(i)""", "form_blocks", kind_lines=_KIND_LINES))
def type_or_value_prefix(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("""concat(text, CASE block_index % 3 WHEN 0 THEN ' số: ' ELSE ' loại ' END, '......',
      CASE block_index % 2 WHEN 0 THEN ' (Giấy tờ tùy thân)' ELSE ' (khác)' END, ' mã: ......')""")
    lines = X.form_lines(spark, d).withColumn("text", text)
    cut = FL.cut_at_blanks(lines).where("kind = 'field'")
    nth = F.row_number().over(FL.in_block()) - 1
    return cut.select(
        "doc_id", "block_index", nth.cast("bigint").alias("blank_index"),
        N.kind_prefix(F.col("before"), F.col("after")).alias("prefix"),
    )
