"""SQL fragments for the comparison engine: the derived tables, written independently in plain SQL."""

from __future__ import annotations

from blankweave import fixed_values as V
from blankweave.sources.fixtures import LETTER_COLUMNS, LETTER_ROWS

BLANK = V.BLANK_RE2
LINES = """(SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i,
             unnest(string_split(text, chr(10))) AS line FROM documents)"""
HEADING = rf"(?i)^(?:{V.HEADING_WORDS})\s+[0-9IVXLCDM]+|(?i)^[IVXLCDM]+\.\s+\S"
HEADING_NO = rf"(?i)^(?:{V.HEADING_WORDS})\s+([0-9IVXLCDM]+)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def blank(x: str) -> str:
    return rf"(NOT coalesce(regexp_matches({x}, '\S'), false))"


def normalize(x: str) -> str:
    return rf"trim(replace(replace(regexp_replace({x}, '\s+', ' ', 'g'), '…', '...'), '‥', '..'))"


def slug(x: str) -> str:
    quiet = rf"regexp_replace({x}, '(?i)\(ghi rõ.*?\)', ' ', 'g')"
    spaced = rf"regexp_replace({quiet}, '[:\-–—\._…□]', ' ', 'g')"
    ascii_ = rf"regexp_replace(strip_accents(translate({spaced}, 'đĐ', 'dD')), '[^\x00-\x7F]', '', 'g')"
    found = rf"regexp_extract_all(lower({ascii_}), '\w+|%', 0)"
    joined = f"array_to_string({found}, '_')"
    return f"nullif(regexp_replace(trim({joined}, '_'), '_+', '_', 'g'), '')"


def title(x: str) -> str:
    runs = rf"regexp_extract_all({x}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+', 0)"
    return f"array_to_string(list_transform({runs}, lambda r: CASE WHEN left(r, 1) = 'ß' THEN 'Ss' ELSE upper(left(r, 1)) END || lower(substring(r, 2))), '')"


def has_content(x: str) -> str:
    return rf"(regexp_replace({x}, '[\s._]+', '', 'g') <> '')"


def switch_of(before: str) -> str:
    label = (
        rf"coalesce((list_filter(list_transform(string_split_regex({before}, '[:\-–—\._…□■\n]'), "
        rf"lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''))[-1], '')"
    )
    return rf"""(SELECT CASE WHEN l = upper(l) AND l <> lower(l) THEN '\* Upper'
      WHEN regexp_matches(l, '[\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches(l, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}')
       AND NOT regexp_matches(l, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]') THEN '\* Caps'
      ELSE '\* MERGEFORMAT' END FROM (SELECT {label} AS l))"""


def merged(original: str, value: str, locked: str) -> str:
    """Shown value of field ``f`` (columns field_name, switch)."""
    box = f"CASE WHEN lower(trim(coalesce({value}, ''))) IN ('x','1','true','checked','v') THEN '☑' ELSE '☐' END"
    chosen = (
        f"CASE WHEN {locked} THEN {original} WHEN field_name LIKE 'ck\\_%' ESCAPE '\\' THEN {box} "
        f"ELSE coalesce({value}, '') END"
    )
    return rf"""(SELECT CASE WHEN trim(c) = '' AND NOT (field_name LIKE 'ck\_%' ESCAPE '\') THEN {original}
      WHEN switch = '\* Upper' THEN upper(replace(c, 'ß', 'ss')) WHEN switch = '\* Caps' THEN {title('c')} ELSE c END
      FROM (SELECT {chosen} AS c))"""


CTES: dict[str, tuple[list[str], str]] = {
    "form_blocks": ([], f"""
      SELECT doc_id, CAST(i AS BIGINT) AS block_index,
        CASE WHEN i % 7 = 0 THEN 'Mục ' || CAST(i // 7 + 1 AS VARCHAR) || ' ' || line
             WHEN i % 7 = 4 THEN '.......... ' || line
             WHEN i % 7 = 5 THEN '□ ' || line || ' ■ Ngày ... tháng ... năm 20...'
             ELSE regexp_replace(line, '[a-z]{{9,}}', ': ........ ', 'g') END AS text
      FROM {LINES}"""),
    "tab_blocks": ([], rf"""
      SELECT doc_id, CAST(i AS BIGINT) AS block_index,
        CASE WHEN i % 5 = 4 THEN chr(9) || ' ' || chr(9) ELSE '' END
          || regexp_replace(line, ' [a-zA-Z]{{1,2}} ', chr(9) || chr(9), 'g') AS text,
        CASE i % 4 WHEN 0 THEN ['dot', 'none', 'underscore'] WHEN 1 THEN ['heavy', 'middleDot', 'dot', 'hyphen']
                   WHEN 2 THEN ['none', 'dot'] ELSE CAST([] AS VARCHAR[]) END AS tab_leaders
      FROM {LINES}"""),
    "letters": ([], f"SELECT * FROM (VALUES {LETTER_ROWS}) AS t({LETTER_COLUMNS})"),
    "records": ([], "SELECT o_orderkey AS record_id, o_orderkey % 3 AS template_id FROM orders"),
    "merge_values": ([], """
      SELECT o_orderkey AS record_id, f.field_name,
        CASE f.field_name WHEN 'ho_ten' THEN c_name WHEN 'phan_khuc' THEN lower(c_mktsegment)
          WHEN 'ngay' THEN strftime(o_orderdate, '%d') WHEN 'thang' THEN strftime(o_orderdate, '%m')
          WHEN 'nam' THEN strftime(o_orderdate, '%Y')
          ELSE CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE '' END END AS value
      FROM orders JOIN customer ON o_custkey = c_custkey
      CROSS JOIN (VALUES ('ho_ten'), ('phan_khuc'), ('ngay'), ('thang'), ('nam'), ('ck_gap')) AS f(field_name)"""),
    "locks": (["records"], "SELECT record_id, 'nam' AS field_name FROM records WHERE record_id % 10 = 0"),
    "draft_messages": ([], """
      SELECT user_id AS draft_id, event_id AS seq, ts, event_type AS field_name,
        CASE WHEN event_id % 5 = 0 THEN '' ELSE 'v' || (props->>'$.k') END AS value,
        event_id % 10 = 5 AS is_explicit,
        -- extracted values count only for unlocked fields of the draft
        NOT (user_id % 10 = 0 AND event_type = 'view') AND NOT (user_id % 7 = 3 AND event_type = 'signup') AS is_open FROM events"""),
    "table_cells": ([], """
      SELECT table_id, "row", CAST(col AS BIGINT) AS col,
        CASE col WHEN 0 THEN CAST(l_linenumber AS VARCHAR) WHEN 1 THEN l_returnflag
          ELSE CASE WHEN "row" % 2 = 0 THEN ' .. ' ELSE l_linestatus END END AS text
      FROM (SELECT l_orderkey AS table_id, l_linenumber, l_returnflag, l_linestatus,
              row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS "row" FROM lineitem)
      CROSS JOIN (VALUES (0), (1), (2)) AS c(col)"""),
    "requirements": ([], "SELECT DISTINCT l_orderkey AS table_id, l_orderkey % 9 AS required FROM lineitem"),
    "form_blocks_new": (["form_blocks"], """
      SELECT doc_id, block_index, CASE WHEN block_index % 5 = 0 THEN text || ' sửa'
        WHEN block_index % 5 = 1 THEN text || ' ' ELSE text END AS text
      FROM form_blocks WHERE block_index % 11 <> 10"""),
    "model_outputs": ([], """
      SELECT event_id AS prompt_id, CASE WHEN event_id % 7 = 0 THEN '```json' || chr(10) || 'nothing' || chr(10) || '```'
        ELSE 'text ' || props || ' end' END AS raw FROM events"""),
    "usage_rows": ([], """
      SELECT user_id AS template_id, event_type AS step, event_id % 100 AS prompt_tokens,
        event_id % 37 AS completion_tokens, CAST(0 AS BIGINT) AS total_tokens FROM events"""),
    "cut": (["form_blocks"], f"""
      SELECT doc_id, block_index, text AS block_text, string_split_regex(text, '{BLANK}') AS pieces,
        regexp_extract_all(text, '{BLANK}', 0) AS blanks FROM form_blocks"""),
    "segs": (["cut"], """
      SELECT doc_id, block_index, CAST(row_number() OVER b - 1 AS BIGINT) AS seg_index, kind, text, before, after,
        block_text, CAST(coalesce(sum(length(text)) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS BIGINT) AS start_pos
      FROM (SELECT doc_id, block_index, block_text, 2 * i AS raw_no, 'text' AS kind, pieces[i + 1] AS text,
              NULL AS before, NULL AS after FROM cut, unnest(range(len(pieces))) AS u(i)
            UNION ALL
            SELECT doc_id, block_index, block_text, 2 * i + 1, 'field', blanks[i + 1], pieces[i + 1], pieces[i + 2]
            FROM cut, unnest(range(len(blanks))) AS u(i))
      WHERE text <> '' OR (kind = 'text' AND block_text = '') WINDOW b AS (PARTITION BY doc_id, block_index ORDER BY raw_no)"""),
    "named": (["segs"], """
      SELECT *, CASE WHEN kind = 'field' THEN base || CASE WHEN nth = 1 THEN '' ELSE '_' || nth END END AS field_name
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, base ORDER BY block_index, seg_index) AS nth
        FROM (SELECT *, CASE WHEN text IN ('□', '■') THEN 'ck_field' ELSE 'field' END AS base FROM segs))"""),
    "tseg": (["named"], f"""
      SELECT doc_id, block_index, seg_index, kind, shown AS text, field_name,
        CASE WHEN kind = 'field' THEN {switch_of('left(block_text, start_pos)')} END AS switch,
        CASE WHEN kind = 'field' THEN text END AS original_text,
        CAST(new_start AS BIGINT) AS start_pos, CAST(new_start + length(shown) AS BIGINT) AS end_pos
      FROM (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY doc_id, block_index ORDER BY seg_index
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start
            FROM (SELECT *, CASE WHEN kind = 'field' THEN '«' || field_name || '»' ELSE text END AS shown FROM named))"""),
    # Converted blocks: the text a template shows, fields as «name».
    "tblocks": (["tseg", "form_blocks"], """
      SELECT f.doc_id, f.block_index, coalesce(t.text, '') AS text FROM form_blocks f LEFT JOIN (
        SELECT doc_id, block_index, string_agg(text, '' ORDER BY seg_index) AS text FROM tseg GROUP BY ALL) t
      USING (doc_id, block_index)"""),
    "tfields": (["tseg"], """
      SELECT doc_id, block_index, seg_index, field_name, switch, original_text FROM tseg WHERE kind = 'field'"""),
    "headed": (["form_blocks"], f"""
      SELECT doc_id, block_index, text, coalesce(h.t, '') AS nearest_heading, h.idx AS section_start_index, h.no AS heading_number
      FROM (SELECT *, last_value(CASE WHEN regexp_matches({strip('text')}, '{HEADING}')
               THEN {{'t': {strip('text')}, 'idx': block_index,
                     'no': nullif(lower(regexp_extract({strip('text')}, '{HEADING_NO}', 1)), '')}} END IGNORE NULLS)
               OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS h FROM form_blocks)"""),
    # Template blocks with section and neighbours, for the context builders.
    "tctx": (["tblocks"], f"""
      SELECT doc_id, block_index, text, coalesce(heading, '') AS nearest_heading,
        lag(text, 1) OVER d AS b1, lag(text, 2) OVER d AS b2,
        lead(text, 1) OVER d AS a1, lead(text, 2) OVER d AS a2, heading_number
      FROM (SELECT *,
          last_value(CASE WHEN regexp_matches({strip('text')}, '{HEADING}') THEN {strip('text')} END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS heading,
          last_value(CASE WHEN regexp_matches({strip('text')}, '{HEADING}')
            THEN lower(regexp_extract({strip('text')}, '{HEADING_NO}', 1)) END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING) AS heading_number FROM tblocks)
      WINDOW d AS (PARTITION BY doc_id ORDER BY block_index)"""),
}


def duck(body: str, *names: str, **extra: str) -> str:
    """``body`` behind a WITH list of the named fragments, their needs first; ``extra`` adds own CTEs."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done:
            return
        parents, sql = CTES[name]
        for parent in parents:
            need(parent)
        done[name] = sql

    for name in names:
        need(name)
    if set(done) & set(extra):
        raise ValueError(f"names used twice: {set(done) & set(extra)}")
    done.update(extra)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n" + body
