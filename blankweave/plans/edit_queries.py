"""Queries over bulk edits, differences and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.operators import context as C
from blankweave.operators import diff
from blankweave.operators import fields as FL
from blankweave.operators import spans as S
from blankweave.operators import structure as ST
from blankweave.plans.duck import blank, duck
from blankweave.plans.registry import query
from blankweave.sources import fixtures as X


def segments(spark: SparkSession, d: str) -> DataFrame:
    return FL.convert_blocks(X.form_blocks(spark, d))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id")


# A settled result, numbered and measured again: pieces (doc_id, block_index, ord, kind, text, field_name, switch, original_text).
_SETTLED = """
  SELECT doc_id, block_index, CAST(row_number() OVER b - 1 AS BIGINT) AS seg_index, kind, text, field_name, switch, original_text,
    CAST(coalesce(sum(length(text)) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos
  FROM (SELECT *, count(*) FILTER (text <> '') OVER (PARTITION BY doc_id, block_index) AS spoken,
      row_number() OVER (PARTITION BY doc_id, block_index ORDER BY ord) AS rk FROM pieces)
  WHERE text <> '' OR (spoken = 0 AND rk = 1) WINDOW b AS (PARTITION BY doc_id, block_index ORDER BY ord)"""
_OUT = "SELECT doc_id, block_index, seg_index, kind, text, field_name, switch, original_text, start_pos, start_pos + length(text) AS end_pos FROM settled"


@query("overlap_segments", duck("""
  SELECT doc_id, block_index, seg_index, greatest(start_pos, 2) AS overlap_start, least(end_pos, 12) AS overlap_end
  FROM tseg WHERE end_pos > 2 AND start_pos < 12""", "tseg"))
def overlap_segments(spark: SparkSession, d: str) -> DataFrame:
    segs = segments(spark, d)
    ranges = segs.select("doc_id", "block_index").distinct().select(
        "doc_id", "block_index", F.lit(2).cast("bigint").alias("start_offset"), F.lit(12).cast("bigint").alias("end_offset")
    )
    return S.overlap_segments(segs, ranges).select("doc_id", "block_index", "seg_index", "overlap_start", "overlap_end")


# Two renames per document, some of one field, some to one new name.
_RENAMES = """SELECT doc_id, 0 AS op_index, CASE doc_id % 4 WHEN 0 THEN 'field' WHEN 1 THEN 'field_2' WHEN 2 THEN 'ck_field_999' ELSE 'mat' END AS old_name,
    CASE doc_id % 5 WHEN 0 THEN 'field_3' ELSE 'ten_moi' END AS new_name, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 7 = 1 THEN 0 END AS nth FROM documents
  UNION ALL SELECT doc_id, 1, 'field', CASE WHEN doc_id % 6 = 0 THEN 'ten_moi' ELSE 'ten_hai' END, CASE WHEN doc_id % 2 = 0 THEN 0 END FROM documents"""


def _renames(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    first = documents.selectExpr(
        "doc_id", "0L AS op_index",
        "CASE doc_id % 4 WHEN 0 THEN 'field' WHEN 1 THEN 'field_2' WHEN 2 THEN 'ck_field_999' ELSE 'mat' END AS old_name",
        "CASE doc_id % 5 WHEN 0 THEN 'field_3' ELSE 'ten_moi' END AS new_name",
        "CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 7 = 1 THEN 0 END AS occurrence_index",
    )
    return first.unionByName(documents.selectExpr(
        "doc_id", "1L AS op_index", "'field' AS old_name", "CASE WHEN doc_id % 6 = 0 THEN 'ten_moi' ELSE 'ten_hai' END AS new_name",
        "CASE WHEN doc_id % 2 = 0 THEN 0 END AS occurrence_index",
    ))


_RENAME_SQL = dict(
    renames=_RENAMES,
    names="SELECT doc_id, field_name, count(*) AS uses FROM tfields GROUP BY ALL",
    matched=r"""SELECT r.*, coalesce(e.field_name, b.field_name) AS matched, coalesce(e.uses, b.uses) AS uses, u.field_name IS NOT NULL AND new_name <> old_name AS taken
      FROM renames r LEFT JOIN names e ON r.doc_id = e.doc_id AND r.old_name = e.field_name
      LEFT JOIN names b ON r.doc_id = b.doc_id AND regexp_replace(r.old_name, '_\d+$', '') = b.field_name
      LEFT JOIN names u ON r.doc_id = u.doc_id AND r.new_name = u.field_name""",
    alone="""SELECT *, CASE WHEN matched IS NULL THEN 'unknown field' WHEN taken THEN 'name in use' WHEN nth >= uses THEN 'no such occurrence' END AS e1 FROM matched""",
    named_once="""SELECT a.*, coalesce(e1, CASE WHEN EXISTS (SELECT 1 FROM alone b WHERE b.doc_id = a.doc_id AND b.new_name = a.new_name AND b.op_index < a.op_index AND b.e1 IS NULL)
        THEN 'name in use' END) AS e2 FROM alone a""",
    judged="""SELECT a.*, coalesce(e2, CASE WHEN EXISTS (SELECT 1 FROM named_once b WHERE b.doc_id = a.doc_id AND b.matched = a.matched AND b.op_index < a.op_index AND b.e2 IS NULL
        AND (b.nth IS NULL OR b.nth = a.nth)) THEN 'renamed before' END) AS error FROM named_once a""",
    hits="""SELECT s.*, (SELECT arg_min(m.new_name, m.op_index) FROM judged m WHERE s.kind = 'field' AND s.doc_id = m.doc_id AND s.field_name = m.matched
        AND m.error IS NULL AND coalesce(m.nth, s.occ) = s.occ) AS nn
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, field_name ORDER BY block_index, seg_index) - 1 AS occ FROM tseg) s""",
    pieces=r"""SELECT doc_id, block_index, seg_index AS ord, kind, CASE WHEN nn IS NULL THEN text ELSE '«' || nn || '»' END AS text,
        coalesce(nn, field_name) AS field_name, CASE WHEN nn IS NULL THEN switch ELSE '\* MERGEFORMAT' END AS switch, original_text FROM hits""",
    settled=_SETTLED,
)


@query("rename_field", duck(_OUT, "tseg", "tfields", **_RENAME_SQL))
def rename_field(spark: SparkSession, d: str) -> DataFrame:
    return S.rename_field(segments(spark, d), _renames(spark, d))[0]


@query("rename_field_status", duck("""
  SELECT doc_id, CAST(op_index AS BIGINT) AS op_index, old_name, new_name, matched, CASE WHEN error IS NULL THEN 'executed' ELSE 'failed' END AS status, error
  FROM judged""", "tseg", "tfields", **_RENAME_SQL))
def rename_field_status(spark: SparkSession, d: str) -> DataFrame:
    return S.rename_field(segments(spark, d), _renames(spark, d))[1]


@query("delete_field", duck(_OUT, "tseg", "tfields",
    gone=r"""SELECT DISTINCT w.doc_id, coalesce(e.field_name, b.field_name) AS field_name
      FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'field_2' WHEN 1 THEN 'field_77777' ELSE 'mat' END AS w FROM documents) w
      LEFT JOIN (SELECT DISTINCT doc_id, field_name FROM tfields) e ON w.doc_id = e.doc_id AND w.w = e.field_name
      LEFT JOIN (SELECT DISTINCT doc_id, field_name FROM tfields) b ON w.doc_id = b.doc_id AND regexp_replace(w.w, '_\d+$', '') = b.field_name""",
    pieces="""SELECT doc_id, block_index, seg_index AS ord, CASE WHEN g THEN 'text' ELSE kind END AS kind, CASE WHEN g THEN '' ELSE text END AS text,
        CASE WHEN NOT g THEN field_name END AS field_name, CASE WHEN NOT g THEN switch END AS switch, CASE WHEN NOT g THEN original_text END AS original_text
      FROM (SELECT t.*, g.doc_id IS NOT NULL AS g FROM tseg t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.field_name = g.field_name)""",
    settled=_SETTLED))
def delete_field(spark: SparkSession, d: str) -> DataFrame:
    deletes = _documents(spark, d).select(
        "doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'field_2' WHEN 1 THEN 'field_77777' ELSE 'mat' END").alias("field_name")
    )
    return S.delete_field(segments(spark, d), deletes)[0]


_ADDS = """SELECT doc_id, 0 AS op_index, doc_id % 6 AS block_index, CASE WHEN doc_id % 11 = 0 THEN 'field' ELSE 'moi' END AS nn,
    CASE doc_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'new_line' END AS position FROM documents
  UNION ALL SELECT doc_id, 1, doc_id % 6, CASE WHEN doc_id % 5 = 0 THEN 'moi' ELSE 'moi_hai' END, CASE WHEN doc_id % 2 = 0 THEN 'left' ELSE 'right' END FROM documents
  UNION ALL SELECT doc_id, 2, block_index, 'moi_' || block_index, CASE WHEN block_index % 2 = 0 THEN 'new_line' ELSE 'right' END FROM form_blocks WHERE block_index % 3 = 1"""
_ADD_SQL = dict(
    adds=_ADDS,
    free="""SELECT a.*, row_number() OVER (PARTITION BY doc_id, nn ORDER BY op_index) AS same FROM adds a JOIN (SELECT DISTINCT doc_id, block_index FROM tseg) USING (doc_id, block_index)
      WHERE NOT EXISTS (SELECT 1 FROM tfields f WHERE f.doc_id = a.doc_id AND f.field_name = a.nn)""",
    good="""SELECT *, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY op_index) AS nth FROM free WHERE same = 1""",
    lasts="""SELECT t.doc_id, t.block_index, max(seg_index) FILTER (kind = 'text' AND text <> '') AS last_text FROM tseg t
      JOIN (SELECT DISTINCT doc_id, block_index FROM good) USING (doc_id, block_index) GROUP BY ALL""",
    tails=r"""SELECT t.doc_id, t.block_index, t.seg_index, regexp_extract(text, '^(.*?)((?:\s*[._](?:\s*[._])+\s*)|[□■]+)$', 1) AS head,
        regexp_extract(text, '^(.*?)((?:\s*[._](?:\s*[._])+\s*)|[□■]+)$', 2) AS tail
      FROM tseg t JOIN lasts l ON t.doc_id = l.doc_id AND t.block_index = l.block_index AND t.seg_index = l.last_text""",
    rows_in="""SELECT t.doc_id, t.block_index, 0 AS sub, t.seg_index AS ord0, kind, CASE WHEN tail <> '' THEN head ELSE text END AS text, field_name, switch, original_text
      FROM tseg t LEFT JOIN tails USING (doc_id, block_index, seg_index)
      UNION ALL SELECT g.doc_id, g.block_index, CASE WHEN position = 'new_line' THEN nth ELSE 0 END, CASE WHEN position = 'left' THEN -1000000 ELSE 1000000 END + nth,
        'field', '«' || nn || '»', nn, '\\* MERGEFORMAT', CASE WHEN nth = 1 THEN coalesce(tail, '') ELSE '' END FROM good g LEFT JOIN tails USING (doc_id, block_index)""".replace("\\\\", "\\"),
    pieces="""SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block_index, sub) - 1 AS block_index, ord0 AS ord, kind, text, field_name, switch, original_text FROM rows_in""",
    settled=_SETTLED,
)


@query("add_field", duck(_OUT, "tseg", "tfields", **_ADD_SQL))
def add_field(spark: SparkSession, d: str) -> DataFrame:
    documents, blocks = _documents(spark, d), X.form_blocks(spark, d)
    adds = documents.selectExpr(
        "doc_id", "0L AS op_index", "doc_id % 6 AS block_index", "CASE WHEN doc_id % 11 = 0 THEN 'field' ELSE 'moi' END AS field_name",
        "CASE doc_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'new_line' END AS position",
    ).unionByName(documents.selectExpr(
        "doc_id", "1L AS op_index", "doc_id % 6 AS block_index", "CASE WHEN doc_id % 5 = 0 THEN 'moi' ELSE 'moi_hai' END AS field_name",
        "CASE WHEN doc_id % 2 = 0 THEN 'left' ELSE 'right' END AS position",
    )).unionByName(blocks.where("block_index % 3 = 1").selectExpr(
        "doc_id", "2L AS op_index", "block_index", "concat('moi_', block_index) AS field_name",
        "CASE WHEN block_index % 2 = 0 THEN 'new_line' ELSE 'right' END AS position",
    ))
    return S.add_field(segments(spark, d), adds)[0]


_AT_SQL = dict(
    adds="""SELECT doc_id, 0 AS op_index, doc_id % 5 AS block_index, CASE WHEN doc_id % 13 = 0 THEN 'field' ELSE 'moi' END AS nn,
        CASE WHEN doc_id % 2 = 0 THEN doc_id % 37 END AS off, CASE WHEN doc_id % 2 = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'e ' WHEN 1 THEN 'n' ELSE 'zzqq' END END AS ia FROM documents
      UNION ALL SELECT doc_id, 1, block_index, CASE WHEN block_index = 0 THEN 'moi' ELSE 'them_' || block_index END, doc_id % 23, NULL FROM form_blocks
      UNION ALL SELECT doc_id, 2, block_index, 'nua_' || block_index, doc_id % 29, NULL FROM form_blocks WHERE block_index % 2 = 0""",
    lens="""SELECT doc_id, block_index, max(end_pos) AS len FROM tseg GROUP BY ALL""",
    free="""SELECT a.*, len, row_number() OVER (PARTITION BY doc_id, nn ORDER BY op_index) AS same FROM adds a JOIN lens USING (doc_id, block_index)
      WHERE NOT EXISTS (SELECT 1 FROM tfields f WHERE f.doc_id = a.doc_id AND f.field_name = a.nn)""",
    points="""SELECT a.*, CASE WHEN ia IS NULL THEN off ELSE CASE WHEN strpos(b.text, ia) > 0 THEN strpos(b.text, ia) - 1 + length(ia) END END AS p
      FROM free a JOIN tblocks b USING (doc_id, block_index) WHERE same = 1""",
    targets="""SELECT t.doc_id, t.block_index, nn, any_value(op_index) AS op_index, min(seg_index) AS seg_index, any_value(p) AS p FROM tseg t JOIN points USING (doc_id, block_index)
      WHERE kind = 'text' AND ((p >= start_pos AND p <= end_pos) OR len = 0) AND p IS NOT NULL GROUP BY t.doc_id, t.block_index, nn""",
    placed="""SELECT g.*, p - start_pos AS local, text, lag(p - start_pos, 1, 0) OVER w AS before, row_number() OVER w AS n, count(*) OVER (PARTITION BY g.doc_id, g.block_index, g.seg_index) AS total
      FROM targets g JOIN tseg t USING (doc_id, block_index, seg_index) WINDOW w AS (PARTITION BY g.doc_id, g.block_index, g.seg_index ORDER BY p, op_index)""",
    pieces=r"""SELECT doc_id, block_index, seg_index * 1000 AS ord, kind, text, field_name, switch, original_text FROM tseg t WHERE NOT EXISTS (
        SELECT 1 FROM placed g WHERE g.doc_id = t.doc_id AND g.block_index = t.block_index AND g.seg_index = t.seg_index)
      UNION ALL SELECT doc_id, block_index, seg_index * 1000 + 2 * n - 1, 'text', substring(text, before + 1, local - before), NULL, NULL, NULL FROM placed
      UNION ALL SELECT doc_id, block_index, seg_index * 1000 + 2 * n, 'field', '«' || nn || '»', nn, '\* MERGEFORMAT', '' FROM placed
      UNION ALL SELECT doc_id, block_index, seg_index * 1000 + 2 * n + 1, 'text', substring(text, local + 1), NULL, NULL, NULL FROM placed WHERE n = total""",
    settled=_SETTLED,
)


def _adds_at(spark: SparkSession, d: str) -> DataFrame:
    first = _documents(spark, d).selectExpr(
        "doc_id", "0L AS op_index", "doc_id % 5 AS block_index", "CASE WHEN doc_id % 13 = 0 THEN 'field' ELSE 'moi' END AS field_name",
        "CASE WHEN doc_id % 2 = 0 THEN doc_id % 37 END AS offset",
        "CASE WHEN doc_id % 2 = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'e ' WHEN 1 THEN 'n' ELSE 'zzqq' END END AS insert_after",
    )
    blocks = X.form_blocks(spark, d)
    second = blocks.selectExpr(
        "doc_id", "1L AS op_index", "block_index", "CASE WHEN block_index = 0 THEN 'moi' ELSE concat('them_', block_index) END AS field_name",
        "doc_id % 23 AS offset", "cast(NULL AS string) AS insert_after",
    )
    third = blocks.where("block_index % 2 = 0").selectExpr(
        "doc_id", "2L AS op_index", "block_index", "concat('nua_', block_index) AS field_name", "doc_id % 29 AS offset", "cast(NULL AS string) AS insert_after"
    )
    return first.unionByName(second).unionByName(third)


@query("add_field_at", duck(_OUT, "tseg", "tfields", "tblocks", **_AT_SQL))
def add_field_at(spark: SparkSession, d: str) -> DataFrame:
    return S.add_field_at(segments(spark, d), _adds_at(spark, d))[0]


# Three edits per document and more: six kinds of update of its second block, a second edit of that block, and one word of
# every fifth block. The first two see the texts that the edits before them left.
_UPDATE_CASES = """CASE doc_id % 6 WHEN 0 THEN substring(t2, 3, 10) WHEN 1 THEN replace(substring(t2, 3, 12), ' ', '   ')
  WHEN 2 THEN substring(t3, 2, 15) WHEN 3 THEN 'không hề có' WHEN 4 THEN ' ' ELSE concat(substring(t2, 3, 4), '«la»', substring(t2, 7, 5)) END"""
_UPDATE_NEW = """CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('MỚI «them» ', doc_id % 3) END"""
_LAST_WORD, _FIRST_WORD = "regexp_extract(t2, '([A-Za-z]{4,})[^A-Za-z]*$', 1)", "regexp_extract(text, '[A-Za-z]{3,}', 0)"
_UPDATE_EDITS = dict(
    pair="SELECT doc_id, max(text) FILTER (block_index = 1) AS t2, coalesce(max(text) FILTER (block_index = 2), 'x y z') AS t3 FROM tblocks GROUP BY doc_id",
    edits=f"""SELECT doc_id, 0 AS op_index, 1 AS block_index, {_UPDATE_CASES} AS old_text, {_UPDATE_NEW} AS new_text FROM pair WHERE t2 IS NOT NULL
      UNION ALL SELECT doc_id, 1, 1, {_LAST_WORD}, 'hai «hai» x' FROM pair WHERE t2 IS NOT NULL
      UNION ALL SELECT doc_id, 2, block_index, {_FIRST_WORD}, 'NHIỀU' FROM tblocks WHERE block_index % 5 = 3 AND {_FIRST_WORD} <> ''""",
)


def _update_step(number: int, texts: str) -> dict[str, str]:
    """The edits with one op_index applied to ``texts(doc_id, block_index, text)``."""
    k = str(number)
    return {
        "looked" + k: f"""SELECT e.doc_id, e.op_index, e.block_index AS asked, b.block_index, b.text, e.new_text, b.block_index - e.block_index AS ahead, regexp_matches(b.text, '«[^»]+»') AS m,
          trim(regexp_replace(old_text, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(regexp_replace(old_text, '\\s+', ' ', 'g'), '«[^»]+»', '', 'g')) AS bare
        FROM edits e JOIN {texts} b ON e.doc_id = b.doc_id AND b.block_index >= e.block_index WHERE e.op_index = {k}""",
        "cases" + k: f"""SELECT *, CASE WHEN s = '' AND ahead = 0 THEN 0 WHEN s = '' THEN NULL WHEN strpos(text, s) > 0 THEN 1 + ahead
          WHEN ahead = 0 AND bare <> '' AND strpos(text, bare) > 0 THEN 1000000 WHEN ahead = 0 AND NOT m THEN 2000000 END AS rank FROM looked{k}""",
        "best" + k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, asked ORDER BY rank) AS rn FROM cases{k} WHERE rank IS NOT NULL) WHERE rn = 1",
        "spans" + k: f"""SELECT *, CASE WHEN rank < 1000000 THEN strpos(text, s) ELSE strpos(text, bare) END - 1 AS a,
          length(text) - strpos(reverse(text), '«') AS lm, length(text) - strpos(reverse(text), '»') + 1 AS lc FROM best{k}""",
        "updated" + k: rf"""SELECT doc_id, op_index, asked, block_index, CASE WHEN rank = 0 THEN CASE WHEN new_text = '' THEN array_to_string(regexp_extract_all(text, '«[^»]+»', 0), '')
            WHEN regexp_matches(text, '^((?:«[^»]+»)*)[^«]+') THEN regexp_extract(text, '^((?:«[^»]+»)*)[^«]+', 1) || new_text || regexp_replace(text, '^((?:«[^»]+»)*)[^«]+', '')
            ELSE text || new_text END
          WHEN rank <= 1000000 THEN left(text, CASE WHEN regexp_matches(left(text, a), '«[^»]*$') THEN a - length(regexp_extract(left(text, a), '«[^«»]*$')) ELSE a END)
            || new_text || substring(text, 1 + CASE WHEN regexp_matches(left(text, z), '«[^»]*$') THEN z + length(regexp_extract(substring(text, z + 1), '^[^«»]*»')) ELSE z END)
          ELSE new_text END AS text, CASE WHEN rank = 0 THEN 'set' WHEN rank < 1000000 THEN 'exact' WHEN rank = 1000000 THEN 'without fields' ELSE 'rewrite' END AS how
        FROM (SELECT *, CASE WHEN rank < 1000000 THEN a + length(s) WHEN m AND lm >= a THEN greatest(a + length(bare), lc) ELSE a + length(bare) END AS z FROM spans{k})""",
        "texts" + k: f"SELECT b.doc_id, b.block_index, coalesce(u.text, b.text) AS text FROM {texts} b LEFT JOIN updated{k} u USING (doc_id, block_index)",
    }


_UPDATE_SQL = dict(**_UPDATE_EDITS, **_update_step(0, "tblocks"), **_update_step(1, "texts0"), **_update_step(2, "texts1"))


def _updates(shown: DataFrame) -> DataFrame:
    """The edits of all documents from one pass over their blocks."""
    block = lambda n: F.get(F.filter("blocks", lambda b: b["block_index"] == n), 0)["text"]
    documents = shown.groupBy("doc_id").agg(F.collect_list(F.struct("block_index", "text")).alias("blocks")).select(
        "doc_id", "blocks", block(1).alias("t2"), F.coalesce(block(2), F.lit("x y z")).alias("t3")
    )
    edit = "named_struct('op_index', {}, 'block_index', {}, 'old_text', {}, 'new_text', {})"
    words = edit.format("2L", "b.block_index", _FIRST_WORD.replace("text", "b.text"), "'NHIỀU'")
    own = f"array({edit.format('0L', '1L', _UPDATE_CASES, _UPDATE_NEW)}, {edit.format('1L', '1L', _LAST_WORD, repr('hai «hai» x'))})"
    many = f"transform(filter(blocks, b -> b.block_index % 5 = 3 AND {_FIRST_WORD.replace('text', 'b.text')} <> ''), b -> {words})"
    return documents.select("doc_id", F.explode(F.expr(f"concat(CASE WHEN t2 IS NOT NULL THEN {own} ELSE array() END, {many})")).alias("e")).select("doc_id", "e.*")


@query("update_text", duck("SELECT doc_id, block_index, text FROM texts2", "tblocks", **_UPDATE_SQL))
def update_text(spark: SparkSession, d: str) -> DataFrame:
    segs = segments(spark, d)
    return C.shown_blocks(ST.update_text(segs, _updates(C.shown_blocks(segs)))[0])


@query("update_text_status", duck("""
  SELECT e.doc_id, e.block_index, CAST(e.op_index AS BIGINT) AS op_index, coalesce(u.how, 'failed') AS how, coalesce(u.block_index, -1) AS target_block
  FROM edits e LEFT JOIN (SELECT * FROM updated0 UNION ALL SELECT * FROM updated1 UNION ALL SELECT * FROM updated2) u
    ON u.doc_id = e.doc_id AND u.op_index = e.op_index AND u.asked = e.block_index""", "tblocks", **_UPDATE_SQL))
def update_text_status(spark: SparkSession, d: str) -> DataFrame:
    segs = segments(spark, d)
    return ST.update_text(segs, _updates(C.shown_blocks(segs)))[1].withColumn(
        "target_block", F.coalesce("target_block", F.lit(-1))
    )


_RANGES_SQL = dict(
    ranges="""SELECT doc_id, block_index, doc_id % 9 AS a, doc_id % 9 + block_index % 7 AS z FROM (SELECT DISTINCT doc_id, block_index FROM tseg)
      UNION ALL SELECT doc_id, block_index, 15, 20 FROM (SELECT DISTINCT doc_id, block_index FROM tseg)""",
    # Character by character: independent of how the ranges are merged.
    touched="""SELECT t.*, EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = t.doc_id AND r.block_index = t.block_index AND r.z > r.a AND t.end_pos > r.a AND t.start_pos < r.z) AS hit FROM tseg t""",
    chars="""SELECT doc_id, block_index, seg_index, i, substring(text, i + 1, 1) AS ch, start_pos + i AS p FROM (SELECT *, unnest(range(length(text))) AS i FROM touched WHERE hit AND kind = 'text')""",
    left_over="""SELECT doc_id, block_index, seg_index, string_agg(ch, '' ORDER BY i) AS t FROM chars c WHERE NOT EXISTS (SELECT 1 FROM ranges r
        WHERE r.doc_id = c.doc_id AND r.block_index = c.block_index AND r.z > r.a AND c.p >= r.a AND c.p < r.z) GROUP BY ALL""",
    pieces="""SELECT doc_id, block_index, seg_index AS ord, CASE WHEN hit THEN 'text' ELSE kind END AS kind,
        CASE WHEN NOT hit THEN text WHEN kind = 'field' THEN '' ELSE coalesce(t, '') END AS text,
        CASE WHEN NOT hit THEN field_name END AS field_name, CASE WHEN NOT hit THEN switch END AS switch, CASE WHEN NOT hit THEN original_text END AS original_text
      FROM touched LEFT JOIN left_over USING (doc_id, block_index, seg_index)""",
    settled=_SETTLED,
)


def _ranges(segs: DataFrame) -> DataFrame:
    blocks = segs.select("doc_id", "block_index").distinct()
    first = blocks.selectExpr(
        "doc_id", "block_index", "doc_id % 9 AS start_offset", "doc_id % 9 + block_index % 7 AS end_offset"
    )
    second = blocks.selectExpr(
        "doc_id", "block_index", "cast(15 AS bigint) AS start_offset", "cast(20 AS bigint) AS end_offset"
    )
    return first.unionByName(second)


@query("delete_range", duck(_OUT, "tseg", **_RANGES_SQL))
def delete_range(spark: SparkSession, d: str) -> DataFrame:
    segs = segments(spark, d)
    return S.delete_ranges(segs, _ranges(segs))[0]


@query("delete_range_status", duck("""
  SELECT doc_id, block_index, a AS start_offset, z AS end_offset, CASE WHEN z > a AND a < len THEN 'executed' ELSE 'failed' END AS status
  FROM ranges JOIN (SELECT doc_id, block_index, max(end_pos) AS len FROM tseg GROUP BY ALL) USING (doc_id, block_index)""", "tseg", **_RANGES_SQL))
def delete_range_status(spark: SparkSession, d: str) -> DataFrame:
    segs = segments(spark, d)
    return S.delete_ranges(segs, _ranges(segs))[1]


@query("delete_blocks", duck("""
  SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block_index) - 1 AS block_index, seg_index, kind, text
  FROM settled WHERE block_index % 4 <> 1""", "tseg", **_RANGES_SQL))
def delete_blocks(spark: SparkSession, d: str) -> DataFrame:
    segs = segments(spark, d)
    none = F.lit(None).cast("bigint")
    whole = segs.where("block_index % 4 = 1").select("doc_id", "block_index").distinct()
    missing = whole.withColumn("block_index", F.col("block_index") + 100000)
    whole = whole.unionByName(missing).withColumn("start_offset", none).withColumn("end_offset", none)
    return S.delete_blocks(segs, whole.unionByName(_ranges(segs))).select("doc_id", "block_index", "seg_index", "kind", "text")


@query("add_block", duck(f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, sub, add_id) - 1 AS block_index, text FROM (
    SELECT doc_id, block_index, 0 AS sub, 0 AS add_id, CASE WHEN k = 1 AND o <= length(text) THEN left(text, o)
      WHEN k = 2 THEN text || chr(10) || 'thêm' || chr(10) || 'đầu' ELSE text END AS text FROM k_blocks
    UNION ALL SELECT doc_id, block_index, 1, 0, p FROM (SELECT *, CASE WHEN o + 5 <= length(text) THEN substring(text, o + 1, 5) ELSE substring(text, o + 1) END AS p FROM k_blocks)
      WHERE k = 1 AND o <= length(text) AND NOT {blank('p')}
    UNION ALL SELECT doc_id, block_index, 2, 0, substring(text, o + 6) FROM k_blocks WHERE k = 1 AND o + 5 <= length(text) AND NOT {blank('substring(text, o + 6)')}
    UNION ALL SELECT doc_id, block_index, -1, 0, 'trước' FROM k_blocks WHERE k = 3
    UNION ALL SELECT doc_id, block_index, -1, 1, 'trước' FROM k_blocks WHERE k = 3
    UNION ALL SELECT doc_id, block_index, 3, 0, 'sau' FROM k_blocks WHERE k = 4
    UNION ALL SELECT doc_id, block_index, 3, 1, 'sau nữa' FROM k_blocks WHERE k = 4
    UNION ALL SELECT doc_id, 99999999, 0, 0, 'cuối' FROM documents)""", "form_blocks",
    k_blocks="SELECT *, block_index % 9 AS k, doc_id % 20 AS o FROM form_blocks"))
def add_block(spark: SparkSession, d: str) -> DataFrame:
    blocks = X.form_blocks(spark, d)
    k = "block_index % 9"
    inner = blocks.where(f"{k} BETWEEN 1 AND 4").selectExpr(
        "doc_id", "block_index AS add_id", "block_index", f"CASE {k} WHEN 3 THEN 'before' ELSE 'after' END AS position",
        f"CASE {k} WHEN 3 THEN 'trước' WHEN 4 THEN 'sau' ELSE 'thêm' END AS text",
        f"CASE WHEN {k} = 1 THEN doc_id % 20 END AS offset", f"CASE WHEN {k} = 2 THEN cast(5 AS bigint) END AS para_in_cell",
    )
    again = inner.withColumn("add_id", F.col("add_id") + 1_000_000).withColumn("offset", F.col("offset") + 5).withColumn(
        "para_in_cell", F.col("para_in_cell") - 5
    ).withColumn("text", F.expr(f"CASE {k} WHEN 2 THEN 'đầu' WHEN 4 THEN 'sau nữa' ELSE text END"))
    ends = _documents(spark, d).selectExpr(
        "doc_id", "cast(0 AS bigint) AS add_id", "cast(NULL AS bigint) AS block_index", "'end' AS position", "'cuối' AS text",
        "cast(NULL AS bigint) AS offset", "cast(NULL AS bigint) AS para_in_cell",
    )
    return ST.add_block(blocks, inner.unionByName(again).unionByName(ends))


_STRUCTURE_SQL = dict(
    typed="SELECT *, CASE WHEN block_index % 6 = 2 THEN 'table_cell' ELSE 'paragraph' END AS type FROM form_blocks",
    inserts="""SELECT doc_id, 0 AS op_index, block_index, type, text, doc_id % 25 AS off, CASE block_index % 3 WHEN 0 THEN 'page_break' WHEN 1 THEN 'image' ELSE 'table' END AS what,
        doc_id % 4 AS r, block_index % 3 + 1 AS c FROM typed
      UNION ALL SELECT doc_id, 1, block_index, type, text, doc_id % 25 + CASE WHEN block_index % 2 = 0 THEN 4 ELSE 0 END, 'page_break', NULL, NULL FROM typed""",
    judged="""SELECT *, CASE WHEN what = 'page_break' AND type <> 'paragraph' THEN 'page breaks need a paragraph' WHEN length(text) > 0 AND off > length(text) THEN 'offset not found'
        WHEN what = 'table' AND r < 1 THEN 'table size' WHEN what = 'image' AND doc_id % 10 < 1 THEN 'image width' END AS error FROM inserts""",
    good="SELECT *, CASE WHEN text = '' THEN 0 ELSE off END AS o FROM judged WHERE error IS NULL",
    cut_lists="SELECT doc_id, block_index, list_sort(list(DISTINCT o)) AS cuts FROM good GROUP BY ALL",
    cut_blocks="SELECT t.*, coalesce(cuts, []) AS cuts, unnest(range(len(coalesce(cuts, [])) + 1)) AS i FROM typed t LEFT JOIN cut_lists USING (doc_id, block_index)",
    cut_pieces="""SELECT *, CASE WHEN i = len(cuts) THEN substring(text, CASE WHEN i = 0 THEN 0 ELSE cuts[i] END + 1)
        ELSE substring(text, CASE WHEN i = 0 THEN 0 ELSE cuts[i] END + 1, cuts[i + 1] - CASE WHEN i = 0 THEN 0 ELSE cuts[i] END) END AS piece FROM cut_blocks""",
    between_pieces="SELECT g.*, 2 * list_position(cuts, o) - 1 AS sub FROM good g JOIN cut_lists USING (doc_id, block_index)",
)


def _inserts(typed: DataFrame) -> DataFrame:
    first = typed.selectExpr(
        "doc_id", "0L AS op_index", "block_index", "doc_id % 25 AS offset",
        "CASE block_index % 3 WHEN 0 THEN 'page_break' WHEN 1 THEN 'image' ELSE 'table' END AS what",
        "doc_id % 4 AS rows", "block_index % 3 + 1 AS cols", "concat('anh/', doc_id, '.png') AS image_path",
        "cast(doc_id % 10 AS double) AS width",
    )
    return first.unionByName(typed.selectExpr(
        "doc_id", "1L AS op_index", "block_index", "doc_id % 25 + CASE WHEN block_index % 2 = 0 THEN 4 ELSE 0 END AS offset", "'page_break' AS what",
        "cast(NULL AS bigint) AS rows", "cast(NULL AS bigint) AS cols", "cast(NULL AS string) AS image_path", "cast(NULL AS double) AS width",
    ))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return X.form_blocks(spark, d).withColumn("type", F.expr("CASE WHEN block_index % 6 = 2 THEN 'table_cell' ELSE 'paragraph' END"))


@query("insert_structure", duck(f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_index, sub, op_index, rr NULLS FIRST, cc NULLS FIRST) - 1 AS block_index, type, text,
    coalesce(rr, -1) AS "row", coalesce(cc, -1) AS col, image_path FROM (
    SELECT doc_id, block_index, 2 * i AS sub, 0 AS op_index, type, piece AS text, NULL AS rr, NULL AS cc, NULL AS image_path FROM cut_pieces WHERE i = 0 OR NOT {blank('piece')}
    UNION ALL SELECT doc_id, block_index, sub, op_index, what, '', NULL, NULL, CASE WHEN what = 'image' THEN 'anh/' || doc_id || '.png' END FROM between_pieces WHERE what <> 'table'
    UNION ALL SELECT doc_id, block_index, sub, op_index, 'table_cell', '', r0, unnest(range(c)), NULL FROM (SELECT *, unnest(range(r)) AS r0 FROM between_pieces WHERE what = 'table'))
""", "form_blocks", **_STRUCTURE_SQL))
def insert_structure(spark: SparkSession, d: str) -> DataFrame:
    typed = _typed(spark, d)
    return ST.insert_structure(typed, _inserts(typed))[0].select(
        "doc_id", "block_index", "type", "text", F.coalesce("row", F.lit(-1)).alias("row"),
        F.coalesce("col", F.lit(-1)).alias("col"), "image_path",
    )


@query("insert_structure_status", duck("""
  SELECT doc_id, block_index, CAST(op_index AS BIGINT) AS op_index, CASE WHEN error IS NULL THEN 'executed' ELSE 'failed' END AS status, error FROM judged""", "form_blocks", **_STRUCTURE_SQL))
def insert_structure_status(spark: SparkSession, d: str) -> DataFrame:
    typed = _typed(spark, d)
    return ST.insert_structure(typed, _inserts(typed))[1]


# --- attributes ------------------------------------------------------------------------
_ATTR_SQL = dict(
    spans="""SELECT doc_id, block_index, doc_id % 7 AS a, doc_id % 7 + 1 + block_index % 9 AS z, max(end_pos) AS len FROM tseg GROUP BY ALL""",
    greens="""SELECT doc_id, block_index, doc_id % 5 + 3 AS a, doc_id % 5 + 3 + block_index % 4 AS z, len FROM spans""",
    asked="""SELECT 0 AS op, * FROM spans WHERE z > a AND z <= len UNION ALL SELECT 1, * FROM greens WHERE z > a AND z <= len""",
    covers="""SELECT t.doc_id, t.block_index, t.seg_index, op, CASE WHEN kind = 'field' THEN 0 ELSE greatest(a - start_pos, 0) END AS lo,
        CASE WHEN kind = 'field' THEN length(text) ELSE least(z - start_pos, length(text)) END AS hi
      FROM tseg t JOIN asked USING (doc_id, block_index) WHERE end_pos > a AND start_pos < z""",
    bounds="""SELECT doc_id, block_index, seg_index, 0 AS b FROM tseg UNION SELECT doc_id, block_index, seg_index, length(text) FROM tseg
      UNION SELECT doc_id, block_index, seg_index, lo FROM covers UNION SELECT doc_id, block_index, seg_index, hi FROM covers""",
    steps="""SELECT *, coalesce(lead(b) OVER (PARTITION BY doc_id, block_index, seg_index ORDER BY b), CASE WHEN b = 0 THEN 0 END) AS e FROM bounds""",
    split_up="""SELECT s.doc_id, s.block_index, s.seg_index, b, substring(text, b + 1, e - b) AS text, s.seg_index % 2 = 0 AND NOT red AS bold, red, green FROM (
        SELECT s.*, EXISTS (SELECT 1 FROM covers c WHERE c.doc_id = s.doc_id AND c.block_index = s.block_index AND c.seg_index = s.seg_index AND op = 0 AND lo < e AND hi > b) AS red,
          EXISTS (SELECT 1 FROM covers c WHERE c.doc_id = s.doc_id AND c.block_index = s.block_index AND c.seg_index = s.seg_index AND op = 1 AND lo < e AND hi > b) AS green
        FROM steps s WHERE e IS NOT NULL) s JOIN tseg USING (doc_id, block_index, seg_index)""",
)


def _attr_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of which every second one is bold and sub- and superscript never show."""
    attrs = F.when(F.col("seg_index") % 2 == 0, F.create_map(F.lit("bold"), F.lit("true"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    return segments(spark, d).withColumn("attrs", attrs)


@query("overlay_span_attrs", duck("""
  SELECT doc_id, block_index, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY seg_index, b) - 1 AS seg_index, text,
    bold, CASE WHEN green THEN '00FF00' WHEN red THEN 'FF0000' END AS color, CASE WHEN red THEN '14' END AS font_size, green AS italic FROM split_up""", "tseg", **_ATTR_SQL))
def overlay_span_attrs(spark: SparkSession, d: str) -> DataFrame:
    segs = _attr_segments(spark, d)
    blocks = segs.select("doc_id", "block_index").distinct()
    red = blocks.selectExpr(
        "doc_id", "block_index", "0L AS op_index", "doc_id % 7 AS start_offset", "doc_id % 7 + 1 + block_index % 9 AS end_offset",
        "map('bold', 'false', 'color', '#ff0000', 'font_size', '14', 'subscript', 'true', 'superscript', 'true') AS config",
    )
    green = blocks.selectExpr(
        "doc_id", "block_index", "1L AS op_index", "doc_id % 5 + 3 AS start_offset", "doc_id % 5 + 3 + block_index % 4 AS end_offset",
        "map('italic', 'true', 'color', '#00ff00') AS config",
    )
    out, _ = S.overlay_span_attrs(segs, red.unionByName(green))
    return out.select(
        "doc_id", "block_index", "seg_index", "text",
        F.coalesce(F.try_element_at("attrs", F.lit("bold")) == "true", F.lit(False)).alias("bold"),
        F.try_element_at("attrs", F.lit("color")).alias("color"), F.try_element_at("attrs", F.lit("font_size")).alias("font_size"),
        F.coalesce(F.try_element_at("attrs", F.lit("italic")) == "true", F.lit(False)).alias("italic"),
    )


@query("effective_attrs", duck(f"""
  SELECT s.doc_id, s.block_index, a AS start_offset, z AS end_offset, CASE WHEN arg_min(seg_index, seg_index) % 2 = 0 THEN 'true' ELSE 'false' END AS bold,
    '12' AS font_size, 'Times New Roman' AS font_name, '000000' AS color FROM spans s JOIN tseg t USING (doc_id, block_index)
  WHERE t.end_pos > a AND t.start_pos < z AND NOT {blank('t.text')} GROUP BY ALL""", "tseg", **_ATTR_SQL))
def effective_attrs(spark: SparkSession, d: str) -> DataFrame:
    segs = _attr_segments(spark, d)
    spans = segs.select("doc_id", "block_index").distinct().select(
        "doc_id", "block_index", (F.col("doc_id") % 7).alias("start_offset"),
        (F.col("doc_id") % 7 + 1 + F.col("block_index") % 9).alias("end_offset"),
    )
    return S.effective_attrs(segs, spans).select(
        "doc_id", "block_index", "start_offset", "end_offset", "bold", "font_size", "font_name", "color"
    )


@query("set_block_attrs", duck("""
  SELECT doc_id, block_index, CASE WHEN doc_id % 2 = 0 THEN 'both' WHEN doc_id % 4 = 1 THEN 'justify' ELSE 'left' END AS alignment,
    CASE WHEN doc_id % 4 <> 3 THEN '6' END AS space_after, CASE WHEN doc_id % 2 = 0 THEN '1.5' END AS line_spacing FROM form_blocks""", "form_blocks"))
def set_block_attrs(spark: SparkSession, d: str) -> DataFrame:
    blocks = X.form_blocks(spark, d).withColumn("attrs", F.expr("map('alignment', 'left')"))
    formats = blocks.selectExpr(
        "doc_id", "block_index", "0L AS op_index",
        """CASE doc_id % 4 WHEN 0 THEN map('alignment', 'center', 'spaceAfter', '6') WHEN 1 THEN map('alignment', 'justify', 'spaceAfter', '6')
          WHEN 2 THEN map('spaceAfter', '6', 'keepTogether', 'true') ELSE map('alignment', 'xiên', 'spaceAfter', '6') END AS paragraph_format""",
    )
    second = blocks.where("doc_id % 2 = 0").selectExpr(
        "doc_id", "block_index", "1L AS op_index", "map('alignment', 'both', 'lineSpacing', '1.5') AS paragraph_format"
    )
    return S.set_block_attrs(blocks, formats.unionByName(second))[0].select(
        "doc_id", "block_index", *[F.try_element_at("attrs", F.lit(key)).alias(key) for key in ("alignment", "space_after", "line_spacing")]
    )


def _bordered(spark: SparkSession, d: str) -> DataFrame:
    own = F.expr("CASE WHEN (row + col) % 3 = 0 THEN map('top', named_struct('style', 'double', 'size', bigint(8), 'color', 'AA0000')) END")
    return X.table_cells(spark, d).select(
        "table_id", "row", "col", F.lit("#ffffff").alias("background"), F.lit("top").alias("v_align"), F.lit("left").alias("h_align"),
        F.coalesce(own, F.expr(f"cast(map() AS map<string,{S.BORDER}>)")).alias("borders"),
    )


@query("set_cell_attrs", duck("""
  SELECT table_id, "row", col, CASE WHEN twice THEN '00ff00' WHEN table_id % 3 = 0 THEN 'FFFF00' ELSE '#ffffff' END AS background,
    CASE WHEN twice THEN 'bottom' ELSE 'center' END AS v_align, CASE WHEN twice THEN 'both' ELSE 'left' END AS h_align,
    CASE WHEN col = 0 THEN 'none' WHEN col = 1 THEN 'single' WHEN ("row" + col) % 3 = 0 THEN 'double' ELSE 'none' END AS top_style
  FROM (SELECT *, ("row" + table_id) % 2 = 0 AS twice FROM table_cells)""", "table_cells"))
def set_cell_attrs(spark: SparkSession, d: str) -> DataFrame:
    cells = _bordered(spark, d)
    formats = cells.selectExpr(
        "table_id", "row", "col", "0L AS op_index", "CASE WHEN table_id % 3 = 0 THEN '#FFFF00' ELSE 'auto' END AS new_background",
        "'center' AS new_v_align", "'xiên' AS new_h_align",
        "CASE WHEN col < 2 THEN map('top', named_struct('style', CASE WHEN col = 0 THEN 'none' ELSE 'single' END, 'size', bigint(4), 'color', '#000000')) END AS new_borders",
    )
    second = cells.where("(row + table_id) % 2 = 0").select(
        "table_id", "row", "col", F.lit(1).cast("bigint").alias("op_index"), F.lit("#00ff00").alias("new_background"),
        F.lit("bottom").alias("new_v_align"), F.lit("both").alias("new_h_align"), F.lit(None).cast(formats.schema["new_borders"].dataType).alias("new_borders"),
    )
    return S.set_cell_attrs(cells, formats.unionByName(second)).select(
        "table_id", "row", "col", "background", "v_align", "h_align",
        F.coalesce(F.try_element_at("borders", F.lit("top"))["style"], F.lit("none")).alias("top_style"),
    )


@query("effective_borders", duck("""
  SELECT c.table_id, c."row", c.col, s.side, CASE WHEN s.side = 'top' AND (c."row" + c.col) % 3 = 0 THEN 'double' WHEN outer_edge THEN 'thick' WHEN s.side IN ('top', 'bottom') THEN 'dotted' ELSE 'none' END AS style,
    CAST(CASE WHEN s.side = 'top' AND (c."row" + c.col) % 3 = 0 THEN 8 WHEN outer_edge THEN 12 WHEN s.side IN ('top', 'bottom') THEN 4 ELSE 0 END AS BIGINT) AS size,
    CASE WHEN s.side = 'top' AND (c."row" + c.col) % 3 = 0 THEN '#AA0000' ELSE '#000000' END AS color
  FROM (SELECT *, max("row") OVER (PARTITION BY table_id) AS mr, max(col) OVER (PARTITION BY table_id) AS mc FROM table_cells) c
  CROSS JOIN (VALUES ('top'), ('bottom'), ('left'), ('right')) AS s(side)
  CROSS JOIN LATERAL (SELECT CASE s.side WHEN 'top' THEN c."row" = 0 WHEN 'bottom' THEN c."row" = mr WHEN 'left' THEN c.col = 0 ELSE c.col = mc END AS outer_edge)""", "table_cells"))
def effective_borders(spark: SparkSession, d: str) -> DataFrame:
    cells = _bordered(spark, d)
    edge = "named_struct('style', 'thick', 'size', bigint(12), 'color', '000000')"
    tables = cells.groupBy("table_id").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col")).withColumn(
        "table_borders",
        F.expr(f"""map('top', {edge}, 'bottom', {edge}, 'left', {edge}, 'right', {edge},
          'insideH', named_struct('style', 'dotted', 'size', cast(NULL AS bigint), 'color', ''), 'insideV', named_struct('style', 'nil', 'size', bigint(3), 'color', 'x'))"""),
    )
    return S.effective_borders(cells, tables)


# --- plans, suggestions, checks -----------------------------------------------------------
@query("reverse_apply_order", duck("""
  SELECT doc_id, paragraph_index, "order", row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index DESC, "order" DESC) AS apply_rank
  FROM (SELECT doc_id, block_index // 2 AS paragraph_index, block_index AS "order" FROM form_blocks)""", "form_blocks"))
def reverse_apply_order(spark: SparkSession, d: str) -> DataFrame:
    targets = X.form_blocks(spark, d).selectExpr(
        "doc_id", "block_index DIV 2 AS paragraph_index", "block_index AS order"
    )
    return ST.reverse_apply_order(targets)


@query("plan_to_edits", duck("""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY plan_order) - 1 AS op_index, 'update_text' AS type, block_index, trim(old_text) AS old_text, new_text
  FROM (SELECT doc_id, block_index AS plan_order, CASE block_index % 4 WHEN 0 THEN block_index WHEN 1 THEN block_index + 1 WHEN 2 THEN block_index + 1000 END AS target,
      CASE WHEN block_index % 5 = 4 THEN ' ' ELSE text || ' ' END AS old_text, 'x' AS new_text FROM form_blocks) p
  JOIN (SELECT doc_id AS did, block_index FROM form_blocks) b ON p.doc_id = b.did AND p.target = b.block_index WHERE trim(old_text) <> ''""", "form_blocks"))
def plan_to_edits(spark: SparkSession, d: str) -> DataFrame:
    blocks = X.form_blocks(spark, d)
    plans = blocks.selectExpr(
        "doc_id", "block_index AS plan_order",
        "CASE block_index % 4 WHEN 0 THEN string(block_index) WHEN 1 THEN string(block_index + 1) WHEN 2 THEN string(block_index + 1000) ELSE 'ba' END AS raw_index",
        "CASE WHEN block_index % 5 = 4 THEN ' ' ELSE concat(text, ' ') END AS old_text", "'x' AS new_text",
    )
    return ST.plan_to_edits(plans, blocks)


_SUGGEST_SQL = dict(
    sugg="""SELECT doc_id, doc_id % 6 AS block_index, 1 AS sid, 'moi' AS nn, 'right' AS position, NULL AS ia FROM documents
      UNION ALL SELECT doc_id, doc_id % 6 + 1, 2, 'moi_hai', 'inline', CASE WHEN doc_id % 2 = 0 THEN 'e' ELSE 'zzqq' END FROM documents
      UNION ALL SELECT doc_id, NULL, 3, 'moi_ba', 'right', NULL FROM documents UNION ALL SELECT doc_id, 0, 4, '', 'left', NULL FROM documents""",
    judged="""SELECT s.*, nn <> '' AND t.doc_id IS NOT NULL AND (position <> 'inline' OR (strpos(t.text, ia) > 0 AND EXISTS (
        SELECT 1 FROM tseg g WHERE g.doc_id = s.doc_id AND g.block_index = s.block_index AND g.kind = 'text'
          AND strpos(t.text, ia) BETWEEN g.start_pos AND g.end_pos))) AS ok
      FROM sugg s LEFT JOIN tblocks t ON s.doc_id = t.doc_id AND s.block_index = t.block_index""",
)


@query("apply_suggestions", duck("""
  SELECT doc_id, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
    coalesce(string_agg(nn, ',' ORDER BY sid) FILTER (ok), '') AS applied_fields FROM judged GROUP BY doc_id""", "tblocks", "tseg", **_SUGGEST_SQL))
def apply_suggestions(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)

    def row(block: str, sid: int, name: str, position: str, after: str) -> DataFrame:
        return docs.selectExpr(
            "doc_id", f"cast({sid} AS bigint) AS suggestion_id", f"cast({block} AS bigint) AS block_index",
            f"'{name}' AS suggested_name", f"'{position}' AS position", f"{after} AS insert_after",
        )

    none = "cast(NULL AS string)"
    rows = row("doc_id % 6", 1, "moi", "right", none).unionByName(
        row("doc_id % 6 + 1", 2, "moi_hai", "inline", "CASE WHEN doc_id % 2 = 0 THEN 'e' ELSE 'zzqq' END")
    ).unionByName(row("NULL", 3, "moi_ba", "right", none)).unionByName(row("0", 4, "", "left", none))
    return S.apply_suggestions(segments(spark, d), rows)[1].withColumn("applied_fields", F.array_join("applied_fields", ","))


_WIDE = """
  type STRING, block_index BIGINT, field_name STRING, old_name STRING, new_name STRING, start_offset BIGINT, end_offset BIGINT,
  format_config MAP<STRING,STRING>, paragraph_format MAP<STRING,STRING>, format_options MAP<STRING,STRING>, table_index BIGINT, row_index BIGINT,
  col_index BIGINT, url STRING,
  blocks ARRAY<MAP<STRING,BIGINT>>"""
_CHECK_OPS = """CASE op_index WHEN 0 THEN concat('{"type":"rename_placeholder","old_name":"field_9999","new_name":"', CASE doc_id % 3 WHEN 0 THEN 'field_2' ELSE 'a' END, '"}')
  WHEN 1 THEN concat('{"type":"delete_placeholder","field_name":"', CASE doc_id % 2 WHEN 0 THEN 'mat' ELSE 'field' END, '"}')
  WHEN 2 THEN concat('{"type":"add_placeholder","block_index":', doc_id % 4, ',"field_name":"moi"}')
  WHEN 3 THEN concat('{"type":"delete_text_range","block_index":0,"start_offset":4,"end_offset":', doc_id % 8, '}')
  WHEN 4 THEN concat('{"type":"add_hyperlink","block_index":0,"url":"', CASE doc_id % 3 WHEN 0 THEN 'http://a' WHEN 1 THEN ' ' ELSE 'ftp://a' END, '"}')
  WHEN 5 THEN concat('{"type":"delete_table_row","table_index":', doc_id % 3, '}')
  WHEN 6 THEN concat('{"type":"format_text","block_index":0,"format_config":{', CASE doc_id % 2 WHEN 0 THEN '"bold":"true"' ELSE '' END, '}}')
  WHEN 7 THEN concat('{"type":"delete_table_row","table_index":0,"row_index":', doc_id % 5, '}')
  WHEN 8 THEN concat('{"type":"format_table_cell","table_index":0,"row_index":', doc_id % 4, ',"col_index":', doc_id % 3, ',"format_options":{"bold":"true"}}')
  ELSE concat('{"type":"add_paragraph","table_index":', doc_id % 3, ',"row_index":', doc_id % 4, ',"col_index":', doc_id % 3, '}') END"""


@query("validate_edits", duck(r"""
  SELECT doc_id, op_index, CASE op_index
      WHEN 0 THEN CASE WHEN NOT has_field THEN 'unknown field' WHEN doc_id % 3 = 0 AND has_second THEN 'name in use' END
      WHEN 1 THEN CASE WHEN doc_id % 2 = 0 OR NOT has_field THEN 'unknown field' END
      WHEN 2 THEN CASE WHEN doc_id % 4 >= n THEN 'unknown block' END
      WHEN 3 THEN CASE WHEN doc_id % 8 <= 4 THEN 'bad range' END
      WHEN 4 THEN CASE doc_id % 3 WHEN 1 THEN 'no url' WHEN 2 THEN 'bad url' END
      WHEN 5 THEN CASE doc_id % 3 WHEN 2 THEN 'unknown table' WHEN 1 THEN 'the last row stays' END
      WHEN 6 THEN CASE WHEN doc_id % 2 = 1 THEN 'no settings' END
      WHEN 7 THEN CASE WHEN doc_id % 5 >= 3 THEN 'unknown row' END
      WHEN 8 THEN CASE WHEN doc_id % 4 = 3 THEN 'unknown row' WHEN doc_id % 3 = 2 THEN 'unknown column' END
      ELSE CASE WHEN doc_id % 3 = 2 THEN 'unknown table' WHEN doc_id % 4 >= CASE doc_id % 3 WHEN 0 THEN 3 ELSE 1 END THEN 'unknown row'
        WHEN doc_id % 3 = 2 THEN 'unknown column' END END AS error
  FROM (SELECT d.doc_id, unnest(range(10)) AS op_index, n, coalesce(hf, false) AS has_field, coalesce(hs, false) AS has_second FROM documents d
    JOIN (SELECT doc_id, max(block_index) + 1 AS n FROM tseg GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, bool_or(field_name = 'field') AS hf, bool_or(field_name = 'field_2') AS hs FROM tfields GROUP BY doc_id) USING (doc_id))
""", "tseg", "tfields"))
def validate_edits(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    ops = docs.withColumn("op_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")))).withColumn(
        "op", F.from_json(F.expr(_CHECK_OPS), _WIDE)
    ).select("doc_id", "op_index", "op.*")
    # Table 0 has three rows, table 1 a single one.
    cells = docs.select(
        "doc_id",
        F.explode(F.expr("""array(named_struct('table_index', bigint(0), 'row', bigint(2), 'col', bigint(1)),
          named_struct('table_index', bigint(1), 'row', bigint(0), 'col', bigint(1)))""")).alias("c"),
    ).select("doc_id", "c.*")
    checked = ST.validate_edits(ops, ST.template_info(segments(spark, d), cells))
    return checked.select("doc_id", "op_index", "error")


@query("batch_outcome", """
  SELECT user_id AS template_id, count(*) AS total, count(*) FILTER (s = 'executed') AS successful, count(*) FILTER (s = 'failed') AS failed,
    count(*) FILTER (s = 'validation_failed') AS invalid, count(*) FILTER (s <> 'executed') = 0 AS success,
    CASE WHEN count(*) FILTER (s = 'validation_failed') > 0 THEN 'Validation failed - no changes made' ELSE 'Batch update completed: ' ||
      count(*) FILTER (s = 'executed') || ' succeeded, ' || count(*) FILTER (s = 'failed') || ' failed' END AS message
  FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 AND event_id % 9 = 0 THEN 'validation_failed' WHEN user_id % 2 = 0 AND event_type = 'error' THEN 'failed' ELSE 'executed' END AS s FROM events)
  GROUP BY user_id""")
def batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    results = X.table(spark, d, "events").selectExpr(
        "user_id AS template_id", "event_id AS op_index",
        """CASE WHEN user_id % 3 = 0 AND event_id % 9 = 0 THEN 'validation_failed' WHEN user_id % 2 = 0 AND event_type = 'error' THEN 'failed'
          ELSE 'executed' END AS status""",
    )
    return ST.batch_outcome(results)


# --- differences --------------------------------------------------------------------------
_DIFF = r"""
  SELECT doc_id, block_index, coalesce(o.text, '') AS old_text, coalesce(n.text, '') AS new_text
  FROM form_blocks o FULL JOIN form_blocks_new n USING (doc_id, block_index)
  WHERE coalesce(o.text, '') <> coalesce(n.text, '') AND NOT (trim(coalesce(o.text, '')) = trim(coalesce(n.text, ''))
    AND regexp_replace(coalesce(o.text, ''), '\s', ' ', 'g') = regexp_replace(coalesce(n.text, ''), '\s', ' ', 'g'))"""


@query("snapshot_diff", duck(_DIFF, "form_blocks", "form_blocks_new"))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.snapshot_diff(X.form_blocks(spark, d), X.form_blocks_new(spark, d))


@query("diff_edits", duck(f"""
  SELECT doc_id, 'update_text' AS type, coalesce(block_index, -1) AS block_index, new_text, CAST(NULL AS VARCHAR) AS field_name FROM ({_DIFF})
  UNION ALL SELECT doc_id, 'delete_placeholder', -1, NULL, field_name FROM (SELECT doc_id, field_name FROM tfields
    EXCEPT SELECT doc_id, field_name FROM tfields WHERE block_index % 11 <> 10)""", "form_blocks", "form_blocks_new", "tfields"))
def diff_edits(spark: SparkSession, d: str) -> DataFrame:
    fields = FL.fields_of(segments(spark, d))
    edits = diff.diff_edits(
        X.form_blocks(spark, d), X.form_blocks_new(spark, d), fields, fields.where("block_index % 11 <> 10")
    )
    return edits.select("doc_id", "type", F.coalesce("block_index", F.lit(-1)).alias("block_index"), "new_text", "field_name")
