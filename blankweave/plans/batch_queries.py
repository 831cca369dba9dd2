"""Mixed requests of edits, and the same requests walked through edit by edit in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.operators import batch as B
from blankweave.operators import fields as FL
from blankweave.plans.duck import duck
from blankweave.plans.registry import query
from blankweave.sources import fixtures as X
from blankweave.sources.readers import EDIT_SCHEMA

# A request per document: a rename that may fail its check, a cut and a new field in one block that may fail when applied,
# a rename of that field, a deletion of the renamed field or of one that isn't there, a block less and a rename after it.
_REQUEST = (
    ("rename_placeholder", "true", dict(old_name="CASE WHEN doc_id % 9 = 8 THEN 'khong_co' ELSE 'field' END", new_name="'ten_moi'")),
    ("delete_text_range", "true", dict(block_index="doc_id % 3", start_offset="doc_id % 7", end_offset="doc_id % 7 + 5")),
    ("add_placeholder_by_offset", "true", dict(block_index="doc_id % 3", field_name="'them'", offset="doc_id % 29")),
    ("rename_placeholder", "true", dict(old_name="'them'", new_name="'them_hai'")),
    ("delete_placeholder", "true", dict(field_name="CASE WHEN doc_id % 4 = 0 THEN 'ten_moi' WHEN doc_id % 20 = 3 THEN 'mat' ELSE 'field_2' END")),
    ("delete_paragraph", "doc_id % 5 = 1", dict(block_index="doc_id % 11")),
    ("rename_placeholder", "doc_id % 6 = 1", dict(old_name="'ck_field_2'", new_name="CASE WHEN doc_id % 4 = 1 THEN 'ck_field' ELSE 'ck_moi' END")),
)
_STOPS, _DRY = "doc_id % 2 = 0", "doc_id % 13 = 0"

_BLOCK_COUNTS = "(SELECT doc_id, max(block_index) + 1 AS n FROM {s} GROUP BY doc_id)"
_NAMES = "(SELECT DISTINCT doc_id, field_name FROM {s} WHERE kind = 'field')"
_KEEP = "field_name, switch, original_text"
_CLEARED = "CASE WHEN NOT {gone} THEN field_name END AS field_name, CASE WHEN NOT {gone} THEN switch END AS switch, CASE WHEN NOT {gone} THEN original_text END AS original_text"


def _step(k: int, kind: str, when: str, values: dict[str, str]) -> dict[str, str]:
    """Edit k of all requests, checked and applied against state ``s<k>``; gives ``r<k>`` and the state after it."""
    s, given = f"s{k}", ", ".join(f'{value} AS "{name}"' for name, value in values.items())
    names, counts = _NAMES.format(s=s), _BLOCK_COUNTS.format(s=s)
    edits = f"SELECT doc_id, {given} FROM documents WHERE {when}"
    if kind in ("rename_placeholder", "delete_placeholder"):
        old = "old_name" if kind == "rename_placeholder" else "field_name"
        used = "WHEN t.doc_id IS NOT NULL AND e.new_name <> e.old_name THEN 'name in use'" if old == "old_name" else ""
        taken = f"LEFT JOIN {names} t ON t.doc_id = e.doc_id AND t.field_name = e.new_name" if old == "old_name" else ""
        checks = rf"""SELECT e.*, coalesce(x.field_name, b.field_name) AS matched, NULL AS why, CASE WHEN x.doc_id IS NULL AND b.doc_id IS NULL THEN 'unknown field' {used} END AS error
          FROM e{k} e LEFT JOIN {names} x ON x.doc_id = e.doc_id AND x.field_name = e.{old}
          LEFT JOIN {names} b ON b.doc_id = e.doc_id AND b.field_name = regexp_replace(e.{old}, '_\d+$', '') {taken}"""
        hit = "(c.doc_id IS NOT NULL AND s.kind = 'field')"
        source = f"{s} s LEFT JOIN c{k} c ON c.doc_id = s.doc_id AND c.matched = s.field_name AND c.error IS NULL"
        if kind == "rename_placeholder":
            pieces = rf"""SELECT s.doc_id, block_index, seg_index AS ord, kind, CASE WHEN {hit} THEN '«' || new_name || '»' ELSE text END AS text,
              CASE WHEN {hit} THEN new_name ELSE s.field_name END AS field_name, CASE WHEN {hit} THEN '\* MERGEFORMAT' ELSE switch END AS switch, original_text FROM {source}"""
        else:
            pieces = f"""SELECT doc_id, block_index, seg_index AS ord, CASE WHEN gone THEN 'text' ELSE kind END AS kind, CASE WHEN gone THEN '' ELSE text END AS text,
              {_CLEARED.format(gone='gone')} FROM (SELECT s.*, {hit} AS gone FROM {source})"""
    elif kind == "delete_text_range":
        checks = f"""SELECT e.*, CASE WHEN l.len <= start_offset THEN 'range not found' END AS why,
            CASE WHEN l.doc_id IS NULL THEN 'unknown block' WHEN end_offset <= start_offset THEN 'bad range' END AS error
          FROM e{k} e LEFT JOIN (SELECT doc_id, block_index, max(end_pos) AS len FROM {s} GROUP BY ALL) l USING (doc_id, block_index)"""
        pieces = f"""SELECT doc_id, block_index, seg_index AS ord, CASE WHEN hit THEN 'text' ELSE kind END AS kind, CASE WHEN NOT hit THEN text WHEN kind = 'field' THEN ''
            ELSE left(text, CAST(greatest(a - start_pos, 0) AS BIGINT)) || substring(text, CAST(greatest(z - start_pos, 0) AS BIGINT) + 1) END AS text,
            {_CLEARED.format(gone="(hit AND kind = 'field')")}
          FROM (SELECT s.*, c.start_offset AS a, c.end_offset AS z, c.doc_id IS NOT NULL AND s.end_pos > c.start_offset AND s.start_pos < c.end_offset AS hit
            FROM {s} s LEFT JOIN c{k} c ON c.doc_id = s.doc_id AND c.block_index = s.block_index AND c.error IS NULL)"""
    elif kind == "add_placeholder_by_offset":
        checks = f"""SELECT e.*, p.seg_index AS target, p.start_pos AS start, CASE WHEN p.doc_id IS NULL THEN 'offset not found' END AS why,
            CASE WHEN n.n IS NULL OR e.block_index >= n.n THEN 'unknown block' WHEN t.doc_id IS NOT NULL THEN 'name in use' END AS error
          FROM e{k} e LEFT JOIN {counts} n USING (doc_id) LEFT JOIN {names} t ON t.doc_id = e.doc_id AND t.field_name = e.field_name
          LEFT JOIN (SELECT d.doc_id, min(seg_index) AS seg_index, min_by(start_pos, seg_index) AS start_pos FROM e{k} d JOIN {s} s USING (doc_id, block_index)
              WHERE kind = 'text' AND (d."offset" BETWEEN start_pos AND end_pos OR (text = '' AND end_pos = 0)) GROUP BY d.doc_id) p ON p.doc_id = e.doc_id"""
        pieces = rf"""SELECT s.doc_id, s.block_index, seg_index * 10 AS ord, kind, text, s.field_name, switch, original_text FROM {s} s WHERE NOT EXISTS (
            SELECT 1 FROM hit{k} h WHERE h.doc_id = s.doc_id AND h.block_index = s.block_index AND h.target = s.seg_index)
          UNION ALL SELECT h.doc_id, h.block_index, target * 10 + part, CASE part WHEN 2 THEN 'field' ELSE 'text' END,
            CASE part WHEN 1 THEN left(text, h."offset" - start) WHEN 2 THEN '«' || h.field_name || '»' ELSE substring(text, h."offset" - start + 1) END,
            CASE part WHEN 2 THEN h.field_name END, CASE part WHEN 2 THEN '\* MERGEFORMAT' END, CASE part WHEN 2 THEN '' END
          FROM hit{k} h JOIN {s} s ON s.doc_id = h.doc_id AND s.block_index = h.block_index AND s.seg_index = h.target, (VALUES (1), (2), (3)) AS v(part)"""
    else:
        checks = f"""SELECT e.*, NULL AS why, CASE WHEN n.n IS NULL OR e.block_index >= n.n THEN 'unknown block' END AS error
          FROM e{k} e LEFT JOIN {counts} n USING (doc_id)"""
        pieces = f"""SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block_index) - 1 AS block_index, seg_index AS ord, kind, text, {_KEEP}
          FROM {s} s WHERE NOT EXISTS (SELECT 1 FROM c{k} c WHERE c.doc_id = s.doc_id AND c.block_index = s.block_index AND c.error IS NULL)"""
    out = {f"e{k}": edits, f"c{k}": checks}
    if kind == "add_placeholder_by_offset":
        out[f"hit{k}"] = f"SELECT * FROM c{k} WHERE error IS NULL AND why IS NULL"
    out[f"p{k}"] = pieces
    out[f"s{k + 1}"] = f"""SELECT doc_id, block_index, seg_index, kind, text, {_KEEP}, start_pos, start_pos + length(text) AS end_pos FROM (
      SELECT doc_id, block_index, CAST(row_number() OVER b - 1 AS BIGINT) AS seg_index, kind, text, {_KEEP},
        CAST(coalesce(sum(length(text)) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos
      FROM (SELECT *, count(*) FILTER (text <> '') OVER (PARTITION BY doc_id, block_index) AS spoken, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY ord) AS rk FROM p{k})
      WHERE text <> '' OR (spoken = 0 AND rk = 1) WINDOW b AS (PARTITION BY doc_id, block_index ORDER BY ord))"""
    out[f"r{k}"] = f"""SELECT doc_id, CAST({k} AS BIGINT) AS op_index, '{kind}' AS type, CASE WHEN error IS NOT NULL THEN 'validation_failed' WHEN why IS NOT NULL THEN 'failed' ELSE 'executed' END AS status,
      coalesce(error, why) AS error FROM c{k}"""
    return out


_BATCH_SQL = {"s0": f"SELECT doc_id, block_index, seg_index, kind, text, {_KEEP}, start_pos, end_pos FROM tseg"}
for _k, (_kind, _when, _values) in enumerate(_REQUEST):
    _BATCH_SQL |= _step(_k, _kind, _when, _values)
_BATCH_SQL |= {
    "results": " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(_REQUEST))),
    "told": f"""SELECT doc_id, {_DRY} AS dry, CASE WHEN {_STOPS} THEN min(op_index) FILTER (status <> 'executed') END AS last FROM results GROUP BY doc_id""",
    "reached": """SELECT doc_id, op_index, type, CASE WHEN dry AND status = 'executed' THEN 'validated' WHEN dry AND status = 'failed' THEN 'validation_failed' ELSE status END AS status, error
      FROM results JOIN told USING (doc_id) WHERE last IS NULL OR op_index <= last""",
    "kept": """SELECT doc_id FROM reached JOIN told USING (doc_id) GROUP BY doc_id
      HAVING NOT bool_or(dry) AND count(*) FILTER (status = 'validation_failed') = 0 AND max(last) IS NULL""",
}


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = X.table(spark, d, "documents").select("doc_id")
    names = [part.strip().split(" ") for part in EDIT_SCHEMA.split(", ")]
    edits = None
    for k, (kind, when, values) in enumerate(_REQUEST):
        columns = [f"'{kind}' AS type"] + [f"cast({values.get(name, 'NULL')} AS {form}) AS {name}" for name, form in names if name != "type"]
        own = documents.where(when).selectExpr("doc_id", f"{k}L AS op_index", *columns)
        edits = own if edits is None else edits.unionByName(own)
    return edits, documents.selectExpr("doc_id", f"{_STOPS} AS stop_on_error", f"{_DRY} AS validate_only")


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return FL.convert_blocks(X.form_blocks(spark, d)), *_requests(spark, d)


@query("apply_edits", duck(f"""
  SELECT doc_id, block_index, seg_index, kind, text, {_KEEP}, start_pos, end_pos FROM s{len(_REQUEST)} WHERE doc_id IN (FROM kept)
  UNION ALL SELECT doc_id, block_index, seg_index, kind, text, {_KEEP}, start_pos, end_pos FROM s0 WHERE doc_id NOT IN (FROM kept)""", "tseg", **_BATCH_SQL))
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    return B.apply_edits(*_inputs(spark, d))[0]


@query("apply_edits_status", duck("SELECT doc_id, op_index, type, status, error FROM reached", "tseg", **_BATCH_SQL))
def apply_edits_status(spark: SparkSession, d: str) -> DataFrame:
    return B.edit_status(*_inputs(spark, d))
