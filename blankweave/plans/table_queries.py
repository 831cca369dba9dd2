"""Queries over tables inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.operators import tables as G
from blankweave.plans.duck import duck, merged
from blankweave.plans.registry import query
from blankweave.sources import fixtures as X

_EMPTY = r"(NOT regexp_matches(text, '[\p{L}\p{N}]'))"


@query("table_summary", duck(r"""
  SELECT table_id, coalesce(string_agg(line, chr(10) ORDER BY "row") FILTER (spoken), '') AS summary, bool_or(spoken) AS has_content FROM (
    SELECT table_id, "row", string_agg(trim(text), ' | ' ORDER BY col) AS line, bool_or(trim(text) <> '') AS spoken
    FROM cells GROUP BY ALL) GROUP BY table_id""", "table_cells",
    cells="""SELECT table_id, "row", col, CASE WHEN "row" % 3 = 1 THEN ' ' ELSE text END AS text FROM table_cells"""))
def table_summary(spark: SparkSession, d: str) -> DataFrame:
    cells = X.table_cells(spark, d).withColumn("text", F.when(F.col("row") % 3 == 1, F.lit(" ")).otherwise(F.col("text")))
    return G.table_summary(cells)


@query("table_grid_text", duck(r"""
  SELECT table_id, string_agg('Row ' || "row" || ': ' || line, chr(10) ORDER BY "row") AS grid FROM (
    SELECT table_id, "row", string_agg(CASE WHEN trim(text) = '' THEN '[EMPTY]' ELSE '"' || trim(text) || '"' END, ' | ' ORDER BY col) AS line
    FROM (SELECT table_id, "row", col, CASE WHEN "row" % 2 = 0 AND col = 2 THEN ' ' ELSE text END AS text FROM table_cells) GROUP BY ALL)
  GROUP BY table_id""", "table_cells"))
def table_grid_text(spark: SparkSession, d: str) -> DataFrame:
    blank = (F.col("row") % 2 == 0) & (F.col("col") == 2)
    return G.table_grid_text(X.table_cells(spark, d).withColumn("text", F.when(blank, F.lit(" ")).otherwise(F.col("text"))))


# Lines as rows: the same lines, and where each begins in the joined text.
@query("table_summary_lines", duck(r"""
  SELECT table_id, "row", line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY table_id ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos
  FROM (SELECT table_id, "row", string_agg(trim(text), ' | ' ORDER BY col) AS line, bool_or(trim(text) <> '') AS spoken FROM cells GROUP BY ALL) WHERE spoken""", "table_cells",
    cells="""SELECT table_id, "row", col, CASE WHEN "row" % 3 = 1 THEN ' ' ELSE text END AS text FROM table_cells"""))
def table_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    cells = X.table_cells(spark, d).withColumn("text", F.when(F.col("row") % 3 == 1, F.lit(" ")).otherwise(F.col("text")))
    return G.with_line_starts(G.summary_lines(cells).where("spoken"), cells).drop("spoken")


@query("table_grid_lines", duck(r"""
  SELECT table_id, "row", line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY table_id ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos
  FROM (SELECT table_id, "row", 'Row ' || "row" || ': ' || shown AS line FROM (
    SELECT table_id, "row", string_agg(CASE WHEN trim(text) = '' THEN '[EMPTY]' ELSE '"' || trim(text) || '"' END, ' | ' ORDER BY col) AS shown FROM table_cells GROUP BY ALL))""", "table_cells"))
def table_grid_lines(spark: SparkSession, d: str) -> DataFrame:
    cells = X.table_cells(spark, d)
    return G.with_line_starts(G.grid_lines(cells), cells)


@query("table_structure", duck("""
  SELECT table_id, max("row") AS data_rows, true AS has_header, max(col) + 1 AS columns FROM table_cells GROUP BY table_id""", "table_cells"))
def table_structure(spark: SparkSession, d: str) -> DataFrame:
    return G.table_structure(X.table_cells(spark, d))


@query("empty_cells", duck(f"SELECT table_id, count(*) FILTER ({_EMPTY}) AS empty_cells FROM table_cells GROUP BY table_id", "table_cells"))
def empty_cells(spark: SparkSession, d: str) -> DataFrame:
    return G.empty_cells(X.table_cells(spark, d))


_PLAN = dict(
    last_rows='SELECT table_id, max("row") AS last_row FROM table_cells GROUP BY table_id',
    counts=f"""SELECT c.table_id, any_value(last_row) + 1 AS total_rows, max(col) + 1 AS columns,
        count(*) FILTER ({_EMPTY}) AS empty_cells, count(*) FILTER ({_EMPTY} AND "row" = last_row) AS last_empties,
        count(*) FILTER ("row" = last_row) AS last_cells
      FROM table_cells c JOIN last_rows USING (table_id) GROUP BY c.table_id""",
    sized="""SELECT *, CASE WHEN last_empties = 0 THEN last_cells ELSE last_empties END AS per_row FROM counts JOIN requirements USING (table_id)""",
    plan="""SELECT table_id, total_rows, columns, empty_cells, required, required > empty_cells AS needs_expansion, rows_to_add,
        empty_cells + rows_to_add * per_row AS empty_after
      FROM (SELECT *, CASE WHEN required > empty_cells AND total_rows > 1 THEN (required - empty_cells + per_row - 1) // per_row ELSE 0 END AS rows_to_add FROM sized)""",
)
_PLAN_NEEDS = ("table_cells", "requirements")


@query("expansion_plan", duck("SELECT * FROM plan", *_PLAN_NEEDS, **_PLAN))
def expansion_plan(spark: SparkSession, d: str) -> DataFrame:
    return G.expansion_plan(X.table_cells(spark, d), X.requirements(spark, d))


@query("tables_needing_growth", duck("""
  SELECT table_id % 50 AS template_id, count(*) FILTER (rows_to_add > 0) AS tables_expanded, CAST(sum(rows_to_add) AS BIGINT) AS total_rows_added,
    'Merge completed: ' || count(*) FILTER (rows_to_add > 0) || ' tables expanded, ' || CAST(sum(rows_to_add) AS BIGINT) || ' rows added' AS message
  FROM plan GROUP BY table_id % 50""", *_PLAN_NEEDS, **_PLAN))
def tables_needing_growth(spark: SparkSession, d: str) -> DataFrame:
    plan = G.expansion_plan(X.table_cells(spark, d), X.requirements(spark, d))
    return G.growth_summary(plan, F.col("table_id") % 50)


@query("record_requirements", duck("""
  SELECT DISTINCT l_orderkey AS table_id, o_custkey AS template_id, w.wanted FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN (SELECT c_custkey, c_custkey % 7 AS wanted FROM customer) w ON o_custkey = c_custkey"""))
def record_requirements(spark: SparkSession, d: str) -> DataFrame:
    owners = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("template_id"))
    tables = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id")).distinct().join(owners, "table_id")
    wanted = X.table(spark, d, "customer").select(F.col("c_custkey").alias("template_id"), (F.col("c_custkey") % 7).alias("wanted"))
    return G.record_requirements(tables, wanted)


_NAMED_CELLS = """SELECT table_id, "row", col, CASE col WHEN 0 THEN 'stt' WHEN 1 THEN 'muc_' || text ELSE 'ghi_' || table_id % 5 END AS field_name FROM table_cells
  WHERE NOT (col = 1 AND "row" % 2 = 0)"""


def _named_cells(spark: SparkSession, d: str) -> DataFrame:
    return X.table_cells(spark, d).where("NOT (col = 1 AND row % 2 = 0)").withColumn(
        "field_name", F.expr("CASE col WHEN 0 THEN 'stt' WHEN 1 THEN 'muc_' || text ELSE 'ghi_' || table_id % 5 END")
    )


_CLONES = dict(
    named_cells=_NAMED_CELLS,
    clones=r"""SELECT table_id, "row" + k + 1 AS "row", col, regexp_replace(field_name, '_\d+$', '') || '_' || CASE
        WHEN regexp_matches(field_name, '_\d+$') THEN CAST(regexp_extract(field_name, '_(\d+)$', 1) AS BIGINT) + k + 1 ELSE k + 2 END AS field_name
      FROM (SELECT n.*, unnest(range(p.rows_to_add)) AS k FROM named_cells n JOIN plan p ON n.table_id = p.table_id
        AND n."row" = p.total_rows - 1 WHERE p.rows_to_add > 0)""",
)


@query("row_clone_names", duck("SELECT * FROM clones", *_PLAN_NEEDS, **_PLAN, **_CLONES))
def row_clone_names(spark: SparkSession, d: str) -> DataFrame:
    plan = G.expansion_plan(X.table_cells(spark, d), X.requirements(spark, d))
    return G.row_clone_names(_named_cells(spark, d), plan)


@query("merge_with_expansion", duck(rf"""
  SELECT table_id, "row", col, field_name, {merged("'....'", 'value', 'false')} AS shown FROM (
    SELECT a.*, CASE col WHEN 0 THEN '\* Upper' ELSE '\* MERGEFORMAT' END AS switch,
      CASE WHEN length(a.field_name) % 2 = 0 THEN 'giá trị ' || a.field_name END AS value
    FROM (SELECT * FROM named_cells UNION ALL SELECT * FROM clones) a)""", *_PLAN_NEEDS, **_PLAN, **_CLONES))
def merge_with_expansion(spark: SparkSession, d: str) -> DataFrame:
    fields = _named_cells(spark, d).withColumn(
        "switch", F.when(F.col("col") == 0, F.lit("\\* Upper")).otherwise(F.lit("\\* MERGEFORMAT"))
    ).withColumn("original_text", F.lit("....")).drop("text")
    cells, required = X.table_cells(spark, d), X.requirements(spark, d)
    clones = G.row_clone_names(fields, G.expansion_plan(cells, required))
    names = fields.select("table_id", "field_name").unionByName(clones.select("table_id", "field_name")).distinct()
    values = names.where(F.length("field_name") % 2 == 0).withColumn("value", F.concat(F.lit("giá trị "), F.col("field_name")))
    return G.merge_with_expansion(fields, cells, required, values)


_SPANS = dict(xml="""SELECT table_id, "row", col AS pos, CASE WHEN (table_id + "row" + col) % 3 = 0 THEN 2 ELSE 1 END AS colspan, text FROM table_cells""")


def _xml_cells(spark: SparkSession, d: str) -> DataFrame:
    return X.table_cells(spark, d).select(
        "table_id", "row", F.col("col").alias("pos"),
        F.expr("CASE WHEN (table_id + row + col) % 3 = 0 THEN 2 ELSE 1 END").alias("colspan"), "text",
    )


_STARTS = """SELECT *, CAST(coalesce(sum(colspan) OVER (PARTITION BY table_id, "row" ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS BIGINT) AS col FROM xml"""


@query("logical_columns", duck("""SELECT table_id, "row", pos, col FROM starts""", "table_cells", **_SPANS, starts=_STARTS))
def logical_columns(spark: SparkSession, d: str) -> DataFrame:
    return G.logical_columns(_xml_cells(spark, d)).select("table_id", "row", "pos", "col")


@query("cell_at_column", duck("""
  SELECT w.table_id, w."row", w.col, s.pos, s.col AS start_col FROM (SELECT DISTINCT table_id, "row", ("row" + table_id) % 6 AS col FROM table_cells) w
  JOIN starts s ON s.table_id = w.table_id AND s."row" = w."row" AND s.col <= w.col AND w.col < s.col + s.colspan
""", "table_cells", **_SPANS, starts=_STARTS))
def cell_at_column(spark: SparkSession, d: str) -> DataFrame:
    wanted = X.table_cells(spark, d).select("table_id", "row", ((F.col("row") + F.col("table_id")) % 6).alias("col")).distinct()
    return G.cell_at_column(_xml_cells(spark, d), wanted).select("table_id", "row", "col", "pos", "start_col")


@query("fill_empty_cells", duck(f"""
  SELECT table_id, "row", col, 'field' || CASE WHEN nth = 1 THEN '' ELSE '_' || nth END AS field_name FROM (
    SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY "row", col) AS nth FROM table_cells WHERE "row" >= 1 AND {_EMPTY})
""", "table_cells"))
def fill_empty_cells(spark: SparkSession, d: str) -> DataFrame:
    return G.fill_empty_cells(X.table_cells(spark, d))


@query("fill_proposed_cells", duck("""
  SELECT table_id, "row", col, 'de_xuat_' || col AS field_name FROM table_cells
  WHERE trim(CASE WHEN "row" % 2 = 0 THEN ' ' ELSE text END) = '' AND (table_id + "row") % 3 <> 0 AND col < 2""", "table_cells"))
def fill_proposed_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = X.table_cells(spark, d).withColumn("text", F.when(F.col("row") % 2 == 0, F.lit(" ")).otherwise(F.col("text")))
    inside = cells.where("(table_id + row) % 3 <> 0 AND col < 2").select(
        "table_id", "row", "col", F.concat(F.lit("de_xuat_"), F.col("col").cast("string")).alias("field_name")
    )
    outside = inside.where("row = 0").withColumn("row", F.lit(-1).cast("bigint"))
    return G.fill_proposed_cells(cells, inside.unionByName(outside))


_CELL_TEXT = """CASE col WHEN 0 THEN 'Dòng ' || text || chr(10) || ' ' || chr(10) || 'số dòng ' || text WHEN 1 THEN 'Loại ' || text || ' ký' ELSE text END"""


@query("best_matching_cell", duck(rf"""
  SELECT table_id, "row", col, para_in_cell FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, "row", col, para_in_cell) AS rn FROM (
    SELECT table_id, "row", col, para_in_cell, max(len(list_intersect(p, w)) / len(p) + len(list_intersect(parts, w)) * 0.2::DOUBLE) AS score
    FROM (SELECT table_id, "row", col, para_in_cell, w, ['chu', 'ký', CAST(table_id % 5 AS VARCHAR)] AS parts,
        unnest([['dòng', CAST(table_id % 4 AS VARCHAR)], ['loại', 'r', 'x' || table_id % 3]]) AS p
      FROM (SELECT *, list_distinct(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+', 0)) AS w
        FROM (SELECT table_id, "row", col, CAST(i AS BIGINT) AS para_in_cell, string_split(cell, chr(10))[i + 1] AS t
          FROM (SELECT table_id, "row", col, {_CELL_TEXT} AS cell FROM table_cells), unnest(range(len(string_split(cell, chr(10))))) AS u(i))) WHERE len(w) > 0)
    GROUP BY ALL) WHERE score > 0) WHERE rn = 1""", "table_cells"))
def best_matching_cell(spark: SparkSession, d: str) -> DataFrame:
    cells = X.table_cells(spark, d).withColumn("text", F.expr(_CELL_TEXT))
    hints = X.requirements(spark, d).select(
        "table_id",
        F.expr("concat('Dòng ', table_id % 4, ' |  Loại R x', table_id % 3)").alias("hint"),
        F.expr("concat('chu_ký_', table_id % 5)").alias("name"),
    )
    return G.best_matching_cell(cells, hints)


# Two edits per table, the second at positions after the first.
_GRID_EDITS = """SELECT table_id, 0 AS op_index, CASE WHEN table_id % 3 = 0 THEN 'delete' ELSE 'insert' END AS action,
    CASE WHEN table_id % 7 = 0 THEN NULL ELSE table_id % 4 END AS place, table_id % 2 = 0 AS after FROM requirements
  UNION ALL SELECT table_id, 1, CASE WHEN table_id % 4 = 0 THEN 'delete' ELSE 'insert' END, table_id % 3, table_id % 5 = 0 FROM requirements"""


def _grid_edits(spark: SparkSession, d: str, after: str, before: str) -> DataFrame:
    tables = X.requirements(spark, d)
    first = tables.selectExpr(
        "table_id", "0L AS op_index", "CASE WHEN table_id % 3 = 0 THEN 'delete' ELSE 'insert' END AS action",
        "CASE WHEN table_id % 7 = 0 THEN NULL ELSE table_id % 4 END AS at",
        f"CASE WHEN table_id % 2 = 0 THEN '{after}' ELSE '{before}' END AS position",
    )
    return first.unionByName(tables.selectExpr(
        "table_id", "1L AS op_index", "CASE WHEN table_id % 4 = 0 THEN 'delete' ELSE 'insert' END AS action", "table_id % 3 AS at",
        f"CASE WHEN table_id % 5 = 0 THEN '{after}' ELSE '{before}' END AS position",
    ))


def _grid_step(axis: str, number: int, cells: str, sizes: str) -> dict[str, str]:
    """One edit of every table, over the cells (a along the axis, o across) and sizes before it."""
    k = str(number)
    return {
        "planned" + k: f"""SELECT *, CASE WHEN action = 'insert' AND place IS NOT NULL AND after THEN place + 1 ELSE coalesce(place, n) END AS t
          FROM edits JOIN {sizes} USING (table_id) WHERE op_index = {number}""",
        "judged" + k: f"""SELECT *, CASE WHEN action = 'delete' AND n <= 1 THEN 'the last {axis} stays' WHEN action = 'insert' AND NOT t BETWEEN 0 AND n
          THEN '{axis} is out of range' WHEN action = 'delete' AND NOT t BETWEEN 0 AND n - 1 THEN '{axis} is out of range' END AS error FROM planned{k}""",
        "good" + k: f"SELECT table_id, action, t, m FROM judged{k} WHERE error IS NULL",
        "sizes" + k: f"SELECT table_id, n + CASE WHEN error IS NOT NULL THEN 0 WHEN action = 'insert' THEN 1 ELSE -1 END AS n, m FROM judged{k}",
        "result" + k: f"""SELECT c.table_id, o, a + CASE WHEN action = 'insert' AND a >= t THEN 1 WHEN action = 'delete' AND a > t THEN -1 ELSE 0 END AS a, c.text
          FROM {cells} c LEFT JOIN good{k} g USING (table_id) WHERE NOT coalesce(action = 'delete' AND a = t, false)
          UNION ALL SELECT table_id, unnest(range(m)), t, '' FROM good{k} WHERE action = 'insert'""",
    }


def _grid_sql(axis: str, other: str) -> dict[str, str]:
    return dict(
        edits=_GRID_EDITS,
        sizes=f'SELECT table_id, max("{axis}") + 1 AS n, max("{other}") + 1 AS m FROM table_cells GROUP BY table_id',
        given=f'SELECT table_id, "{other}" AS o, "{axis}" AS a, text FROM table_cells',
        **_grid_step(axis, 0, "given", "sizes"), **_grid_step(axis, 1, "result0", "sizes0"),
        judged="SELECT * FROM judged0 UNION ALL BY NAME SELECT * FROM judged1", result="SELECT * FROM result1",
    )


@query("edit_table_rows", duck("""SELECT table_id, a AS "row", o AS col, text FROM result""", *_PLAN_NEEDS, **_grid_sql("row", "col")))
def edit_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.edit_table_rows(X.table_cells(spark, d), _grid_edits(spark, d, "below", "above"))[0]


@query("edit_table_rows_status", duck("""
  SELECT table_id, CAST(op_index AS BIGINT) AS op_index, CASE WHEN error IS NULL THEN 'executed' ELSE 'failed' END AS status, error FROM judged""", *_PLAN_NEEDS, **_grid_sql("row", "col")))
def edit_table_rows_status(spark: SparkSession, d: str) -> DataFrame:
    return G.edit_table_rows(X.table_cells(spark, d), _grid_edits(spark, d, "below", "above"))[1]


@query("edit_table_columns", duck("""SELECT table_id, o AS "row", a AS col, text FROM result""", *_PLAN_NEEDS, **_grid_sql("col", "row")))
def edit_table_columns(spark: SparkSession, d: str) -> DataFrame:
    return G.edit_table_columns(X.table_cells(spark, d), _grid_edits(spark, d, "right", "left"))[0]
