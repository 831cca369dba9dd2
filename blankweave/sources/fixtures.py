"""Form data derived from the generic test tables.

The given tables hold prose, orders and events, not forms; these views turn
them into blocks with blanks, merge records, table cells and messages. Each is
a plain projection of a whole table, so its size follows the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blankweave.operators.blocks import by_document
from blankweave.operators.ranking import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> blocks with headings, blanks, check boxes, dates and continuation lines."""
    return _as_form(table(spark, sf_dir, "documents").select("doc_id", "text"))


def form_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``form_lines`` clustered by document.

    The exchange moves whole documents, before they become rows; the windows,
    aggregates and joins per document that follow need no other one.
    """
    return _as_form(by_document(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _as_form(documents: DataFrame) -> DataFrame:
    i, line = F.col("i"), F.col("line")
    body = (
        F.when(
            i % 7 == 0,
            F.concat(F.lit("Mục "), (F.floor(i / 7) + 1).cast("string"), F.lit(" "), line),
        )
        .when(i % 7 == 4, F.concat(F.lit(".......... "), line))
        .when(
            i % 7 == 5,
            F.concat(F.lit("□ "), line, F.lit(" ■ Ngày ... tháng ... năm 20...")),
        )
        .otherwise(F.regexp_replace(line, "[a-z]{9,}", ": ........ "))
    )
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select(
        "doc_id", i.cast("bigint").alias("block_index"), body.alias("text")
    )


def tab_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> lines with tabs and the leaders of their tab stops."""
    i, line = F.col("i"), F.col("line")
    tabbed = F.regexp_replace(line, " [a-zA-Z]{1,2} ", "\t\t")
    text = F.when(i % 5 == 4, F.concat(F.lit("\t \t"), tabbed)).otherwise(tabbed)
    leaders = (
        F.when(i % 4 == 0, F.array(F.lit("dot"), F.lit("none"), F.lit("underscore")))
        .when(i % 4 == 1, F.array(F.lit("heavy"), F.lit("middleDot"), F.lit("dot"), F.lit("hyphen")))
        .when(i % 4 == 2, F.array(F.lit("none"), F.lit("dot")))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
        .select("doc_id", i.cast("bigint").alias("block_index"), text.alias("text"), leaders.alias("tab_leaders"))
    )


# Three short letters; kept as one literal so that every engine reads the same rows.
LETTER_ROWS = """
  (0, 0, 0, 'text', 'Kính gửi: ', NULL, NULL, NULL),
  (0, 0, 1, 'field', NULL, 'ho_ten', '\\* Upper', '........'),
  (0, 0, 2, 'text', ', nhóm', NULL, NULL, NULL),
  (0, 0, 3, 'field', NULL, 'phan_khuc', '\\* Caps', '......'),
  (0, 0, 4, 'text', '.', NULL, NULL, NULL),
  (0, 1, 0, 'text', 'Ngày ', NULL, NULL, NULL),
  (0, 1, 1, 'field', NULL, 'ngay', '\\* MERGEFORMAT', '...'),
  (0, 1, 2, 'text', ' tháng ', NULL, NULL, NULL),
  (0, 1, 3, 'field', NULL, 'thang', '\\* MERGEFORMAT', '...'),
  (0, 1, 4, 'text', ' năm ', NULL, NULL, NULL),
  (0, 1, 5, 'field', NULL, 'nam', '\\* MERGEFORMAT', '20...'),
  (1, 0, 0, 'field', NULL, 'ck_gap', '\\* MERGEFORMAT', '□'),
  (1, 0, 1, 'text', 'Gấp (', NULL, NULL, NULL),
  (1, 0, 2, 'field', NULL, 'ho_ten', '\\* MERGEFORMAT', '....'),
  (1, 0, 3, 'text', ')', NULL, NULL, NULL),
  (1, 0, 4, 'field', NULL, 'khong_co', '\\* MERGEFORMAT', ''),
  (1, 0, 5, 'field', NULL, 'ho_ten', '\\* Caps', '....'),
  (1, 0, 6, 'text', 'và hết', NULL, NULL, NULL),
  (1, 1, 0, 'text', 'Không có chỗ trống.', NULL, NULL, NULL),
  (2, 0, 0, 'text', 'Năm', NULL, NULL, NULL),
  (2, 0, 1, 'field', NULL, 'nam', '\\* Upper', '20..'),
  (2, 0, 2, 'field', NULL, 'phan_khuc', '\\* Upper', '__'),
  (2, 0, 3, 'field', NULL, 'ck_gap', '\\* Caps', '■'),
  (2, 1, 0, 'text', '<', NULL, NULL, NULL),
  (2, 1, 1, 'field', NULL, 'vang_mat', '\\* MERGEFORMAT', '(....)'),
  (2, 1, 2, 'text', '[ghi chú]', NULL, NULL, NULL)
"""
LETTER_COLUMNS = "template_id, block_index, seg_index, kind, text, field_name, switch, original_text"


def letter_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = LETTER_ROWS.replace("\\*", "\\\\*")
    names = LETTER_COLUMNS.split(", ")
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({LETTER_COLUMNS})").select(
        *[F.col(c).cast("bigint") for c in names[:3]], *names[3:]
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> merge records, each for one of the letters."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 3).alias("template_id")
    )


def merge_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and customer -> field values in long form, one exploded row per field."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    pairs = [
        ("ho_ten", F.col("c_name")),
        ("phan_khuc", F.lower("c_mktsegment")),
        ("ngay", F.date_format("o_orderdate", "dd")),
        ("thang", F.date_format("o_orderdate", "MM")),
        ("nam", F.date_format("o_orderdate", "yyyy")),
        ("ck_gap", F.when(F.col("o_orderstatus") == "F", F.lit("x")).otherwise(F.lit(""))),
    ]
    named = F.array(*[F.struct(F.lit(n).alias("field_name"), v.alias("value")) for n, v in pairs])
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .select(F.col("o_orderkey").alias("record_id"), F.explode(named).alias("p"))
        .select("record_id", "p.field_name", "p.value")
    )


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth record keeps its year blank."""
    return records(spark, sf_dir).where("record_id % 10 = 0").select("record_id", F.lit("nam").alias("field_name"))


def draft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> messages of fill conversations; every fifth message carries a blank, half of these typed in by hand."""
    return draft_messages_of(table(spark, sf_dir, "events"))


def draft_messages_of(events: DataFrame) -> DataFrame:
    value = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("v"), F.get_json_object("props", "$.k"))
    )
    return events.select(
        F.col("user_id").alias("draft_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("field_name"),
        value.alias("value"),
        (F.col("event_id") % 10 == 5).alias("is_explicit"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> drafts with their fields and locks; every tenth locks one, every seventh lacks one."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("draft_id")).distinct().select(
        "draft_id",
        F.expr("CASE WHEN draft_id % 7 = 3 THEN array('click', 'error', 'purchase', 'view') ELSE array('click', 'error', 'purchase', 'signup', 'view') END").alias("fields"),
        F.expr("CASE WHEN draft_id % 10 = 0 THEN array('view') ELSE array() END").alias("locked"),
    )


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> three-column tables, one per order.

    An order may hold any share of all lines, so its rows are numbered in two
    levels over the leading sort columns.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        "l_returnflag", "l_linestatus",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = numbered(
        lines.withColumn("part_band", F.floor(F.col("l_partkey") / 65536)),
        ["l_orderkey"], ["l_linenumber", "part_band"], order, "row_number",
    ).withColumn("row", F.col("row_number") - 1)
    text = (
        F.when(F.col("col") == 0, F.col("l_linenumber").cast("string")).when(F.col("col") == 1, F.col("l_returnflag"))
        .when(F.col("row") % 2 == 0, F.lit(" .. ")).otherwise(F.col("l_linestatus"))
    )
    columns = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))
    return rows.withColumn("col", columns).select(F.col("l_orderkey").alias("table_id"), "row", "col", text.alias("text"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted number of empty cells per table."""
    return (
        table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id")).distinct()
        .withColumn("required", F.col("table_id") % 9)
    )


def form_blocks_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of the form blocks: some texts changed, some blocks gone."""
    return form_blocks(spark, sf_dir).where("block_index % 11 <> 10").withColumn(
        "text",
        F.when(F.col("block_index") % 5 == 0, F.concat(F.col("text"), F.lit(" sửa")))
        .when(F.col("block_index") % 5 == 1, F.concat(F.col("text"), F.lit(" ")))
        .otherwise(F.col("text")),
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model: JSON inside prose, every seventh without braces."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("prompt_id"),
        F.when(F.col("event_id") % 7 == 0, F.lit("```json\nnothing\n```"))
        .otherwise(F.concat(F.lit("text "), F.col("props"), F.lit(" end")))
        .alias("raw"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counters per template and step."""
    return usage_of(table(spark, sf_dir, "events"))


def usage_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("template_id"),
        F.col("event_type").alias("step"),
        (F.col("event_id") % 100).alias("prompt_tokens"),
        (F.col("event_id") % 37).alias("completion_tokens"),
        F.lit(0).cast("bigint").alias("total_tokens"),
    )
