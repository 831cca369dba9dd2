"""Shapes of physical plans that have to hold at any size."""

import contextlib
import io
import re

import pytest

from blankweave.operators import fields as FL
from blankweave.plans.catalog import QUERIES
from blankweave.sources import fixtures as X

# These start streams or write when called.
RUNNING = {"draft_state", "draft_merge", "usage_meter", "write_results"}


PLANS: dict[str, str] = {}


def plan_of(name, spark, data_dir) -> str:
    if name not in PLANS:
        PLANS[name] = plan(QUERIES[name](spark, data_dir))
    return PLANS[name]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNNING))
def test_no_pairing_of_everything_with_everything(spark, data_dir, name):
    text = plan_of(name, spark, data_dir)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in text


@pytest.mark.parametrize("name", ["detect_blanks", "strip_blanks", "infer_switch", "is_heading", "slugify", "rule_suggestions"])
def test_row_functions_never_shuffle(spark, data_dir, name):
    assert "Exchange" not in plan_of(name, spark, data_dir)


@pytest.mark.parametrize(
    "name", ["segmentize", "nearest_heading", "merge_continuations", "segment_offsets", "full_text", "annotated_blocks", "convert_forms"]
)
def test_document_queries_shuffle_once(spark, data_dir, name):
    assert len(re.findall(r"^\(\d+\) Exchange", plan_of(name, spark, data_dir), re.M)) == 1


def test_scans_read_only_what_is_needed(spark, data_dir):
    text = plan_of("nearest_heading", spark, data_dir)
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)
    filtered = X.merge_values(spark, data_dir).where("record_id = 7").select("value")
    assert "EqualTo(o_orderkey,7)" in plan(filtered)


def test_a_bucketed_table_needs_no_exchange(spark, data_dir, tmp_path):
    from blankweave.operators.blocks import with_headings
    from blankweave.sources.writers import write_blocks

    spark.sql("DROP TABLE IF EXISTS bucketed_blocks")
    spark.conf.set("spark.sql.legacy.allowNonEmptyLocationInCTAS", "true")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS plan_test LOCATION '{tmp_path}'")
    write_blocks(X.form_lines(spark, data_dir), "plan_test.bucketed_blocks", buckets=4)
    text = plan(with_headings(spark.table("plan_test.bucketed_blocks")))
    assert "Exchange" not in text
    assert "Exchange" not in plan(FL.convert_blocks(spark.table("plan_test.bucketed_blocks")))
    spark.sql("DROP DATABASE plan_test CASCADE")


def test_python_runs_only_where_it_must(spark, data_dir):
    python = re.compile("MapInPandas|FlatMapCoGroups|ArrowEvalPython|BatchEvalPython|FlatMapGroupsIn")
    with_python = {n for n in set(QUERIES) - RUNNING if python.search(plan_of(n, spark, data_dir))}
    assert with_python == set()


@pytest.mark.parametrize(
    "name, most",
    [("rename_field", 4), ("update_text", 2), ("field_context", 2), ("overlay_span_attrs", 4), ("add_field_at", 4), ("apply_suggestions", 11),
     ("delete_range", 3), ("message_changes", 9)],
)
def test_edits_scan_the_corpus_a_few_times(spark, data_dir, name, most):
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan_of(name, spark, data_dir), re.M)) <= most


def test_pairs_of_a_message_are_made_once(spark, data_dir):
    # The pattern of a pair: once for labels and once for values, however often the pairs are compared.
    text = plan_of("rule_extract", spark, data_dir)
    assert 0 < text.count("([^:;\\n]+)") + text.count("([^:;\n]+)") <= 2


def test_adds_meet_segments_by_block_and_not_as_whole_documents(spark, data_dir):
    text = plan_of("add_field_at", spark, data_dir)
    assert "FullOuter" not in text and "Join" not in text


def test_mixed_edits_cut_their_segments_once(spark, data_dir):
    assert "posexplode" not in plan_of("apply_edits", spark, data_dir)


def exchanges(text: str) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", text, re.M))


def joins(text: str) -> int:
    return len(re.findall(r"^\(\d+\) \w*Join", text, re.M))


def test_lines_and_borders_of_tables_stay_where_their_rows_are_dealt(spark, data_dir):
    # rows of lineitem are dealt by table, once for each use of the cells, and cells nowhere again.
    assert exchanges(plan_of("table_grid_lines", spark, data_dir)) == 1
    assert exchanges(plan_of("effective_borders", spark, data_dir)) <= 2


@pytest.mark.parametrize("name, most", [("set_cell_attrs", 1), ("best_matching_cell", 1), ("edit_table_rows", 3), ("edit_table_columns", 3)])
def test_cells_meet_their_edits_and_nothing_else(spark, data_dir, name, most):
    # no join to number rows, and no copies of the small side for slices.
    text = plan_of(name, spark, data_dir)
    assert joins(text) <= most and "_salt" not in text


def test_values_of_a_batch_run_its_messages_once(spark):
    # a second use would run the state again.
    from blankweave.streaming.drafts import OUT_SCHEMA, current_values

    assert len(re.findall(r"^\(\d+\) Scan", plan(current_values(spark.createDataFrame([], OUT_SCHEMA).repartition(3))), re.M)) == 1


def test_cells_to_fill_are_numbered_where_they_are_dealt(spark, data_dir):
    # no join with copies of a table of tables, and no second deal.
    text = plan_of("fill_empty_cells", spark, data_dir)
    assert exchanges(text) == 1 and joins(text) == 0 and "_salt" not in text


def test_suggestions_meet_their_blocks_in_the_document(spark, data_dir):
    # segments are cut once, and no context of a block is moved.
    text = plan_of("suggestion_key_dedup", spark, data_dir)
    assert exchanges(text) == 1 and joins(text) == 0
    assert len(re.findall(r"^\(\d+\) Scan parquet", text, re.M)) == 1


def test_status_of_requests_needs_no_exchange_for_a_level(spark, data_dir):
    # documents, edits and options are dealt by document once each.
    text = plan_of("apply_edits_status", spark, data_dir)
    assert exchanges(text) <= 3
    # The fold is there once: this is an error that only it tells.
    assert text.count("range not found") == 1
