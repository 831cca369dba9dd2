"""Fill conversations as a stream."""

import os
import re
import subprocess
import sys
from datetime import datetime, timedelta

from pyspark.sql import functions as F


from blankweave.operators import drafts as D
from blankweave.streaming import drafts as SD
from blankweave.streaming import fill as SF
from blankweave.streaming.keyed import KeyedTable
from blankweave.streaming.runs import run_append

MESSAGES = "draft_id bigint, seq bigint, ts timestamp, field_name string, value string, is_explicit boolean"
START = datetime(2024, 1, 1)


def feed(spark, folder, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def message(draft, seq, hours, name, value, explicit=False):
    return draft, seq, START + timedelta(hours=hours), name, value, explicit


def drafts(spark, *ids):
    return spark.createDataFrame([(i, ["a", "b"], ["b"] if i == 9 else []) for i in ids], "draft_id bigint, fields array<string>, locked array<string>")


def test_changes_and_final_values(spark, tmp_path):
    first = [message(1, 2, 2, "a", "y"), message(1, 1, 1, "a", "x"), message(9, 1, 1, "a", "")]
    second = [
        message(1, 3, 3, "a", "  "), message(1, 4, 4, "a", "y"), message(1, 5, 5, "a", "", True), message(1, 6, 6, "a", "z"),
        message(9, 2, 3, "a", "q"), message(9, 3, 4, "a", "r"),
    ]
    stream = feed(spark, tmp_path / "in", first, second)
    out = run_append(SD.draft_state(stream, drafts(spark, 1, 9), ttl_ms=10**12), "test").where("kind = 'message'")
    got = {(r.draft_id, r.seq): r.change for r in out.collect()}
    assert got == {
        (1, 1): "updated", (1, 2): "corrected", (1, 3): "ignored", (1, 4): "same", (1, 5): "explicit", (1, 6): "updated",
        (9, 1): "ignored", (9, 2): "updated", (9, 3): "corrected",
    }
    last = {r.draft_id: r for r in out.where("(draft_id = 1 AND seq = 6) OR (draft_id = 9 AND seq = 3)").collect()}
    assert last[1].missing == ["b"] and "«b»" in last[1].message
    assert last[9].missing == [] and last[9].message.startswith("Đã sửa «a»")
    batch = spark.createDataFrame(first + second, MESSAGES)
    assert sorted(SD.state_values(out).collect()) == sorted(D.latest_values(batch).collect())


def test_locked_and_unknown_fields_stay_as_they_are(spark, tmp_path):
    rows = [message(9, 1, 1, "b", "no"), message(9, 2, 2, "zz", "no"), message(9, 3, 3, "a", "yes"), message(9, 4, 4, "b", "typed", True)]
    out = run_append(SD.draft_state(feed(spark, tmp_path / "in", rows[:2], rows[2:]), drafts(spark, 9), ttl_ms=10**12), "test").where("kind = 'message'")
    assert {r.seq: r.change for r in out.collect()} == {1: "ignored", 2: "ignored", 3: "updated", 4: "explicit"}
    batch = spark.createDataFrame(rows, MESSAGES)
    assert sorted((r.field_name, r.value) for r in D.latest_values(batch, drafts(spark, 9)).collect()) == [("a", "yes"), ("b", "typed")]
    assert sorted(SD.state_values(out.withColumn("kind", F.lit("message"))).collect()) == sorted(D.latest_values(batch, drafts(spark, 9)).collect())


def test_python_workers_find_the_package_from_any_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, {repo!r})\n"
        "from blankweave.session import build_session\n"
        "from blankweave.operators import model\n"
        "s = build_session('elsewhere', 'local[1]', spark__ui__enabled='false')\n"
        "out = model.map_model(s.createDataFrame([(1, 'a')], 'prompt_id bigint, prompt string'), lambda: (lambda prompts: ['{{\"k\": 1}}' for _ in prompts]))\n"
        "print('ROWS', out.count())\n"
    ).format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in done.stdout, done.stderr[-800:]


def test_silent_drafts_expire_and_late_messages_are_dropped(spark, tmp_path):
    stream = feed(
        spark, tmp_path / "in",
        [message(1, 1, 0, "a", "x")],
        [message(2, 1, 100, "a", "x")],
        [message(2, 3, 100.5, "a", "x")],
        [message(1, 2, 1, "b", "late"), message(1, 3, 101, "a", "again")],
        [message(2, 2, 102, "b", "x")],
    )
    out = run_append(SD.draft_state(stream, drafts(spark, 1, 2), late_by="2 hours"), "test")
    rows = out.where("draft_id = 1").collect()
    assert [r.seq for r in rows if r.kind == "message"] and {r.seq for r in rows if r.kind == "message"} == {1, 3}
    assert any(r.kind == "expired" and r.ts == START + timedelta(hours=24) for r in rows)
    # The draft starts anew after its expiry.
    assert next(r for r in rows if r.seq == 3).change == "updated"


def test_merging_a_batch_twice_leaves_one_copy(spark, tmp_path):
    changes = spark.createDataFrame(
        [(1, "message", 1, START, "a", "x", "", "updated", [], ["a"], [])], SD.OUT_SCHEMA
    )
    held = KeyedTable(spark, str(tmp_path / "held"), ["draft_id", "field_name"])
    held.upsert(SD.current_values(changes), 0)
    letter = spark.createDataFrame(
        [(5, 0, 0, "text", "Tên:", None, None, None), (5, 0, 1, "field", None, "a", "", "...."), (5, 0, 2, "field", None, "b", "", "....")],
        "template_id bigint, block_index bigint, seg_index bigint, kind string, text string, field_name string, switch string, original_text string",
    )
    requests = spark.createDataFrame([(1, 5)], "draft_id bigint, template_id bigint")
    write = SD.merge_finished_drafts(lambda ids: held.current_of(ids, ["draft_id"]), letter, str(tmp_path / "out"))
    for _ in range(2):
        write(requests, 3)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.record_id, r.text, r.missing) for r in rows] == [(1, "Tên: x ....", ["b"])]


def test_a_keyed_table_keeps_the_last_batch_of_each_key(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    schema = "k bigint, v string"
    table.upsert(spark.createDataFrame([(i, "old") for i in range(200)], schema), 0)
    for _ in range(2):  # a batch that runs again overwrites its rows
        table.upsert(spark.createDataFrame([(1, "new"), (2, None)], schema), 1)
    got = {r.k: r.v for r in table.current().collect()}
    assert len(got) == 200 and got[1] == "new" and got[2] is None and got[3] == "old"
    written = [f for f in (tmp_path / "t" / "_batch=1").rglob("*.parquet")]
    assert len(written) <= 2  # what a batch writes follows the keys it changed
    wanted = spark.createDataFrame([(1,), (7,)], "k bigint")
    few = table.current_of(wanted)
    assert {(r.k, r.v) for r in few.collect()} == {(1, "new"), (7, "old")}
    plan = few._jdf.queryExecution().executedPlan().toString()
    own = {r[0] for r in wanted.select(table._bucket()).collect()}
    assert any(re.search(rf"PartitionFilters: .*_bucket#\d+ (?:IN \({','.join(map(str, order))}\)|= {order[0]}\b)", plan) for order in (sorted(own), sorted(own)[::-1]))
    table.upsert(spark.createDataFrame([(1, "newest")], schema), 2)
    table.compact(1)
    table.compact(1)
    again = {r.k: r.v for r in table.current().collect()}
    assert again == {**got, 1: "newest"} and not (tmp_path / "t" / "_batch=0" / "_run=0").exists()


FILL = "draft_id bigint, seq bigint, ts timestamp, message string, typed_names array<string>, typed_values array<string>"


def fill(spark, folder, *files):
    for i, rows in enumerate(files):
        out = [(d, s, START + timedelta(hours=h), text, list(typed), list(typed.values())) for d, s, h, text, typed in rows]
        spark.createDataFrame(out, FILL).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    stream = spark.readStream.schema(FILL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return SF.with_pairs(stream, ["a", "b", "ngay"])


def test_messages_of_text_fill_drafts_whatever_the_batches(spark, tmp_path):
    """One draft holds most messages; one batch or many give the same rows."""
    rows = [(1, i, i * 0.01, f"A: x{i // 2}; B: {'' if i % 3 else i}; zz: no", {}) for i in range(60)]
    rows += [(9, 1, 0, "b: locked\nA: first; A: last", {}), (9, 2, 1, "a: ; 3/4/2020", {"a": "typed", "c": "free"}), (2, 1, 0, None, {})]
    lists = spark.createDataFrame([(1, ["a", "b"], []), (9, ["a", "b", "ngay"], ["b"]), (2, ["a"], None)], "draft_id bigint, fields array<string>, locked array<string>")
    got = []
    for name, files in (("one", [rows]), ("many", [rows[:20], rows[20:45], rows[45:]])):
        out = run_append(SF.fill_state(fill(spark, tmp_path / name, *files), lists, ttl_ms=10**12), "test")
        got.append({(r.draft_id, r.seq): (r.missing, r.updated, r.corrected) for r in out.where("kind = 'message'").collect()})
        final = {r.draft_id: dict(zip(r.names, r.held)) for r in SF.states(out).collect()}
        assert final[1] == {"a": "x29", "b": "57"} and final[9] == {"a": "typed", "c": "free", "ngay": "3"} and final[2] == {}
    assert got[0] == got[1]
    assert got[0][9, 1] == (["ngay"], ["a"], []) and got[0][9, 2] == ([], ["ngay"], []) and got[0][2, 1] == (["a"], [], [])
    assert got[0][1, 0] == ([], ["a", "b"], []) and got[0][1, 2] == ([], [], ["a"]) and got[0][1, 3] == ([], [], ["b"])


def test_a_silent_draft_begins_anew_inside_a_batch_and_between_batches(spark, tmp_path):
    rows = [(1, 1, 0, "a: x", {}), (1, 2, 30, "a: x", {}), (1, 3, 31, "a: x", {}), (2, 1, 200, "a: y", {})]
    lists = drafts(spark, 1, 2)
    for name, files in (("one", [rows]), ("two", [rows[:1], rows[1:]]), ("four", [[r] for r in rows])):
        out = run_append(SF.fill_state(fill(spark, tmp_path / name, *files), lists, late_by="2 hours"), "test")
        told = {(r.seq, tuple(r.updated)) for r in out.where("kind = 'message' AND draft_id = 1").collect()}
        assert told == {(1, ("a",)), (2, ("a",)), (3, ())}
        gone = sorted(r.ts for r in out.where("kind = 'expired' AND draft_id = 1").collect())
        assert gone == [START + timedelta(hours=24), START + timedelta(hours=55)]


def test_usage_counts(spark):
    rows = [(1, "a", 2, 3, 0), (1, "a", 1, 0, 9), (1, "b", 0, 0, 0)]
    usage = spark.createDataFrame(rows, "template_id bigint, step string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint")
    got = {(r.template_id, r.step): r.total_tokens for r in D.usage_rollup(usage).collect()}
    assert got == {(1, "a"): 14, (1, None): 14, (None, None): 14}


def test_a_stream_reads_a_table_of_one_file_and_of_part_files(spark, data_dir, tmp_path):
    from blankweave.plans.catalog import QUERIES

    text = "Anna Nguyen wrote back."
    rows = [(conv, turn, "user" if turn % 2 == 0 else "assistant", f"{text} {conv} {turn}") for conv in range(6) for turn in range(5)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts, single = tmp_path / "parts", tmp_path / "single"
    table.repartition(3).write.parquet(f"{parts}/conversations.parquet")
    table.coalesce(1).write.parquet(f"{tmp_path}/one")
    single.mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(single / "conversations.parquet")
    for name in ("conversation_values", "fill_conversation"):
        of_parts, of_file = (sorted(QUERIES[name](spark, str(d)).collect()) for d in (parts, single))
        assert of_parts and of_parts == of_file
