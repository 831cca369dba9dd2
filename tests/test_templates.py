"""Segments, names, merging and reports."""

from pyspark.sql import functions as F

from blankweave.operators import blocks as B
from blankweave.operators import context as C
from blankweave.operators import drafts as D
from blankweave.operators import fields as FL
from blankweave.operators import merge as M
from blankweave.operators import spans as S
from blankweave.operators.ranking import numbered, previous_value, running_total
from blankweave.operators.skew import hot_join, hot_keys, salted_join
from blankweave.plans.merge_queries import letter_fields
from blankweave.sources import fixtures as X

BLOCKS = "doc_id bigint, block_index bigint, text string"


def blocks(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], BLOCKS)


def test_segments_rebuild_the_text(spark, data_dir):
    forms = X.form_blocks(spark, data_dir)
    back = C.shown_blocks(FL.segmentize(forms))
    assert forms.exceptAll(back).count() == 0 and back.exceptAll(forms).count() == 0


def test_offsets_are_contiguous(spark, data_dir):
    segs = FL.convert_blocks(X.form_blocks(spark, data_dir))
    assert segs.where("end_pos - start_pos <> length(text)").count() == 0
    ends = segs.groupBy("doc_id", "block_index").agg(
        F.max("end_pos").alias("e"), F.sum(F.length("text")).alias("n"), F.min("start_pos").alias("s")
    )
    assert ends.where("e <> n OR s <> 0").count() == 0


def test_empty_blocks_survive(spark):
    segs = FL.convert_blocks(blocks(spark, "", "a", "...."))
    assert [(r.block_index, r.text) for r in C.shown_blocks(segs).orderBy("block_index").collect()] == [
        (0, ""), (1, "a"), (2, "«field»"),
    ]


def test_leader_tabs_become_fields(spark):
    df = spark.createDataFrame([(1, 0, "Tên:\t\tlớp ... x", ["dot", "dot"])], BLOCKS + ", tab_leaders array<string>")
    rows = FL.segmentize(df).orderBy("seg_index").collect()
    assert [(r.kind, r.text, r.start_pos) for r in rows] == [
        ("text", "Tên:", 0), ("field", "\t\t", 4), ("text", "lớp", 6), ("field", " ... ", 9), ("text", "x", 14),
    ]


def test_declared_names(spark):
    forms = blocks(
        spark, "Tôi tên: ........ Số CMND: ........", "[Hà Nội], ngày... tháng... năm 20...", "□ Khác: ..................",
        "Đang học lớp: ...", "Lớp: ............ Trường: ............", "Mục 1 Về con chung", "........", "Ghi chú (nếu có): ...",
    )
    named = [r.field_name for r in FL.rule_labels(forms).orderBy("block_index", "seg_index").collect()]
    assert named[10] == "muc_1_ve_con_chung"
    got = [r.field_name for r in FL.rule_labels(forms, max_words=4).orderBy("block_index", "seg_index").collect()]
    assert got == [
        "toi_ten", "so_cmnd", "ngay", "thang", "nam", "field", "khac", "dang_hoc_lop", "lop", "truong",
        "1_ve_con_chung", "ghi_chu",
    ]


def test_continuation_lines(spark):
    forms = blocks(spark, "Tên: ....", "......", "....", "- ......", "....", "x", "......", "y")
    got = [(r.first_block, r.merged_blocks, r.text) for r in B.merge_continuations(forms).orderBy("block_index").collect()]
    assert got == [
        (0, 3, "Tên: .............."), (3, 2, "- .........."), (5, 1, "x"), (6, 1, "......"), (7, 1, "y"),
    ]


def test_tables_do_not_break_a_streak(spark):
    rows = [(1, 0, "Tên: ....", "paragraph"), (1, 1, "....", "table_cell"), (1, 2, "....", "paragraph")]
    df = spark.createDataFrame(rows, BLOCKS + ", type string")
    got = [(r.text, r.type) for r in B.merge_continuations(df).orderBy("block_index").collect()]
    assert got == [("Tên: ........", "paragraph"), ("....", "table_cell")]


def test_rename_and_back_is_identity(spark, data_dir):
    segs = FL.convert_blocks(X.form_blocks(spark, data_dir)).cache()
    names = segs.where("field_name = 'field'").select("doc_id").distinct()
    there = names.selectExpr("doc_id", "'field' AS old_name", "'moi' AS new_name", "cast(null AS bigint) AS occurrence_index")
    back = names.selectExpr("doc_id", "'moi' AS old_name", "'field' AS new_name", "cast(null AS bigint) AS occurrence_index")
    once, _ = S.rename_field(segs, there, keep_switch=True)
    twice, _ = S.rename_field(once, back, keep_switch=True)
    assert segs.exceptAll(twice).count() == 0
    segs.unpersist()


def test_rendering_equals_merged_values(spark, data_dir):
    """Without padding spaces the rendered text is the merged values between the texts."""
    records, letters = X.records(spark, data_dir), X.letter_templates(spark, data_dir)
    values, locks = X.merge_values(spark, data_dir), X.locks(spark, data_dir)
    merged = M.merge_values(records, letter_fields(spark, data_dir), values, locks)
    texts = M.with_template(records, letters.where("kind = 'text'")).select(
        "record_id", "block_index", "seg_index", F.col("text").alias("shown")
    )
    pieces = merged.select("record_id", "block_index", "seg_index", "shown").unionByName(texts)
    plain = pieces.groupBy("record_id", "block_index").agg(
        F.array_sort(F.collect_list(F.struct("seg_index", "shown"))).alias("p")
    ).select("record_id", "block_index", F.replace(F.array_join("p.shown", ""), F.lit(" "), F.lit("")).alias("text"))
    shown = M.render_blocks(records, letters, values, locks).select(
        "record_id", "block_index", F.replace("text", F.lit(" "), F.lit("")).alias("text")
    )
    assert plain.exceptAll(shown).count() == 0 and shown.exceptAll(plain).count() == 0


def test_merge_keeps_original_and_ignores_extra(spark):
    records = spark.createDataFrame([(1, 7)], "record_id bigint, template_id bigint")
    fields = spark.createDataFrame(
        [(7, 0, 0, "ho_ten", "\\* Upper", "...."), (7, 0, 1, "so_cmnd", "\\* Caps", "...."), (7, 0, 2, "ck_a", "", "□"),
         (7, 0, 3, "khoa", "", "abc")],
        "template_id bigint, block_index bigint, seg_index bigint, field_name string, switch string, original_text string",
    )
    values = spark.createDataFrame(
        [(1, "ho_ten", "nguyễn a"), (1, "extra", "x"), (1, "ck_a", " X "), (1, "khoa", "bỏ")],
        "record_id bigint, field_name string, value string",
    )
    locks = spark.createDataFrame([(1, "khoa")], "record_id bigint, field_name string")
    got = {r.field_name: r.shown for r in M.merge_values(records, fields, values, locks).collect()}
    assert got == {"ho_ten": "NGUYỄN A", "so_cmnd": "....", "ck_a": "☑", "khoa": "abc"}
    wanted = M.record_fields(records, fields)
    assert [r.field_name for r in M.missing_fields(wanted, values, locks).collect()] == ["so_cmnd"]


def test_status_messages(spark):
    many = [f"f{i}" for i in range(10)]
    rows = [(many, [], []), ([], many, []), ([], [], many), ([], [], []), (["a"], ["b"], []), (["a"], ["b"], ["c"])]
    df = spark.createDataFrame(rows, "m array<string>, u array<string>, c array<string>")
    whole = [r[0] for r in df.select(M.status_message(F.col("m"), F.col("u"), F.col("c"))).collect()]
    assert whole[0].endswith("«f8», «f9».") and "«f9»" in whole[2]
    limited = M.status_message(F.col("m"), F.col("u"), F.col("c"), missing_shown=8, corrected_shown=5)
    got = [r[0] for r in df.select(limited).collect()]
    assert got[0].endswith("«f7» và 2 field khác.") and "«f8»" not in got[0]
    assert got[1].startswith("Đã đủ thông tin")
    assert "«f4» và 5 field khác" in got[2] and "«f5»" not in got[2]
    assert got[3].startswith("Các thông tin bắt buộc")
    assert got[4].startswith("Đã ghi nhận") and got[5].startswith("Đã sửa «c». ")


def test_hot_joins_split_hot_keys_and_no_others(spark):
    """One key holds two thirds of the rows, others few; some rows have no key."""
    many = spark.range(9000).selectExpr("id", "CASE WHEN id % 50 = 7 THEN NULL WHEN id % 3 < 2 THEN 1 ELSE id % 700 END AS k", "id % 5 AS v")
    few = spark.range(400).selectExpr("id AS k", "id * 10 AS w").unionByName(spark.createDataFrame([(1, -1)], "k bigint, w bigint"))
    for how in ("inner", "left", "left_semi"):
        ours = hot_join(many, few, ["k"], F.col("id"), how, slice_rows=500)
        plain = many.join(few, ["k"], how)
        assert sorted(ours.columns) == sorted(plain.columns)
        assert ours.select(plain.columns).exceptAll(plain).count() == 0 and ours.count() == plain.count()
    hot = hot_keys(many, ["k"], slice_rows=500)
    assert [(r.k, r._slices > 8) for r in hot.collect()] == [(1, True)]
    assert hot_keys(many, ["k"], slice_rows=3, most=20).count() == 20
    copies = few.join(hot, "k", "left").selectExpr("explode(sequence(1, coalesce(_slices, 1)))")
    assert copies.count() < few.count() + 40


def test_running_totals_and_bands_of_a_hot_key(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 < 2 THEN 1 ELSE id % 9 END AS k", "id AS n", "id % 13 AS v").cache()
    ours = running_total(rows, ["k"], F.floor(F.col("n") / 100), ["n"], F.col("v"), "before").select("k", "n", "before")
    plain = rows.selectExpr("k", "n", "coalesce(sum(v) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    assert ours.exceptAll(plain).count() == 0 and ours.count() == 6000
    # A busy minute holds most messages of one draft; bands follow the messages, not the clock.
    messages = rows.selectExpr(
        "k AS draft_id", "n AS seq", "timestamp_micros(1700000000000000 + CASE WHEN n < 5000 THEN n * 10000 DIV 30 * 30 ELSE n * 60000000 END) AS ts",
        "concat('f', v % 3) AS field_name", "CASE WHEN v = 5 THEN '' ELSE string(v) END AS value", "v = 7 AS is_explicit",
    )
    whole, cut = (D.message_changes(messages, depth=depth).select("draft_id", "seq", "old_value", "change") for depth in (10**6, 100))
    assert whole.exceptAll(cut).count() == 0 and cut.count() == 6000
    edges = D.time_bands(messages, 100).where("draft_id = 1").join(messages, "draft_id").selectExpr("size(filter(_edges, e -> e < unix_micros(ts))) AS b")
    assert edges.groupBy("b").count().agg(F.max("count")).first()[0] < 4000 * 4 / D.BANDS


def test_hot_keys_give_the_same_rows_as_plain_operators(spark):
    """One key holds most rows: numbering, carried values and salted joins stay exact."""
    rows = spark.range(5000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN id ELSE 1 END AS k", "id DIV 100 AS band", "id AS at",
        "CASE WHEN id % 4 = 0 THEN string(id) END AS v",
    ).cache()
    ours = numbered(rows, ["k"], ["band"], ["band", "at"], "n").select("at", "n")
    plain = rows.selectExpr("at", "bigint(row_number() OVER (PARTITION BY k ORDER BY at)) AS n")
    assert ours.exceptAll(plain).count() == 0 and ours.count() == 5000
    ours = previous_value(rows, ["k"], "band", ["at"], F.col("v"), "p").select("at", "p")
    plain = rows.selectExpr(
        "at", "last(v, true) OVER (PARTITION BY k ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p"
    )
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0
    few = spark.range(10).selectExpr("id AS k", "id * 2 AS w")
    for how in ("inner", "left", "left_semi"):
        ours = salted_join(rows, few, ["k"], F.col("at"), how=how)
        plain = rows.join(few, "k", how)
        columns = sorted(plain.columns)
        assert ours.select(columns).exceptAll(plain.select(columns)).count() == 0
        assert ours.count() == plain.count()
    rows.unpersist()


def test_date_line(spark):
    forms = blocks(spark, "«a», ngày «b» tháng «c» năm «d»", "«b», ngày «x» tháng «c» năm «nam_lam_don»")
    fields = spark.createDataFrame([(1, n) for n in ("a", "b", "c", "d")], "doc_id bigint, field_name string")
    got = {r.old_name: r.new_name for r in FL.date_line_renames(forms, fields).collect()}
    assert got == {"a": "dia_diem_lam_don", "b": "dia_diem_lam_don", "c": "thang_lam_don", "d": "nam_lam_don"}


def test_skewed_and_even_keys_count_alike(spark):
    from blankweave.operators.ranking import numbered, running_total

    rows = spark.range(600).selectExpr("CASE WHEN id < 500 THEN 1 WHEN id < 590 THEN id END AS k", "CASE WHEN id % 50 <> 7 THEN id DIV 20 END AS band", "id AS at", "id % 5 AS v")
    sliced, plain = (numbered(rows, ["k"], ["band"], ["band", "at"], "n", most).collect() for most in (10, 4096))
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, plain)) and len(plain) == 578
    sliced, plain = (running_total(rows, ["k"], F.floor(F.col("at") / 20), ["at"], F.col("v"), "n", most).select("at", "n").collect() for most in (10, 4096))
    assert sorted(sliced) == sorted(plain) and len(plain) == 590


def test_suggestions_in_rows_are_attached_and_deduped_as_others(spark):
    """Suggestions and edits that travel in the rows of blocks, against those in tables of their own."""
    rows = [(doc, i, f"text {doc} {i}") for doc in (1, 2, None) for i in range(5)]
    around = B.with_neighbours(spark.createDataFrame(rows, BLOCKS))
    made = [("0", "a", 3), ("0", "b", 1), ("3", "c", 2), ("9", "far", 1), ("x", "none", 1), ("-1", "less", 1), (None, "null", 0)]
    own = F.array(*[F.struct(F.lit(r).cast("string").alias("raw_index"), F.concat(F.lit(n), F.col("block_index")).alias("suggested_name"), (F.lit(i) * 10 + F.col("block_index")).alias("suggestion_id")) for r, n, i in made])
    carried = around.withColumn("own", F.when(F.col("block_index") < 3, own).otherwise(F.array().cast("array<struct<raw_index:string,suggested_name:string,suggestion_id:bigint>>")))
    table = carried.select("doc_id", F.explode("own").alias("s")).select("doc_id", "s.*")
    other = lambda df: df.withColumn("insert_after", F.lit(None).cast("string")).withColumn("position", F.lit("right"))
    by_rows, by_table = other(C.attach_suggestions(F.col("own"), carried)), other(C.attach_suggestions(table, around))
    columns = sorted(by_table.columns)
    assert by_table.count() == 2 * 9
    assert sorted(map(repr, by_rows.select(columns).collect())) == sorted(map(repr, by_table.select(columns).collect()))
    edit = F.when(F.col("block_index") == 0, F.struct(F.lit("neu").alias("suggested_name"), F.lit(None).cast("string").alias("position")))
    edits = by_table.select("doc_id", C.suggestion_key().alias("suggestion_key"), edit.alias("e")).where("e IS NOT NULL").select("doc_id", "suggestion_key", "e.*").distinct()
    names = ["doc_id", "block_index", "suggested_name", "suggestion_id", "position"]
    single = C.dedup_suggestions(by_table, edits).select(names)
    short = by_rows.withColumn("suggestion_key", C.suggestion_key()).drop("context", "before_context", "after_context")
    assert sorted(C.dedup_suggestions(short, edit).select(names).collect()) == sorted(single.collect())
    assert {(r.block_index, r.suggested_name) for r in single.collect()} == {(0, "neu"), (3, "c0")}


def test_empty_cells_of_small_and_large_tables_are_numbered(spark):
    from blankweave.operators import tables as G

    cells = [(1, 0, 0, ""), (2, 0, 0, ""), (2, 1, 0, " .. "), (2, 1, 1, "a"), (2, 2, 1, None), (None, 1, 0, "")]
    cells += [(3, i, 0, "x" if i % 3 else "") for i in range(6000)]
    df = spark.createDataFrame(cells, "table_id bigint, row bigint, col bigint, text string")
    found = {(r.table_id, r.row, r.col): r.field_name for r in G.fill_empty_cells(df.where("table_id < 3 OR table_id IS NULL")).collect()}
    assert found == {(2, 1, 0): "field", (2, 2, 1): "field_2"}
    large = {(r.table_id, r.row): r.field_name for r in G.fill_empty_cells(df).where("table_id = 3").collect()}
    assert large == {(3, i): "field" if i == 3 else f"field_{i // 3}" for i in range(3, 6000, 3)}
