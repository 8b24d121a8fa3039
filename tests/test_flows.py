"""Merging, responses, lifecycle, sources."""

import json

import pytest
from pyspark.sql import functions as F

from docfields.functions import materialize as stored
from docfields.operators import filters, joins, lifecycle, merge, reports, responses
from docfields.plans.extraction import extract_forms
from docfields.sources import documents, templates

RESULT = "entry_id int, field_name string, value string, confidence double, source string"


def test_merge_primary_fallback(spark):
    p = spark.createDataFrame([(1, "a", "x", 0.9, "p"), (1, "b", "", 0.8, "p"), (1, "c", "x", 0.3, "p"), (1, "d", "", 0.0, "p")], RESULT)
    f = spark.createDataFrame([(1, "a", "y", 0.8, "f"), (1, "b", "y", 0.9, "f"), (1, "c", "y", 0.4, "f"), (1, "e", "y", 0.1, "f")], RESULT)
    got = {r.field_name: (r.value, r.source) for r in merge.merge_primary_fallback(p, f).collect()}
    assert got == {"a": ("x", "p"), "b": ("y", "f"), "c": ("y", "f"), "d": ("", "p"), "e": ("y", "f")}


def test_merge_multi_pass(spark):
    one = spark.createDataFrame([(1, "reg_type_new", "maybe", 0.55), (1, "name", "JUAN", 0.88), (1, "dob", "", 0.3), (1, "cert", "??", 0.35)],
                                "entry_id int, field_name string, value string, confidence double")
    two = spark.createDataFrame([(1, "dob", "1990-01-15", 0.75), (1, "address", "123 Main", 0.72), (1, "cert", "2024-001", 0.68)],
                                "entry_id int, field_name string, value string, confidence double")
    det = spark.createDataFrame([(1, "reg_type_new", "checked", 0.95)], "entry_id int, name string, state string, confidence double")
    got = {r.field_name: (r.value, r.confidence) for r in merge.merge_multi_pass(one, two, det).collect()}
    assert got == {"reg_type_new": ("true", 0.95), "name": ("JUAN", 0.88), "dob": ("1990-01-15", 0.75), "address": ("123 Main", 0.72), "cert": ("2024-001", 0.68)}


def response_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "entry_id int, response_text string")


def test_flat_responses(spark):
    df = response_frame(spark, ['{"a": "Yes", "b": 0, "c": "0", "d": null, "e": 12, "f": "no"}', '```json\n{"a": "x1"}\n```', 'Sure: {"a": "q"}',
                                '{"a": "one", "b": "tw', "nope", '[1, 2]'])
    fields, rejects = responses.parse_flat_responses(df)
    got = {(r.entry_id, r.field_name): (r.value, r.confidence) for r in fields.collect()}
    assert got == {(0, "a"): ("true", 0.85), (0, "b"): ("", 0.0), (0, "c"): ("0", 0.85), (0, "d"): ("", 0.0), (0, "e"): ("12", 0.85), (0, "f"): ("no", 0.85),
                   (1, "a"): ("x1", 0.85), (2, "a"): ("q", 0.85)}
    assert sorted(r.entry_id for r in rejects.collect()) == [3, 4, 5]
    repaired = responses.parse_flat_responses(df, repair=True)[0].filter("entry_id = 3").collect()
    assert [(r.field_name, r.value) for r in repaired] == [("a", "one")]


def test_list_responses(spark):
    body = json.dumps({"extracted_fields": [{"field_name": " a ", "value": " v ", "confidence": 1.7}, {"field_name": "b", "confidence": "0.4"},
                                            {"value": "nameless"}, {"field_name": "c", "value": "x", "confidence": [1]}]})
    fields, rejects = responses.parse_list_responses(response_frame(spark, [body, '{"other": 1}', '["a"]']))
    assert [(r.field_name, r.value, r.confidence) for r in fields.orderBy("pos").collect()] == [("a", "v", 1.0), ("b", "", 0.4), ("c", "x", 0.5)]
    assert rejects.count() == 2 and rejects.columns == response_frame(spark, []).columns
    # The text is taken out of its fence once a response.
    assert fields._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_escape_control_characters(spark):
    texts = ["a\nb", "\t\r", "plain", "\x1f ", "é\x00"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", responses.escape_control_characters(F.col("t")).alias("e"))
    assert [r.e for r in df.orderBy("i").collect()] == ["a\\u000ab", "\\u0009\\u000d", "plain", "\\u001f ", "é\\u0000"]


def test_verifications_apply_in_time_order(spark):
    entries = spark.createDataFrame([(1, 10, "extracted", None), (2, 10, "uploaded", None), (3, 11, "verified", 5)], "entry_id int, uploaded_by int, status string, verified_by int")
    fields = spark.createDataFrame([(1, "a", "x", None, False), (1, "b", None, None, False), (1, "c", "z", None, False)],
                                   "entry_id int, field_name string, ocr_value string, verified_value string, was_corrected boolean")
    users = spark.createDataFrame([(10, "encoder"), (99, "admin")], "user_id int, role string")
    subs = spark.createDataFrame([(1, 10, {"a": "first", "b": "w"}, "2024-01-01 00:00:00"), (1, 99, {"a": "x"}, "2024-01-02 00:00:00"), (2, 10, {"a": "x"}, "2024-01-02 00:00:00"),
                                  (3, 10, {"a": "x"}, "2024-01-02 00:00:00"), (4, 99, {"a": "x"}, "2024-01-02 00:00:00")],
                                 "entry_id int, verifier_id int, verified_fields map<string,string>, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = lifecycle.apply_verifications(entries, fields, subs, users)
    got = {r.field_name: (r.verified_value, r.was_corrected) for r in out["fields"].collect()}
    assert got == {"a": ("x", False), "b": ("w", True), "c": (None, False)}
    assert {r.entry_id: (r.status, r.verified_by) for r in out["entries"].collect()} == {1: ("verified", 99), 2: ("uploaded", None), 3: ("verified", 5)}
    assert {r.entry_id: r.reason for r in out["rejects"].collect()} == {2: "wrong status", 3: "not the uploader", 4: "entry not found"}
    assert out["audit_log"].count() == 2


def test_validate_field_records(spark):
    df = spark.createDataFrame([(1, " a ", None, 0.5), (2, " ", "x", 0.5), (2, "b", "x", 0.5), (3, "c", "x", 1.5)], "entry_id int, field_name string, ocr_value string, confidence double")
    clean, bad = filters.validate_field_records(df)
    assert [(r.entry_id, r.field_name, r.ocr_value) for r in clean.collect()] == [(1, "a", "")]
    assert {r.violation for r in bad.collect()} == {"blank name", "confidence out of range"}


def test_template_schema(spark):
    rows = [(1, "t1", json.dumps({"fields": [{"name": "first_name"}, {"name": "b", "type": "date", "extraction": {"search_region": {"x_max": 0.5}}}]})),
            (2, "t2", '{"fields": []}'), (3, "t3", json.dumps({"fields": [{"name": "a", "extraction": {"strategy": "guess"}}]})),
            (4, "t4", json.dumps({"fields": [{"name": "a", "extraction": {"search_region": {"x_min": 1.5}}}]})), (5, "t5", "?"), (6, "t6", '{"fields": [{"type": "text"}]}')]
    fields, rejects = templates.explode_template_fields(spark.createDataFrame(rows, "template_id int, name string, field_schema string"))
    got = fields.orderBy("field_pos").collect()
    assert [(r.label, r.type, r.strategy, r.region.x_max) for r in got] == [("First Name", "text", "label_nearby", 1.0), ("B", "date", "label_nearby", 0.5)]
    assert sorted(r.template_id for r in rejects.collect()) == [2, 3, 4, 5, 6]


def test_detections_round_trip(spark, tmp_path):
    folder = tmp_path / "entry-7"
    folder.mkdir()
    (folder / "checkbox_detection.json").write_text(json.dumps({"total_checkboxes_detected": 2, "checkboxes": [
        {"name": "a", "state": "checked", "confidence": 0.9, "anchor_text": "A", "bbox": {"top": 1, "left": 2, "bottom": 3, "right": 4, "width": 2, "height": 2}},
        {"name": "b", "state": "unclear", "confidence": 0.5, "anchor_text": "", "bbox": None}]}, indent=2))
    rows = documents.read_detections(spark, str(tmp_path)).orderBy("det_no").collect()
    assert [(r.entry_id, r.name, r.state) for r in rows] == [("entry-7", "a", "checked"), ("entry-7", "b", "unclear")]
    assert tuple(rows[0].box) == (1.0, 2.0, 3.0, 4.0) and rows[1].box is None


def test_image_catalogue(spark, tmp_path):
    for name, head in (("a.png", b"\x89PNG\r\n"), ("b.jpg", b"\xff\xd8\xff"), ("c.pdf", b"%PDF-1"), ("d.bin", b"zz")):
        path = tmp_path / "forms" / "2024" / "03" / "e1" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(head)
    rows = {r.path[-5:]: r for r in documents.catalog_images(spark, str(tmp_path)).collect()}
    assert {k: r.mime for k, r in rows.items()} == {"a.png": "image/png", "b.jpg": "image/jpeg", "c.pdf": "application/pdf", "d.bin": "application/octet-stream"}
    assert (rows["a.png"].entry_id, rows["a.png"].year, rows["a.png"].month) == ("e1", 2024, 3)


def test_extract_forms(spark):
    schema = json.dumps({"fields": [{"name": "first_name", "label": "Name", "required": True}, {"name": "certificate_no", "label": "Certificate"},
                                    {"name": "birth", "label": "Born", "type": "date"}]})
    tables = {
        "entries": spark.createDataFrame([(1, 1, "processing", 0.0), (2, 9, "uploaded", 0.0)], "entry_id long, template_id long, status string, confidence_score double"),
        "lines": spark.createDataFrame([(1, 0, "Name: MARIA", 0.9, (0.0, 0.0, 9.0, 90.0)), (1, 1, "Certificate: NR0 052018", 0.6, (20.0, 0.0, 29.0, 90.0))],
                                       "entry_id long, line_no long, text string, confidence double, box struct<top:double,left:double,bottom:double,right:double>"),
        "templates": spark.createDataFrame([(1, "DTI form", schema)], "template_id long, name string, field_schema string"),
        "model_responses": spark.createDataFrame([(1, '{"fields": {"birth": {"value": "June 15, 1985", "confidence": 0.7}, "first_name": {"value": "X", "confidence": 1}}}')],
                                                 "entry_id long, response_text string"),
        "old_fields": spark.createDataFrame([(1, "stale", "x", 0.1, "old", False), (2, "kept", "y", 0.2, "old", False)],
                                            "entry_id long, field_name string, ocr_value string, confidence double, source string, was_corrected boolean"),
    }
    out = extract_forms(**tables)
    got = {(r.entry_id, r.field_name): (r.ocr_value, pytest.approx(r.confidence)) for r in out["fields"].collect()}
    assert got == {(1, "first_name"): ("MARIA", 0.95), (1, "certificate_no"): ("NR0:052018", 0.9), (1, "birth"): ("15/06/1985", 0.8),
                   (1, "owner_name_composite"): ("Maria", 0.8), (2, "kept"): ("y", 0.2)}
    entries = {r.entry_id: (r.status, r.field_count) for r in out["entries"].collect()}
    assert entries == {1: ("extracted", 4), 2: ("uploaded", None)}


def test_extract_forms_gives_up_what_later_steps_do_not_read(spark):
    """Of many entries without lines only few are dealt out by field, and stored steps go when the next is stored."""
    schema = json.dumps({"fields": [{"name": f"field_{i}", "label": f"Label {i}"} for i in range(12)]})
    lines = spark.createDataFrame([(1, 0, "Label 3: MARIA", 0.9, None)], "entry_id long, line_no long, text string, confidence double, "
                                  "box struct<top:double,left:double,bottom:double,right:double>")
    tables = {
        "entries": spark.range(1, 2001).selectExpr("id AS entry_id", "1L AS template_id", "'uploaded' AS status", "0.0D AS confidence_score").union(
            spark.createDataFrame([(None, 1, "uploaded", 0.0)], "entry_id long, template_id long, status string, confidence_score double")),
        "lines": lines,
        "templates": spark.createDataFrame([(1, "form", schema)], "template_id long, name string, field_schema string"),
        "model_responses": spark.range(1, 2001).selectExpr("id AS entry_id", """'{"fields": {"field_5": {"value": "x", "confidence": 0.7}}}' AS response_text"""),
        "old_fields": spark.createDataFrame([], "entry_id long, field_name string, ocr_value string, confidence double, source string, was_corrected boolean"),
    }
    before = set(stored._written)
    out = extract_forms(**tables)
    kept = [p for p in stored._written if p not in before]
    assert not [p for p in kept if "unresolved" in spark.read.parquet(p).columns]
    assert len([p for p in kept if spark.read.parquet(p).count() > 20_000]) == 1
    got = out["fields"].groupBy("field_name", "ocr_value").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("field_3", "MARIA"): 1, ("field_3", ""): 1999, ("field_5", "x"): 2000} | {
        (f"field_{i}", ""): 2000 for i in range(12) if i not in (3, 5)}


def test_hot_copies_meet_one_store_row(spark):
    images = spark.range(3000).selectExpr("id AS entry_id", "1 AS template_id", "IF(id % 3 = 0, 'hot', string(id)) AS md5", "TIMESTAMP '2024-01-01 01:00:00' AS created_at")
    store = spark.range(500).selectExpr("1 AS template_id", "'hot' AS md5", "TIMESTAMP '2024-01-01 00:30:00' AS stored_at", "string(id) AS result")
    hits, misses = lifecycle.reuse_results(images, store)
    assert (hits.count(), misses.count()) == (1000, 2000)
    assert lifecycle.reuse_results(images, store, 60)[0].count() == 0


def test_tables_round_trip(spark, tmp_path):
    from docfields.operators.reports import training_export
    from docfields.sources.documents import export_training_data
    from docfields.sources.tables import read_tables, write_table

    entries = spark.createDataFrame([(1, 7, "verified", "i.png"), (2, 8, "archived", "j.png"), (3, 7, "uploaded", "k.png")],
                                    "entry_id long, template_id long, status string, image_url string")
    fields = spark.createDataFrame([(1, "a", "x", "y", True, 0.5), (1, "b", None, None, False, 0.6), (2, "a", "x", "x", False, 0.7)],
                                   "entry_id long, field_name string, ocr_value string, verified_value string, was_corrected boolean, confidence double")
    for name, df in (("entries", entries), ("fields", fields)):
        write_table(df, str(tmp_path), name)
    tables = read_tables(spark, str(tmp_path), ["entries", "fields"])
    assert tables["entries"].count() == 3 and tables["fields"].columns[0] == "entry_id"
    templates = spark.createDataFrame([(7, "T7")], "template_id long, name string")
    export = training_export(tables["entries"], tables["fields"], templates)
    export_training_data(export, f"{tmp_path}/out")
    got = {r.entry_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1].template_name == "T7" and got[2].template_name == "Unknown" and got[1].template_id == 7
    assert [f.ocr_value for f in got[1].fields] == ["x", ""]
    assert training_export(tables["entries"], tables["fields"], templates, corrected_only=True).count() == 1


def test_detection_documents_read_back(spark, tmp_path):
    det = spark.createDataFrame([("e1", 0, "a", "checked", 0.91234, (1.0, 2.0, 3.0, 4.0), "A"), ("e1", 1, "b", "unclear", 0.5, None, "B")],
                                "entry_id string, det_no int, name string, state string, confidence double, "
                                "box struct<top:double,left:double,bottom:double,right:double>, anchor_text string")
    documents.detection_documents(det).drop("entry_id").coalesce(1).write.json(f"{tmp_path}/e1")
    back = documents.read_detections(spark, str(tmp_path)).orderBy("det_no").collect()
    assert [(r.entry_id, r.name, r.confidence) for r in back] == [("e1", "a", 0.912), ("e1", "b", 0.5)]


def test_verified_data_of_other_entries_stays(spark):
    entries = spark.createDataFrame(
        [(1, 5, "extracted", None, None), (2, 5, "verified", 7, {"a": "kept"})],
        "entry_id bigint, uploaded_by bigint, status string, verified_by bigint, verified_data map<string,string>")
    fields = spark.createDataFrame([(1, "a", "x", None, False)], "entry_id bigint, field_name string, ocr_value string, verified_value string, was_corrected boolean")
    given = spark.sql("select 1L entry_id, 5L verifier_id, map('a', 'y') verified_fields, timestamp'2024-01-01' ts")
    users = spark.createDataFrame([(5, "encoder")], "user_id bigint, role string")
    done = lifecycle.apply_verifications(entries, fields, given, users)["entries"]
    assert {r.entry_id: r.verified_data for r in done.collect()} == {1: {"a": "y"}, 2: {"a": "kept"}}


def test_results_are_reused_as_of_the_image(spark):
    images = spark.sql("""select * from values (1L, 1L, 'm', timestamp'2024-01-01 00:10:00'), (2L, 1L, 'm', timestamp'2024-01-01 05:59:59'),
      (3L, 1L, 'm', timestamp'2024-01-01 06:00:00'), (4L, 1L, null, timestamp'2024-01-01 00:10:00'), (5L, 2L, 'm', timestamp'2024-01-01 00:10:00')
      as t(entry_id, template_id, md5, created_at)""")
    stored = spark.sql("""select * from values (1L, 'm', timestamp'2024-01-01 00:00:00', 'old'), (1L, 'm', timestamp'2024-01-01 05:00:00', 'new'),
      (1L, null, timestamp'2024-01-01 00:00:00', 'none') as t(template_id, md5, stored_at, result)""")
    hits, misses = lifecycle.reuse_results(images, stored)
    assert {(r.entry_id, r.result) for r in hits.collect()} == {(1, "old"), (2, "new")}
    assert {r.entry_id for r in misses.collect()} == {3, 4, 5}


def test_several_answers_for_a_field_give_one_row(spark):
    base = spark.createDataFrame([(1, "a", "", 0.1, "deterministic", True)], "entry_id bigint, field_name string, value string, confidence double, source string, unresolved boolean")
    answers = spark.createDataFrame([(1, "a", "first", 0.9, 1), (1, "a", "second", 0.5, 2)], "entry_id bigint, field_name string, value string, confidence double, pass_no int")
    assert [(r.value, r.confidence) for r in merge.merge_ai_into_deterministic(base, answers).collect()] == [("second", 0.5)]
    weak = spark.createDataFrame([(1, "a", "old", 0.1)], "entry_id bigint, field_name string, ocr_value string, confidence double")
    again = responses.reextract_low_confidence(weak, answers.select("entry_id", "field_name", "value", "pass_no")).collect()
    assert [(r.ocr_value, r.reextracted) for r in again] == [("second", True)]
    given = spark.sql("select 1L entry_id, explode(array(named_struct('m', map('a', 'x'), 'ts', 1), named_struct('m', map('a', 'y'), 'ts', 2))) s").selectExpr("entry_id", "s.m verified_fields", "s.ts ts")
    assert [r.new_value for r in joins.fields_with_verified_values(weak, given).collect()] == ["y"]


def test_roll_up_takes_repeated_names(spark):
    entries = spark.createDataFrame([(1,)], "entry_id bigint")
    rows = spark.createDataFrame([(1, "a", "x", 0.9, "ai"), (1, "a", "y", 0.2, "rules"), (1, "b", "", 0.5, None)],
                                 "entry_id bigint, field_name string, ocr_value string, confidence double, source string")
    done = reports.rollup_entry(entries, rows).first()
    assert done.field_sources == {"a": "ai", "b": None} and done.field_count == 3 and done.filled_count == 2


def test_quoted_confidences_are_no_numbers(spark):
    body = '{"fields": {"a": {"value": "x", "confidence": "0.9"}, "b": {"value": "y", "confidence": 0.9}, "c": {"value": "z"}}}'
    rows = responses.parse_wrapped_responses(spark.createDataFrame([(1, body)], "entry_id bigint, response_text string"))[0]
    assert {r.field_name: r.confidence_raw for r in rows.collect()} == {"a": '"0.9"', "b": "0.9", "c": None}


def test_every_line_is_in_a_preview(spark):
    fields = spark.createDataFrame([(1, 3, "a", True, None)], "entry_id bigint, template_id bigint, field_name string, unresolved boolean, context_lines array<string>")
    schema = spark.createDataFrame([(3, "a", 0, "A", "text", None, None)], "template_id bigint, name string, field_pos int, label string, type string, options array<string>, ai_prompt_hint string")
    lines = spark.range(201).selectExpr("1L entry_id", "id line_no", "'t' || id text", "0.5D confidence")
    got = responses.resolution_requests(fields, schema, lines).collect()
    assert sorted(r.preview_no for r in got) == [0, 1, 2]
    assert sum(len(r.ocr_preview.split("\n")) for r in got) == 201


def test_users_of_entries_without_verifier(spark):
    entries = spark.createDataFrame([(1, 5, None), (2, 5, 6), (3, 9, None)], "entry_id bigint, uploaded_by bigint, verified_by bigint")
    users = spark.createDataFrame([(5, "E"), (6, "V")], "user_id bigint, full_name string")
    got = joins.entries_with_users(entries, users).collect()
    assert {(r.entry_id, r.uploader_name, r.verifier_name) for r in got} == {(1, "E", None), (2, "E", "V"), (3, None, None)}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from docfields import session

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster)


def test_stored_tables_are_released(spark):
    import os

    from docfields.functions import materialize as m

    before, m._written[:] = list(m._written), []
    m.materialize(spark.range(3))
    path = m._written[0]
    assert os.path.isdir(path) and m.release(spark) == 1 and not os.path.exists(path)
    m._written[:] = before


def test_retries_of_users(spark):
    entries = spark.createDataFrame([(1, 7, "uploaded"), (2, 8, "PROCESSING"), (3, 7, "extracted"), (4, None, "uploaded")],
                                    "entry_id bigint, uploaded_by bigint, status string")
    fields = spark.createDataFrame([(i, "f") for i in (1, 2, 3, 4)], "entry_id bigint, field_name string")
    users = spark.createDataFrame([(7, "encoder"), (9, "admin")], "user_id bigint, role string")
    asked = spark.createDataFrame([(1, 7), (2, 7), (2, 9), (3, 7), (4, 7), (5, 9), (1, 99)], "entry_id bigint, user_id bigint")
    done = lifecycle.retry_requests(entries, fields, asked, users)
    assert sorted((r.entry_id, r.user_id, r.reason) for r in done["rejects"].collect()) == [
        (1, 99, "not the uploader"), (2, 7, "not the uploader"), (3, 7, "cannot retry in status extracted"),
        (4, 7, "not the uploader"), (5, 9, "entry not found")]
    assert sorted((r.entry_id, r.status) for r in done["entries"].collect()) == [(1, "uploaded"), (2, "uploaded"), (3, "extracted"), (4, "uploaded")]
    assert sorted(r.entry_id for r in done["fields"].collect()) == [3, 4]


def test_pages_continue_behind_a_row(spark):
    from docfields.operators import paging

    rows = [(i, f"2024-01-01 00:00:{i % 7:02d}" if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "entry_id bigint, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    whole = [r.entry_id for r in paging.page(df, 1, 60).collect()]
    got, page = [], paging.page(df, 1, 7).collect()
    while page:
        got += [r.entry_id for r in page]
        last = page[-1]
        page = paging.page_after(df, str(last.created_at) if last.created_at else None, last.entry_id, 7).collect()
    assert got == whole
    plan = paging.page_after(df, "2024-01-01 00:00:03", 5, 7)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan


def test_detections_of_a_large_entry_are_several_documents(spark, tmp_path):
    rows = [(k, i, f"n{i}", "checked", 0.5, (1.0 * i, 2.0, 3.0, None) if i % 2 else None, "a") for k, n in ((1, 250), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "entry_id bigint, det_no bigint, name string, state string, confidence double, "
                                     "box struct<top:double,left:double,bottom:double,right:double>, anchor_text string")
    docs = documents.detection_documents(df, 100)
    assert sorted((r.entry_id, r.total_checkboxes_detected) for r in docs.collect()) == [(1, 50), (1, 100), (1, 100), (2, 3)]
    documents.write_detections(df, str(tmp_path / "d"), 4)
    assert len(list((tmp_path / "d").glob("bucket=*"))) <= 4
    got = documents.read_detections(spark, str(tmp_path / "d"), lines=True).withColumn("entry_id", F.col("entry_id").cast("bigint"))
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_release_deletes_tables_and_folders(spark):
    import os

    from docfields.functions import materialize as m

    m.release(spark)
    kept = m.materialize(spark.range(3))
    folder = m.scratch_folder(spark)
    spark.range(2).write.parquet(folder)
    assert kept.count() == 3 and os.path.isdir(folder)
    assert m.release(spark) == 2 and not os.path.exists(folder) and m.release(spark) == 0


def test_export_computes_fields_of_exported_entries_only(spark):
    entries = spark.createDataFrame([(1, 7, "verified"), (1, 7, "verified"), (2, 7, "uploaded"), (3, 7, "archived")],
                                    "entry_id long, template_id long, status string").selectExpr(
        "*", "'i' AS image_url", "0.5D AS confidence_score", "1D AS processing_time")
    fields = spark.createDataFrame([(1, "a", "x", "y", True, 0.5), (2, "a", "x", "y", True, 0.5), (None, "a", "x", "y", True, 0.5)],
                                   "entry_id long, field_name string, ocr_value string, verified_value string, was_corrected boolean, confidence double")
    export = reports.training_export(entries, fields, spark.createDataFrame([(7, "T7")], "template_id long, name string"))
    assert sorted((r.entry_id, len(r.fields)) for r in export.collect()) == [(1, 1), (1, 1), (3, 0)]
    assert "LeftSemi" in export._jdf.queryExecution().optimizedPlan().toString()
