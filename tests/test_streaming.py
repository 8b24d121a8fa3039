"""Streams over files arriving in several batches equal the batch jobs."""

import json
import random

from pyspark.sql import functions as F

from docfields.streaming import progress, quality


def write(path, n, rows):
    path.mkdir(exist_ok=True)
    (path / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def result(spark, stream, base, mode="append"):
    query = progress.write_status(stream, f"{base}/out", f"{base}/state", mode)
    query.awaitTermination()
    return query, spark.read.schema(stream.schema).parquet(f"{base}/out")


def event(form, status, conf, minute, key="confidence_score"):
    return {"form_id": form, "status": status, key: conf, "message": "m", "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00"}


def test_state_changes_over_two_runs(spark, tmp_path):
    source = tmp_path / "in"
    write(source, 1, [event("a", "processing", None, 0), event("a", "processing", None, 1), event("a", "extracted", 0.9, 2, "confidence"), event("b", "processing", None, 0)])
    stream = progress.state_changes(progress.read_progress_stream(spark, str(source)))
    result(spark, stream, tmp_path)
    # The last event is hours later: it moves the watermark past the others.
    write(source, 2, [event("a", "verified", 0.9, 4), event("b", "extracted", 0.5, 1), event("a", "extracted", 0.9, 3), event("end", "x", None, 600)])
    _, out = result(spark, stream, tmp_path)
    got = sorted((r.form_id, r.status) for r in out.collect())
    assert got == [("a", "extracted"), ("a", "processing"), ("a", "verified"), ("b", "extracted"), ("b", "processing")]


def test_state_changes_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(3)
    events = [event(form, rng.choice(["processing", "extracted"]), rng.choice([None, 0.5]), m) for form in "abc" for m in range(50)]
    want = {(f, e["ts"]) for f in "abc" for own in [[e for e in events if e["form_id"] == f]]
            for i, e in enumerate(own) if i == 0 or (e["status"], e["confidence_score"]) != (own[i - 1]["status"], own[i - 1]["confidence_score"])}
    rng.shuffle(events)
    source = tmp_path / "in"
    source.mkdir()
    stream = progress.state_changes(progress.read_progress_stream(spark, str(source)))
    for n, part in enumerate([events[:60], events[60:], [event("end", "x", None, 900)]]):
        write(source, n, part)
        _, out = result(spark, stream, tmp_path)
    assert {(r.form_id, r.ts.strftime("%Y-%m-%dT%H:%M:%S")) for r in out.collect()} == want


def test_ties_go_by_number_whatever_arrives_first(spark, tmp_path):
    """Shuffled events, several at one time, in several batches: changes and stuck forms equal the batch order."""
    rng = random.Random(8)
    rows = [{"event_id": i, "form_id": rng.randrange(5), "status": rng.choice(["processing", "extracted"]), "confidence_score": None,
             "ts": f"2024-01-01T00:{rng.randrange(6):02d}:00"} for i in range(300)]
    want = []
    for form in range(5):
        own, before = sorted((r for r in rows if r["form_id"] == form), key=lambda r: (r["ts"], r["event_id"])), None
        for r in own:
            if r["status"] != before:
                want.append((form, r["status"], r["ts"]))
            before = r["status"]
    last = {r["form_id"]: r["status"] for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"]))}
    rng.shuffle(rows)
    schema = "event_id bigint, form_id bigint, status string, confidence_score double, message string, ts timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    end = {"event_id": -1, "form_id": -1, "status": "end", "ts": "2024-01-01T09:00:00"}
    for n, part in enumerate([rows[:100], rows[100:], [end]]):
        write(tmp_path / "in", n, part)
        _, out = result(spark, progress.state_changes(stream), tmp_path / "changes")
        _, stuck = result(spark, progress.stuck_forms(stream), tmp_path / "stuck")
    got = [(r.form_id, r.status, r.ts.strftime("%Y-%m-%dT%H:%M:%S")) for r in out.collect() if r.form_id >= 0]
    assert sorted(got) == sorted(want)
    assert sorted(r.form_id for r in stuck.collect()) == sorted(k for k, status in last.items() if status == "processing")


def test_latest_status_with_late_and_tied_events(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = progress.latest_status(progress.read_progress_stream(spark, str(source)))
    write(source, 1, [event("a", "extracted", 0.9, 30), event("b", "processing", None, 5)])
    result(spark, stream, tmp_path, "update")
    write(source, 2, [event("a", "processing", None, 10), event("b", "extracted", 0.4, 50)])
    _, out = result(spark, stream, tmp_path, "update")
    assert sorted((r.form_id, r.status) for r in out.collect()) == [("a", "extracted"), ("b", "extracted"), ("b", "processing")]


def test_an_end_row_closes_all_windows(spark, tmp_path):
    rows = [{"status": "extracted", "confidence_score": 0.5, "created_at": f"2024-01-0{d}T00:00:00"} for d in (1, 1, 2, 5)]
    write(tmp_path / "in", 1, rows)
    stream = spark.readStream.schema("status string, confidence_score double, created_at timestamp").json(str(tmp_path / "in"))
    ended = progress.with_end(stream, str(tmp_path / "end"), status="extracted", created_at="2200-01-01 00:00:00")
    _, out = result(spark, quality.confidence_windows(ended, "3 days", "1 day"), tmp_path)
    got = {r.window_start.strftime("%m-%d"): r.total_entries for r in out.collect()}
    assert got == {"12-30": 2, "12-31": 3, "01-01": 3, "01-02": 1, "01-03": 1, "01-04": 1, "01-05": 1}


def test_stuck_forms_fire_on_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    write(source, 1, [event("a", "processing", None, 0), event("b", "processing", None, 0), event("b", "extracted", 0.5, 3)])
    stream = progress.stuck_forms(progress.read_progress_stream(spark, str(source)), "1 minute")
    result(spark, stream, tmp_path)
    write(source, 2, [event("c", "extracted", 0.5, 60)])
    _, out = result(spark, stream, tmp_path)
    assert [r.form_id for r in out.collect()] == ["a"]


def test_repeated_submissions(spark, tmp_path):
    source = tmp_path / "in"
    rows = [{"template_id": 1, "md5": m, "created_at": f"2024-01-01T00:{i:02d}:00"} for i, m in enumerate(["x", "y", "x", "z", "y"])]
    write(source, 1, rows)
    stream = spark.readStream.schema("template_id int, md5 string, created_at timestamp").json(str(source))
    _, out = result(spark, quality.first_submissions(stream), tmp_path)
    assert sorted(r.md5 for r in out.collect()) == ["x", "y", "z"]


def test_upload_join(spark, tmp_path):
    ups, cres = tmp_path / "u", tmp_path / "c"
    write(ups, 1, [{"form_entry_id": i, "uploaded_at": "2024-01-01T00:00:00"} for i in (1, 2, 3)])
    write(cres, 1, [{"form_entry_id": 1, "created_at": "2024-01-01T00:14:00"}, {"form_entry_id": 2, "created_at": "2024-01-01T00:16:00"},
                    {"form_entry_id": 3, "created_at": "2023-12-31T23:59:00"}])
    u = spark.readStream.schema("form_entry_id int, uploaded_at timestamp").json(str(ups))
    c = spark.readStream.schema("form_entry_id int, created_at timestamp").json(str(cres))
    _, out = result(spark, quality.uploads_with_creations(u, c), tmp_path)
    assert [r.form_entry_id for r in out.collect()] == [1]


def test_incremental_standardisation(spark, tmp_path):
    from docfields.operators.standardize import standardize_post

    source = tmp_path / "in"
    write(source, 1, [{"field_name": "first_name", "value_in": "JUAN", "conf_in": 0.5}])
    stream = spark.readStream.schema("field_name string, value_in string, conf_in double").json(str(source))
    quality.standardize_stream(stream, standardize_post, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    write(source, 2, [{"field_name": "birth_year", "value_in": "l99O", "conf_in": 0.5}])
    quality.standardize_stream(stream, standardize_post, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(F.sort_array(F.collect_list("value_out")).alias("v")).first().v
    assert got == ["1990", "Juan"]


def test_late_rows_are_counted(spark, tmp_path):
    source = tmp_path / "in"
    write(source, 1, [{"template_id": 1, "md5": "x", "created_at": "2024-01-01T10:00:00"}])
    stream = quality.first_submissions(
        spark.readStream.schema("template_id int, md5 string, created_at timestamp").json(str(source)))
    result(spark, stream, tmp_path)
    write(source, 2, [{"template_id": 1, "md5": "y", "created_at": "2024-01-01T00:01:00"}])
    query, out = result(spark, stream, tmp_path)
    assert progress.dropped_late_rows(query) == 1
    assert [r.md5 for r in out.collect()] == ["x"]


def test_latest_status_ignores_older_messages(spark, tmp_path):
    source = tmp_path / "in"
    write(source, 1, [event("a", "verified", 0.5, 600)])
    stream = progress.latest_status(progress.read_progress_stream(spark, str(source)))
    result(spark, stream, tmp_path, "update")
    write(source, 2, [event("a", "processing", None, 1)])
    _, out = result(spark, stream, tmp_path, "update")
    assert {r.status for r in out.collect()} == {"verified"}


def test_a_table_is_a_file_or_a_folder(spark, tmp_path):
    from docfields.catalog.q_streams import run, stream_of
    from docfields.catalog.views import Views

    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/many/t.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file" / "t.parquet")
    for folder, rows in (("many", 10), ("file", 7)):
        v = Views(spark, f"{tmp_path}/{folder}")
        assert run(v, stream_of(v, "t")).count() == rows
