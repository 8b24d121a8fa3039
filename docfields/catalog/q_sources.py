"""Round trips through files, late rows, and a check that every line item is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.catalog.q_reports import VERIFIED
from docfields.catalog.registry import query
from docfields.functions.materialize import scratch_folder
from docfields.operators import reports
from docfields.sources import documents, tables
from docfields.streaming import progress, quality


def folder(v) -> str:
    return scratch_folder(v.spark)


@query("line_items_read", [], "SELECT count(*) AS n FROM lineitem")
def _(v):
    return v.texts.agg(F.count(F.lit(1)).alias("n"))


@query("read_tables", ["entries", "users"], """
SELECT entry_id, e.template_id, status, confidence_score, full_name, role FROM entries e LEFT JOIN users ON uploaded_by = user_id""")
def _(v):
    path = folder(v)
    entries = v.entries.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    tables.write_table(entries, path, "entries", ["status"])
    tables.write_table(v.users, path, "users")
    read = tables.read_tables(v.spark, path, ["entries", "users"])
    return read["entries"].join(read["users"], F.col("uploaded_by") == F.col("user_id"), "left").select(
        "entry_id", "template_id", "status", "confidence_score", "full_name", "role")


@query("read_detections", ["detections"], """
SELECT CAST(entry_id AS VARCHAR) AS entry_id, det_no, name, state, round(confidence + 1e-10, 3) AS confidence, anchor_text,
  det_no * 10.5e0 AS top, CASE WHEN det_no <> 3 THEN CAST(entry_id % 500 AS DOUBLE) END AS "left",
  det_no * 10.5e0 + 8 AS bottom, CASE WHEN det_no <> 3 THEN CAST(entry_id % 500 + 40 AS DOUBLE) END AS "right", det_no = 2 AS no_box
FROM detections WHERE det_no <> 2
UNION ALL SELECT CAST(entry_id AS VARCHAR), det_no, name, state, round(confidence + 1e-10, 3), anchor_text, NULL, NULL, NULL, NULL, true
FROM detections WHERE det_no = 2""")
def _(v):
    path = folder(v)
    left = F.when(F.col("det_no") != 3, (F.col("entry_id") % 500).cast("double"))
    box = F.struct((F.col("det_no") * 10.5).alias("top"), left.alias("left"), (F.col("det_no") * 10.5 + 8).alias("bottom"),
                   (left + 40).alias("right"))
    documents.write_detections(v.detections.withColumn("box", F.when(F.col("det_no") != 2, box)), path)
    return documents.read_detections(v.spark, path, lines=True).select(
        "entry_id", "det_no", "name", "state", "confidence", "anchor_text", "box.*", F.col("box").isNull().alias("no_box"))


@query("export_training_data", ["entries", "fields", "templates"], f"""
SELECT e.template_id, count(DISTINCT e.entry_id) AS n_entries, count(f.field_name) AS n_fields, count(CASE WHEN was_corrected THEN 1 END) AS n_corrected
FROM entries e JOIN fields f ON f.entry_id = e.entry_id WHERE {VERIFIED} GROUP BY 1""")
def _(v):
    path = folder(v)
    documents.export_training_data(_export(v), path)
    item = F.explode("fields").alias("f")
    return v.spark.read.parquet(path).select("template_id", "entry_id", item).groupBy("template_id").agg(
        F.count_distinct("entry_id").alias("n_entries"), F.count("f.field_name").alias("n_fields"),
        F.count(F.when(F.col("f.was_corrected"), 1)).alias("n_corrected"))


def _export(v) -> DataFrame:
    return reports.training_export(v.entries, v.fields, v.templates)


@query("stream_late_rows", [], """
WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle, max(ts) AS last FROM events)
SELECT count(*) AS n_late FROM events, m WHERE ts < middle AND ts < last - INTERVAL 1 HOUR""")
def _(v):
    """The later half of the events arrives first; what is over an hour older than its end is dropped and counted."""
    base = folder(v)
    rows = v.events.selectExpr("event_id AS template_id", "CAST(event_id AS STRING) AS md5", "CAST(ts AS TIMESTAMP) AS created_at", "ts")
    middle = v.events.selectExpr("min(ts) + (max(ts) - min(ts)) / 2 AS middle").first().middle
    halves = rows.withColumn("early", F.col("ts") < F.lit(middle)).drop("ts")
    late = 0
    for early in (False, True):
        halves.filter(F.col("early") == early).drop("early").write.mode("append").parquet(f"{base}/in")
        source = v.spark.readStream.schema("template_id bigint, md5 string, created_at timestamp").parquet(f"{base}/in")
        started = progress.write_status(quality.first_submissions(source), f"{base}/out", f"{base}/state")
        started.awaitTermination()
        late += progress.dropped_late_rows(started)
    return v.spark.range(1).select(F.lit(late).cast("bigint").alias("n_late"))
