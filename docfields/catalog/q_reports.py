"""Quality reports, filters, joins and pages against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.catalog.registry import avg4, pct, query
from docfields.catalog.views import AS_OF, DAYS
from docfields.operators import filters, joins, paging, reports
from docfields.sources import templates as template_source

RECENT = f"created_at > TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"
REPORTED = f"{RECENT} AND status IN ('extracted', 'verified')"
VERIFIED = "status IN ('verified', 'archived')"


def r4(expr: str, digits: int = 4) -> str:
    return f"round({expr} + 1e-10, {digits})"


CONFIDENCE_REPORT = f"""
SELECT {avg4('confidence_score')} AS system_confidence, {r4('quantile_cont(confidence_score, 0.5)')} AS median_confidence,
  {r4('quantile_cont(confidence_score, 0.25)')} AS p25, {r4('quantile_cont(confidence_score, 0.75)')} AS p75,
  {r4('min(confidence_score)')} AS min_confidence, {r4('max(confidence_score)')} AS max_confidence,
  count(*) AS total_entries,
  count(CASE WHEN confidence_score < 0.3 THEN 1 END) AS very_low_count,
  count(CASE WHEN confidence_score >= 0.3 AND confidence_score < 0.7 THEN 1 END) AS low_count,
  count(CASE WHEN confidence_score >= 0.7 AND confidence_score < 0.85 THEN 1 END) AS medium_count,
  count(CASE WHEN confidence_score >= 0.85 AND confidence_score < 0.95 THEN 1 END) AS high_count,
  count(CASE WHEN confidence_score >= 0.95 THEN 1 END) AS very_high_count
FROM entries WHERE {REPORTED}"""


@query("confidence_report", ["entries"], CONFIDENCE_REPORT)
def _(v):
    return reports.confidence_report(v.entries, DAYS, AS_OF)


@query("template_analysis", ["entries", "templates"], f"""
SELECT e.template_id, t.name AS template_name, count(*) AS total_entries, {avg4('confidence_score')} AS avg_confidence,
  {r4('stddev_samp(confidence_score)')} AS stddev_confidence, {r4('min(confidence_score)')} AS min_confidence,
  {r4('max(confidence_score)')} AS max_confidence, {r4('quantile_cont(confidence_score, 0.5)')} AS median_confidence
FROM entries e JOIN templates t ON e.template_id = t.template_id WHERE {REPORTED.replace('created_at', 'e.created_at')}
GROUP BY 1, 2""")
def _(v):
    return reports.template_analysis(v.entries, v.templates, DAYS, AS_OF)


FIELD_ANALYSIS = f"""
SELECT field_name, count(*) AS total_instances, {avg4('confidence')} AS avg_field_confidence,
  count(CASE WHEN was_corrected THEN 1 END) AS correction_count,
  {pct('count(CASE WHEN was_corrected THEN 1 END)', 'count(*)')} AS correction_rate_pct,
  {pct('count(CASE WHEN confidence < 0.7 THEN 1 END)', 'count(*)')} AS low_conf_pct,
  {r4('min(confidence)')} AS min_confidence, {r4('max(confidence)')} AS max_confidence
FROM fields WHERE {RECENT} GROUP BY 1"""

for _mode in ("correction_rate", "avg_confidence", "field_name"):
    query(f"field_analysis_by_{_mode}", ["fields"], FIELD_ANALYSIS)(
        lambda v, mode=_mode: reports.field_analysis(v.fields, DAYS, AS_OF, mode))


@query("low_confidence_fields", ["fields"], f"""
SELECT field_name, {avg4('confidence')} AS avg_confidence, count(*) AS occurrences,
  count(CASE WHEN was_corrected THEN 1 END) AS corrections,
  {pct('count(CASE WHEN was_corrected THEN 1 END)', 'count(*)', 1)} AS correction_rate_pct
FROM fields WHERE confidence < 0.7 AND {RECENT} GROUP BY 1""")
def _(v):
    return reports.low_confidence_fields(v.fields, DAYS, AS_OF)


SECONDS = "coalesce(CAST(json_extract_string(raw_ocr_data, '$.processing_time') AS DOUBLE), processing_time)"


@query("image_quality_impact", ["entries"], f"""
SELECT CAST(json_extract_string(raw_ocr_data, '$.raw_lines_count') AS INTEGER) AS line_count,
  {r4('confidence_score', 1)} AS confidence_bin, count(*) AS entry_count,
  {avg4(SECONDS, 2)} AS avg_processing_time_s, {r4(f'min({SECONDS})', 2)} AS min_time_s,
  {r4(f'max({SECONDS})', 2)} AS max_time_s
FROM entries WHERE {REPORTED} AND raw_ocr_data IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return reports.image_quality_impact(v.entries, DAYS, AS_OF)


def _distribution(missing: str) -> str:
    return f"""
WITH b AS (SELECT CASE WHEN confidence_score < 0.3 THEN '0.0-0.3 (Very Low)' WHEN confidence_score < 0.7
    THEN '0.3-0.7 (Low)' WHEN confidence_score < 0.85 THEN '0.7-0.85 (Medium)' WHEN confidence_score < 0.95
    THEN '0.85-0.95 (High)' {missing} ELSE '0.95-1.0 (Very High)' END AS confidence_bin
  FROM entries WHERE {REPORTED})
SELECT confidence_bin, count(*) AS entry_count, {pct('count(*)', '(SELECT count(*) FROM b)', 1)} AS percentage
FROM b GROUP BY 1"""


@query("confidence_distribution", ["entries"], _distribution(""))
def _(v):
    return reports.confidence_distribution(v.entries, DAYS, AS_OF)


@query("confidence_distribution_missing_separate", ["entries"],
       _distribution("WHEN confidence_score IS NULL THEN 'missing'"))
def _(v):
    return reports.confidence_distribution(v.entries, DAYS, AS_OF, null_policy="separate")


@query("training_stats", ["entries", "fields"], f"""
SELECT (SELECT count(*) FROM entries WHERE {VERIFIED}) AS total_verified_entries, count(*) AS total_fields,
  count(CASE WHEN was_corrected THEN 1 END) AS total_corrected_fields,
  coalesce({pct('count(CASE WHEN was_corrected THEN 1 END)', 'count(*)')}, 0.0) AS correction_rate,
  coalesce({avg4('confidence')}, 0.0) AS avg_confidence
FROM fields JOIN entries USING (entry_id) WHERE {VERIFIED}""")
def _(v):
    return reports.training_stats(v.entries, v.fields)


@query("training_templates", ["entries", "templates"], f"""
SELECT template_id, t.name AS template_name, count(*) AS verified_entries
FROM entries JOIN templates t USING (template_id) WHERE {VERIFIED} GROUP BY 1, 2""")
def _(v):
    return reports.training_templates(v.entries, v.templates)


def _flat_export(df):
    """One row per exported field, so that a hash of rows can compare it."""
    return df.select("entry_id", "template_id", "template_name", "image_url", "confidence_score", "processing_time",
                     F.explode_outer("fields").alias("f")).select(
        "*", "f.field_name", "f.ocr_value", "f.verified_value", "f.was_corrected", "f.confidence").drop("f")


def _export_sql(inner: str, join: str, extra: str = "") -> str:
    return f"""
SELECT e.entry_id, e.template_id, coalesce(t.name, 'Unknown') AS template_name, e.image_url, e.confidence_score,
  e.processing_time, f.field_name, CASE WHEN f.entry_id IS NOT NULL THEN coalesce(f.ocr_value, '') END AS ocr_value,
  CASE WHEN f.entry_id IS NOT NULL THEN coalesce(f.verified_value, '') END AS verified_value, f.was_corrected, f.confidence
FROM ({inner}) e {join} fields f ON e.entry_id = f.entry_id {extra} LEFT JOIN templates t ON e.template_id = t.template_id"""


@query("training_export", ["entries", "fields", "templates"],
       _export_sql(f"SELECT * FROM entries WHERE {VERIFIED}", "LEFT JOIN"))
def _(v):
    return _flat_export(reports.training_export(v.entries, v.fields, v.templates))


@query("training_export_corrected_page", ["entries", "fields", "templates"],
       _export_sql(f"SELECT * FROM entries WHERE {VERIFIED} ORDER BY updated_at DESC, entry_id LIMIT 1000 OFFSET 100",
                   "JOIN", "AND f.was_corrected"))
def _(v):
    return _flat_export(reports.training_export(
        v.entries, v.fields, v.templates, limit=1000, offset=100, corrected_only=True))


EVALUATED = f"{VERIFIED} AND verified_value IS NOT NULL AND verified_value <> ''"
EXACT = "count(CASE WHEN ocr_value = verified_value THEN 1 END)"


@query("evaluation_overall", ["entries", "fields"], f"""
SELECT count(DISTINCT entry_id) AS total_entries_evaluated, count(*) AS total_fields_evaluated,
  coalesce({pct(EXACT, 'count(*)')}, 0.0) AS field_accuracy, coalesce({avg4('confidence')}, 0.0) AS avg_confidence,
  coalesce({pct('count(CASE WHEN was_corrected THEN 1 END)', 'count(*)')}, 0.0) AS correction_rate
FROM fields JOIN entries USING (entry_id) WHERE {EVALUATED}""")
def _(v):
    return reports.evaluation_overall(v.entries, v.fields)


@query("evaluation_per_template", ["entries", "fields", "templates"], f"""
SELECT t.name AS template_name, count(*) AS field_count, {EXACT} AS exact_matches,
  {pct(EXACT, 'count(*)')} AS field_accuracy, {avg4('confidence')} AS avg_confidence
FROM fields JOIN entries USING (entry_id) JOIN templates t USING (template_id) WHERE {EVALUATED} GROUP BY 1""")
def _(v):
    return reports.evaluation_per_template(v.entries, v.fields, v.templates)


@query("evaluation_per_field", ["entries", "fields"], f"""
SELECT field_name, count(*) AS total, {EXACT} AS exact_matches, count(CASE WHEN was_corrected THEN 1 END) AS corrected,
  {pct(EXACT, 'count(*)')} AS field_accuracy, {avg4('confidence')} AS avg_confidence
FROM fields JOIN entries USING (entry_id) WHERE {EVALUATED} GROUP BY 1""")
def _(v):
    return reports.evaluation_per_field(v.entries, v.fields)


@query("source_mix", ["fields"], f"""
SELECT source, count(*) AS field_count, {avg4('confidence')} AS avg_confidence,
  {pct('count(CASE WHEN was_corrected THEN 1 END)', 'count(*)')} AS correction_rate_pct FROM fields GROUP BY 1""")
def _(v):
    return reports.source_mix(v.fields)


@query("rollup_entry", ["entries", "fields"], f"""
SELECT entry_id, count(f.field_name) AS field_count,
  count(CASE WHEN coalesce(f.ocr_value, '') <> '' THEN 1 END) AS filled_count,
  coalesce({avg4('f.confidence')}, 0.0) AS confidence_score,
  string_agg(f.field_name || '=' || f.source, ',' ORDER BY f.field_name) AS field_sources
FROM entries LEFT JOIN fields f USING (entry_id) GROUP BY 1""")
def _(v):
    rolled = reports.rollup_entry(v.entries, v.fields)
    pairs = F.transform(F.map_entries("field_sources"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rolled.select("entry_id", "field_count", "filled_count", "confidence_score",
                         F.array_join(F.array_sort(pairs), ",").alias("field_sources"))


@query("extracted_or_verified_recent", ["entries"], f"SELECT entry_id, status, created_at FROM entries WHERE {REPORTED}")
def _(v):
    return filters.within_days(filters.extracted_or_verified(v.entries), DAYS, AS_OF).select(
        "entry_id", "status", "created_at")


@query("verified_only", ["entries"], f"SELECT entry_id, status FROM entries WHERE {VERIFIED}")
def _(v):
    return filters.verified_only(v.entries).select("entry_id", "status")


@query("retryable", ["entries"], "SELECT entry_id, status FROM entries WHERE status IN ('uploaded', 'processing')")
def _(v):
    return filters.retryable(v.entries).select("entry_id", "status")


@query("matching_template_status_device", ["entries"],
       "SELECT entry_id FROM entries WHERE template_id = 3 AND status = 'verified' AND device_id = 'dev3'")
def _(v):
    return filters.matching(v.entries, template_id=3, status="verified", device_id="dev3").select("entry_id")


@query("visible_to_encoder", ["entries"], "SELECT entry_id, uploaded_by FROM entries WHERE uploaded_by = 7")
def _(v):
    return filters.visible_to(v.entries, 7, "encoder").select("entry_id", "uploaded_by")


@query("visible_pairs", ["entries", "users"], """
SELECT user_id, entry_id FROM entries JOIN users ON uploaded_by = user_id WHERE role = 'encoder' AND is_active""")
def _(v):
    return filters.visible_pairs(v.entries, v.users).select("user_id", "entry_id")


@query("evaluable", ["fields"],
       "SELECT entry_id, field_name, verified_value FROM fields WHERE verified_value IS NOT NULL AND verified_value <> ''")
def _(v):
    return filters.evaluable(v.fields).select("entry_id", "field_name", "verified_value")


@query("low_confidence_filter", ["fields"], "SELECT entry_id, field_name, confidence FROM fields WHERE confidence < 0.7")
def _(v):
    return filters.low_confidence(v.fields).select("entry_id", "field_name", "confidence")


@query("active_templates", ["templates"], "SELECT template_id, name FROM templates WHERE is_active")
def _(v):
    return filters.active_templates(v.templates).select("template_id", "name")


@query("validate_field_records", ["texts"], """
WITH r AS (SELECT ok AS entry_id, CASE WHEN h % 97 = 0 THEN '  ' ELSE ' f' || ln END AS field_name,
    coalesce(CASE WHEN h % 5 <> 0 THEN name_text END, '') AS ocr_value,
    CASE WHEN h % 89 = 0 THEN 1.5 WHEN h % 101 = 0 THEN NULL ELSE conf END AS confidence FROM texts),
bad AS (SELECT DISTINCT entry_id FROM r WHERE trim(field_name) = '' OR confidence IS NULL OR confidence > 1)
SELECT entry_id, trim(field_name) AS field_name, ocr_value, confidence FROM r
WHERE entry_id NOT IN (SELECT entry_id FROM bad)""")
def _(v):
    raw = v.texts.selectExpr(
        "ok AS entry_id", "CASE WHEN h % 97 = 0 THEN '  ' ELSE concat(' f', ln) END AS field_name",
        "CASE WHEN h % 5 <> 0 THEN name_text END AS ocr_value",
        "CASE WHEN h % 89 = 0 THEN 1.5D WHEN h % 101 = 0 THEN NULL ELSE conf END AS confidence")
    return filters.validate_field_records(raw)[0].select("entry_id", "field_name", "ocr_value", "confidence")


@query("entry_summary_columns", ["entries"], f"""
SELECT entry_id, CAST(json_extract_string(raw_ocr_data, '$.raw_lines_count') AS INTEGER) AS line_count,
  {SECONDS} AS ocr_seconds FROM entries""")
def _(v):
    return filters.entry_summary_columns(v.entries).select("entry_id", "line_count", "ocr_seconds")


@query("entry_listing", ["entries"],
       "SELECT entry_id, template_id, uploaded_by, image_url, status, confidence_score, created_at FROM entries")
def _(v):
    return filters.entry_listing(v.entries)


@query("entry_detail", ["entries", "fields", "users"], """
SELECT e.entry_id, e.status, f.field_name, f.ocr_value FROM entries e LEFT JOIN fields f ON e.entry_id = f.entry_id
WHERE e.entry_id IN (SELECT user_id FROM users WHERE role = 'admin')""")
def _(v):
    ids = v.users.filter("role = 'admin'").select(F.col("user_id").alias("entry_id"))
    detail = joins.entry_detail(v.entries, v.fields, ids, 0, "admin", "ocr_value")
    return detail.select("entry_id", "status", F.explode_outer("fields").alias("f")).select(
        "entry_id", "status", "f.field_name", "f.ocr_value")


@query("fields_with_entries", ["fields", "entries"],
       "SELECT entry_id, field_name, status, template_id FROM fields JOIN entries USING (entry_id)")
def _(v):
    return joins.fields_with_entries(v.fields, v.entries, "status", "template_id").select(
        "entry_id", "field_name", "status", "template_id")


@query("entries_with_templates", ["entries", "templates"],
       "SELECT entry_id, t.name AS template_name FROM entries JOIN templates t USING (template_id)")
def _(v):
    return joins.entries_with_templates(v.entries, v.templates).select("entry_id", "template_name")


@query("entries_with_template_names", ["entries", "templates"], """
SELECT entry_id, coalesce(t.name, 'Unknown') AS template_name FROM entries LEFT JOIN templates t USING (template_id)""")
def _(v):
    return joins.entries_with_template_names(v.entries, v.templates).select("entry_id", "template_name")


@query("entries_with_fields", ["entries", "fields"], """
SELECT entry_id, count(f.field_name) AS n_fields, coalesce(string_agg(f.field_name, ',' ORDER BY f.field_name), '') AS names
FROM entries LEFT JOIN fields f USING (entry_id) GROUP BY 1""")
def _(v):
    nested = joins.entries_with_fields(v.entries, v.fields, "ocr_value")
    return nested.select("entry_id", F.size("fields").cast("bigint").alias("n_fields"),
                         F.array_join("fields.field_name", ",").alias("names"))


@query("entries_with_users", ["entries", "users"], """
SELECT entry_id, u.full_name AS uploader_name, w.full_name AS verifier_name FROM entries
LEFT JOIN users u ON u.user_id = uploaded_by LEFT JOIN users w ON w.user_id = verified_by""")
def _(v):
    return joins.entries_with_users(v.entries, v.users).select("entry_id", "uploader_name", "verifier_name")


@query("with_field_schema", ["fields", "entries", "template_fields"], """
SELECT f.entry_id, f.field_name, t.type, t.required FROM fields f JOIN entries e ON f.entry_id = e.entry_id
LEFT JOIN template_fields t ON t.template_id = e.template_id AND t.name = f.field_name""")
def _(v):
    fields = joins.fields_with_entries(v.fields, v.entries, "template_id")
    return joins.with_field_schema(fields, v.template_fields, "type", "required").select(
        "entry_id", "field_name", "type", "required")


@query("unresolved_fields", ["fields", "entries", "template_fields"], """
SELECT e.entry_id, t.name AS field_name FROM entries e JOIN template_fields t USING (template_id)
WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.entry_id = e.entry_id AND f.field_name = t.name
  AND coalesce(f.ocr_value, '') <> '')""")
def _(v):
    expected = v.entries.join(v.template_fields, "template_id").select(
        "entry_id", F.col("name").alias("field_name"))
    return joins.unresolved_fields(expected, v.fields.filter("coalesce(ocr_value, '') <> ''"))


@query("requested_fields", ["template_fields", "fields"], """
SELECT template_id, name FROM template_fields WHERE name IN (SELECT field_name FROM fields WHERE was_corrected)""")
def _(v):
    names = v.fields.filter("was_corrected").select(F.col("field_name").alias("name")).distinct()
    return joins.requested_fields(v.template_fields, names).select("template_id", "name")


@query("uploads_with_creations", ["images", "entries"], """
SELECT i.path, e.entry_id, e.created_at FROM (SELECT path, entry_id, created_at AS c0 FROM images) i
JOIN (SELECT entry_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(entry_id % 251 AS INTEGER)) AS created_at FROM entries) e
  ON i.entry_id = e.entry_id
WHERE e.created_at >= c0 AND e.created_at <= c0 + INTERVAL 15 MINUTE""")
def _(v):
    uploads = v.images.select("path", F.col("entry_id").alias("form_entry_id"), F.col("created_at").alias("uploaded_at"))
    creations = v.entries.selectExpr(
        "entry_id AS form_entry_id", "entry_id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(entry_id % 251 AS INT)) AS created_at")
    return joins.uploads_with_creations(uploads, creations).select("path", "entry_id", "created_at")


@query("entry_page", ["entries"],
       "SELECT entry_id, created_at FROM entries WHERE status = 'extracted' ORDER BY created_at DESC, entry_id LIMIT 20 OFFSET 40")
def _(v):
    return paging.page(filters.matching(v.entries, status="extracted"), 3, 20).select("entry_id", "created_at")


@query("entry_page_after", ["entries"], """
WITH p AS (SELECT created_at, entry_id FROM entries WHERE status = 'extracted' ORDER BY created_at DESC, entry_id LIMIT 1 OFFSET 39)
SELECT e.entry_id, e.created_at FROM entries e, p WHERE status = 'extracted'
  AND (e.created_at < p.created_at OR (e.created_at = p.created_at AND e.entry_id > p.entry_id))
ORDER BY e.created_at DESC, e.entry_id LIMIT 20""")
def _(v):
    """The third page, continued from the last row of the second."""
    extracted = filters.matching(v.entries, status="extracted")
    last = paging.page(extracted, 2, 20).collect()[-1]
    return paging.page_after(extracted, str(last.created_at), last.entry_id, 20).select("entry_id", "created_at")


@query("entry_page_counts", ["entries"],
       "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM entries WHERE status = 'extracted'")
def _(v):
    return paging.page_counts(filters.matching(v.entries, status="extracted"), 20)


@query("device_page", ["entries"],
       "SELECT entry_id, created_at FROM entries WHERE device_id = 'dev7' ORDER BY created_at DESC, entry_id LIMIT 50")
def _(v):
    return paging.page(filters.matching(v.entries, device_id="dev7"), 1, 50).select("entry_id", "created_at")


@query("template_fields", ["template_fields"],
       "SELECT template_id, CAST(field_pos AS INTEGER) AS field_pos, name, label, type, required FROM template_fields")
def _(v):
    return v.template_fields.select("template_id", "field_pos", "name", "label", "type", "required")


@query("template_rejects", ["templates"], """
SELECT template_id, name, CASE template_id WHEN 23 THEN 'unreadable schema' ELSE 'no fields' END AS reason
FROM templates WHERE template_id IN (23, 24)""")
def _(v):
    return template_source.explode_template_fields(v.templates)[1]


@query("needs_image", ["template_fields"], """
SELECT template_id, bool_or(type IN ('checkbox', 'checkbox-group', 'radio')) AS needs_image FROM template_fields GROUP BY 1""")
def _(v):
    return template_source.needs_image(v.template_fields)


@query("flatten_sections", ["templates"], """
SELECT template_id, CAST(i AS INTEGER) AS field_pos, CASE i WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS name,
  CASE WHEN i < 2 THEN 'Part of ' || name ELSE 'Rest' END AS section
FROM templates, (VALUES (0), (1), (2)) AS s(i)""")
def _(v):
    nested = v.templates.withColumn("field_schema", F.format_string(
        '{"sections": [{"title": "Part of %s", "fields": [{"name": "a"}, {"name": "b"}]}, {"title": "Empty"}, '
        '{"title": "Rest", "fields": [{"name": "c"}]}]}', "name"))
    return template_source.flatten_sections(nested).select("template_id", "field_pos", "name", "section")


@query("seed_upsert_templates", ["templates"], """
SELECT c.name AS name, CASE WHEN c.template_id % 2 = 0 THEN 'new ' || c.name ELSE c.description END AS description,
  c.template_id, CASE WHEN c.template_id % 2 = 0 THEN 'updated' ELSE 'kept' END AS change FROM templates c
UNION ALL SELECT 'Extra ' || name, 'new ' || name, template_id + 100, 'inserted' FROM templates WHERE template_id % 2 = 1""")
def _(v):
    new = v.templates.selectExpr(
        "CASE WHEN template_id % 2 = 0 THEN template_id ELSE template_id + 100 END AS template_id",
        "CASE WHEN template_id % 2 = 0 THEN name ELSE concat('Extra ', name) END AS name",
        "concat('new ', name) AS description", "field_schema", "is_active")
    return template_source.seed_upsert_templates(new, v.templates).select(
        "name", "description", "template_id", "change")


@query("newest_users", ["users"], "SELECT user_id, full_name, role FROM users")
def _(v):
    dated = v.users.withColumn("created_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(user_id % 300 AS INT))"))
    return paging.newest_users(dated).select("user_id", "full_name", "role")
