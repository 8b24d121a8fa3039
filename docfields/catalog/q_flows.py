"""Merging, response parsing and lifecycle jobs against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.catalog.registry import avg4, query
from docfields.operators import lifecycle, merge, responses
from docfields.sources import documents

# Two extraction results of the same forms: each line item yields a primary and, shifted, a fallback value.
PRIMARY = "SELECT ok AS entry_id, 'f' || CAST(ln AS {s}) AS field_name, CASE WHEN h % 4 = 0 THEN '' ELSE name_text END AS value, conf AS confidence, 'ai' AS source FROM {t} WHERE rf <> 'A'"
FALLBACK = "SELECT ok AS entry_id, 'f' || CAST(ln AS {s}) AS field_name, CASE WHEN h % 5 = 0 THEN '' WHEN h % 5 = 1 THEN '  ' ELSE street_text END AS value, CASE WHEN h % 3 = 0 THEN conf ELSE (pk % 100) / 100.0E0 END AS confidence, 'positional' AS source FROM {t} WHERE rf <> 'N'"


def sides(v):
    run = lambda sql: v.spark.sql(sql.format(s="STRING", t="{texts}"), texts=v.texts)
    return run(PRIMARY), run(FALLBACK)


SIDES = f"p AS ({PRIMARY.format(s='VARCHAR', t='texts')}), f AS ({FALLBACK.format(s='VARCHAR', t='texts')})"


@query("merge_primary_fallback", ["texts"], f"""
WITH {SIDES}, j AS (SELECT coalesce(p.entry_id, f.entry_id) AS entry_id, coalesce(p.field_name, f.field_name) AS field_name,
  p.value AS pv, f.value AS fv, p.confidence AS pc, f.confidence AS fc, p.source AS ps, f.source AS fs
  FROM p FULL JOIN f ON p.entry_id = f.entry_id AND p.field_name = f.field_name),
k AS (SELECT *, CASE WHEN coalesce(pv, '') <> '' AND coalesce(pc, 0) >= coalesce(fc, 0) THEN true
  WHEN coalesce(fv, '') <> '' AND coalesce(fc, 0) > coalesce(pc, 0) THEN false ELSE coalesce(pc, 0) >= coalesce(fc, 0) END AS u FROM j)
SELECT entry_id, field_name, coalesce(CASE WHEN u THEN pv ELSE fv END, '') AS value,
  coalesce(CASE WHEN u THEN pc ELSE fc END, 0.0) AS confidence, CASE WHEN u THEN ps ELSE fs END AS source FROM k""")
def _(v):
    return merge.merge_primary_fallback(*sides(v))


@query("merge_ai_into_deterministic", ["texts"], f"""
WITH {SIDES}, a AS (SELECT entry_id, field_name, trim(value) AS av, confidence AS ac FROM f WHERE trim(value) <> ''),
x AS (SELECT coalesce(p.entry_id, a.entry_id) AS entry_id, coalesce(p.field_name, a.field_name) AS field_name, p.value AS pv,
    p.confidence AS pc, av, ac, av IS NOT NULL AND (trim(coalesce(p.value, '')) = '' OR ac >= coalesce(p.confidence, 0)) AS t
  FROM p FULL JOIN a ON p.entry_id = a.entry_id AND p.field_name = a.field_name)
SELECT entry_id, field_name, CASE WHEN t THEN av ELSE pv END AS value, CASE WHEN t THEN ac ELSE pc END AS confidence,
  CASE WHEN t THEN 'ai' ELSE 'deterministic' END AS source, NOT t AND coalesce(pv, '') = '' AS unresolved FROM x""")
def _(v):
    primary, ai = sides(v)
    # Every answer comes in two passes; the second one counts.
    first = ai.withColumns({"value": F.lit("first pass"), "pass_no": F.lit(1)})
    ai = first.join(ai.where("trim(value) <> ''"), ["entry_id", "field_name"], "left_semi").unionByName(ai.withColumn("pass_no", F.lit(2)))
    deterministic = primary.withColumns({"source": F.lit("deterministic"), "unresolved": F.col("value") == ""})
    return merge.merge_ai_into_deterministic(deterministic, ai.drop("source"))


@query("merge_multi_pass", ["texts", "detections"], f"""
WITH {SIDES}, c AS (
  SELECT entry_id, lower(name) AS field_name, CASE state WHEN 'checked' THEN 'true' ELSE 'false' END AS value, confidence, 'checkbox_detection' AS source
    FROM detections WHERE state <> 'unclear'
  UNION ALL SELECT entry_id, field_name, value, confidence, 'pass_1' FROM p UNION ALL SELECT entry_id, field_name, value, confidence, 'pass_2' FROM f),
r AS (SELECT *, CASE WHEN source = 'checkbox_detection' THEN 0 WHEN source = 'pass_1' AND value <> '' AND confidence >= 0.7 THEN 1
  WHEN source = 'pass_2' AND value <> '' THEN 2 WHEN value <> '' THEN 3 ELSE 4 END AS k FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY entry_id, field_name ORDER BY k, confidence DESC, source, value) AS n FROM r)
SELECT entry_id, field_name, value, confidence, source, ['checkbox detection', 'Pass 1 confident', 'Pass 2 recovery', 'Pass 1 weak', 'empty'][k + 1] AS note
FROM w WHERE n = 1""")
def _(v):
    first, second = sides(v)
    return merge.merge_multi_pass(first, second, v.detections)


@query("union_candidates", ["texts"], f"WITH {SIDES} SELECT source, count(*) AS n FROM (SELECT 'one' AS source FROM p UNION ALL SELECT 'two' FROM f) GROUP BY 1")
def _(v):
    first, second = sides(v)
    return merge.union_candidates(one=first, two=second).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("fallback_entries", ["texts"], f"""
WITH {SIDES} SELECT entry_id, {avg4('confidence')} AS avg_confidence, count(CASE WHEN value <> '' THEN 1 END) AS filled_count
FROM p GROUP BY 1 HAVING {avg4('confidence')} < 0.5 AND count(CASE WHEN value <> '' THEN 1 END) < 30""")
def _(v):
    return merge.fallback_entries(sides(v)[0])


@query("fallback_entries_by_share", ["texts"], f"""
WITH {SIDES} SELECT entry_id, {avg4('confidence')} AS avg_confidence, count(CASE WHEN value <> '' THEN 1 END) AS filled_count
FROM p GROUP BY 1 HAVING {avg4('confidence')} < 0.5 AND count(CASE WHEN value <> '' THEN 1 END) < (entry_id % 7) * 0.6""")
def _(v):
    sizes = v.orders.selectExpr("o_orderkey AS entry_id", "o_orderkey % 7 AS schema_fields")
    return merge.fallback_entries(sides(v)[0], sizes)


# --- responses -----------------------------------------------------------------------------------------------

FLAT = """
b AS (SELECT entry_id, CASE entry_id % 6 WHEN 1 THEN regexp_extract(response_text, '(?s)^```json\\s*(.*?)\\s*```', 1)
    WHEN 3 THEN regexp_extract(response_text, '(?s)^```\\s*(.*?)\\s*```', 1) WHEN 2 THEN substr(response_text, strpos(response_text, '{'))
    ELSE response_text END AS j FROM model_responses),
k AS (SELECT entry_id, j FROM b WHERE entry_id % 6 IN ({ok})),
rows_ AS (SELECT entry_id, 'first_name' AS field_name, json_extract_string(j, '$.first_name') AS v FROM k
  UNION ALL SELECT entry_id, 'is_renewal', json_extract_string(j, '$.is_renewal') FROM k
  UNION ALL SELECT entry_id, 'capitalization', json_extract_string(j, '$.capitalization') FROM k),
o AS (SELECT entry_id, field_name, CASE WHEN field_name = 'is_renewal' AND lower(v) IN ('checked', '✓') THEN 'true' ELSE v END AS value FROM rows_)
SELECT *, CAST(CASE WHEN value <> '' THEN 0.85 ELSE 0 END AS DOUBLE) AS confidence, 'model' AS source FROM o"""


@query("parse_flat_responses", ["model_responses"], "WITH " + FLAT.replace("{ok}", "0, 1, 2, 3"))
def _(v):
    return responses.parse_flat_responses(v.model_responses)[0].select("entry_id", "field_name", "value", "confidence", "source")


@query("parse_flat_rejects", ["model_responses"], "SELECT entry_id, response_text FROM model_responses WHERE entry_id % 6 IN (4, 5)")
def _(v):
    return responses.parse_flat_responses(v.model_responses)[1].select("entry_id", "response_text")


@query("repair_truncated_json", ["model_responses"], "WITH " + FLAT.replace("{ok}", "0, 1, 2, 3, 4").replace(
    "ELSE response_text END AS j", "WHEN 4 THEN regexp_extract(response_text, '(?s)^(.*),[^,]*$', 1) || '}' ELSE response_text END AS j"))
def _(v):
    return responses.parse_flat_responses(v.model_responses, repair=True)[0].select(
        "entry_id", "field_name", "value", "confidence", "source")


@query("parse_wrapped_responses", ["texts"], """
SELECT ok AS entry_id, ln, 'first_name' AS field_name, replace(name_text, '"', '') AS value, CASE WHEN h % 5 = 2 THEN '"' || CAST(h % 100 AS VARCHAR) || '"' ELSE CAST(h % 100 AS VARCHAR) END AS confidence_raw
FROM texts WHERE h % 5 <> 4""")
def _(v):
    kind, quote = F.col("h") % 5, F.when(F.col("h") % 5 == 2, '"').otherwise("")
    wrapped = F.concat(F.lit('{"fields": {"first_name": {"value": "'), "name_text", F.lit('", "confidence": '), quote,
                       (F.col("h") % 100).cast("string"), quote, F.lit("}}}"))
    body = F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), wrapped, F.lit("\n```\nDone"))).when(
        kind == 1, F.concat(F.lit("```\n"), wrapped, F.lit("\n```"))).when(kind == 4, "no json").otherwise(wrapped)
    rows = v.texts.select(F.col("ok").alias("entry_id"), "ln", body.alias("response_text"))
    return responses.parse_wrapped_responses(rows)[0].select("entry_id", "ln", "field_name", "value", "confidence_raw")


@query("parse_list_responses", ["texts"], """
SELECT ok AS entry_id, ln, 0 AS pos, 'first_name' AS field_name, trim(name_text) AS value,
  CASE h % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END::DOUBLE AS confidence FROM texts WHERE h % 5 <> 4
UNION ALL SELECT ok, ln, 2, 'note', '', 0.5 FROM texts WHERE h % 5 <> 4""")
def _(v):
    conf = F.element_at(F.array(*[F.lit(c) for c in ("1.5", '"high"', '"0.25"', "-3")]), (F.col("h") % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"extracted_fields": [{"field_name": " first_name ", "value": "'), "name_text",
                    F.lit('", "confidence": '), conf, F.lit('}, {"value": "nameless"}, {"field_name": "note", "confidence": []}]}'))
    rows = v.texts.select(F.col("ok").alias("entry_id"), "ln",
                          F.when(F.col("h") % 5 == 4, '["wrong shape"]').otherwise(body).alias("response_text"))
    return responses.parse_list_responses(rows)[0].select("entry_id", "ln", "pos", "field_name", "value", "confidence")


@query("escape_control_characters", [], """
SELECT doc_id, md5(replace(replace(text, chr(10), '\\u000a'), chr(9), '\\u0009')) AS escaped_md5 FROM documents""")
def _(v):
    return v.documents.select("doc_id", F.md5(responses.escape_control_characters(F.col("text"))).alias("escaped_md5"))


@query("resolution_requests", ["fields", "entries", "template_fields", "ocr_lines"], """
WITH u AS (SELECT e.entry_id, t.name, t.field_pos, row_number() OVER (PARTITION BY e.entry_id ORDER BY t.field_pos) AS n
  FROM entries e JOIN template_fields t USING (template_id) JOIN fields f ON f.entry_id = e.entry_id AND f.field_name = t.name AND f.confidence < 0.5),
b AS (SELECT entry_id, CAST(floor((n - 1) / 30) AS BIGINT) AS batch_no, count(*) AS n_fields, string_agg(name, ',' ORDER BY field_pos) AS names FROM u GROUP BY 1, 2),
p AS (SELECT entry_id, CAST(floor(line_no / 80) AS BIGINT) AS preview_no, string_agg('- ' || text || ' (conf=' || format('{:.2f}', confidence) || ')', chr(10) ORDER BY line_no) AS preview
  FROM ocr_lines GROUP BY 1, 2)
SELECT b.entry_id, batch_no, coalesce(preview_no, 0) AS preview_no, n_fields, names, md5(coalesce(preview, '')) AS preview_md5 FROM b LEFT JOIN p USING (entry_id)""")
def _(v):
    fields = v.fields.join(v.entries.select("entry_id", "template_id"), "entry_id").select(
        "entry_id", "template_id", "field_name", (F.col("confidence") < 0.5).alias("unresolved"),
        F.array("ocr_value").alias("context_lines"))
    return responses.resolution_requests(fields, v.template_fields, v.ocr_lines).select(
        "entry_id", "batch_no", "preview_no", F.size("requested").cast("bigint").alias("n_fields"),
        F.array_join("requested.name", ",").alias("names"), F.md5("ocr_preview").alias("preview_md5"))


@query("reextract_low_confidence", ["fields"], """
WITH x AS (SELECT *, confidence < 0.7 AND length(field_name) > 10 AS reextracted FROM fields)
SELECT entry_id, field_name, CASE WHEN reextracted THEN 'second ' || field_name ELSE ocr_value END AS ocr_value,
  CASE WHEN reextracted THEN 0.85 ELSE confidence END AS confidence, reextracted FROM x""")
def _(v):
    second = v.fields.select("entry_id", "field_name", F.when(
        F.length("field_name") > 10, F.concat(F.lit("second "), "field_name")).otherwise("").alias("value"))
    second = second.withColumn("pass_no", F.lit(2)).unionByName(
        second.where("value <> ''").withColumns({"value": F.lit("z"), "pass_no": F.lit(1)}))
    return responses.reextract_low_confidence(v.fields, second).select(
        "entry_id", "field_name", "ocr_value", "confidence", "reextracted")


# --- lifecycle -----------------------------------------------------------------------------------------------

def verifications(v):
    """One submission per entry; every third verifier is not the uploader."""
    values = v.verification_fields.groupBy("entry_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "new_value"))).alias("verified_fields"))
    return v.entries.select("entry_id", F.when(F.col("entry_id") % 3 == 0, (F.col("entry_id") * 7) % 100).otherwise(
        F.col("uploaded_by")).alias("verifier_id"), F.col("updated_at").alias("ts")).join(values, "entry_id")


CHECKED = """
c AS (SELECT e.entry_id, e.status, CASE WHEN e.entry_id % 3 = 0 THEN (e.entry_id * 7) % 100 ELSE uploaded_by END AS verifier_id, uploaded_by FROM entries e),
d AS (SELECT c.*, CASE WHEN coalesce(role, 'encoder') = 'encoder' AND uploaded_by <> verifier_id THEN 'not the uploader'
  WHEN status NOT IN ('extracted', 'verified') THEN 'wrong status' END AS reason FROM c LEFT JOIN users ON user_id = verifier_id)"""


@query("apply_verifications_fields", ["entries", "fields", "users", "verification_fields"], f"""
WITH {CHECKED} SELECT f.entry_id, f.field_name, CASE WHEN n.new_value IS NOT NULL THEN n.new_value ELSE verified_value END AS verified_value,
  CASE WHEN n.new_value IS NOT NULL THEN ocr_value IS DISTINCT FROM n.new_value ELSE was_corrected END AS was_corrected
FROM fields f LEFT JOIN d ON d.entry_id = f.entry_id AND reason IS NULL
LEFT JOIN verification_fields n ON n.entry_id = d.entry_id AND n.field_name = f.field_name""")
def _(v):
    done = lifecycle.apply_verifications(v.entries.withColumn("verified_data", F.lit(None)), v.fields, verifications(v), v.users)
    return done["fields"].select("entry_id", "field_name", "verified_value", "was_corrected")


@query("apply_verifications_entries", ["entries", "users", "verification_fields"], f"""
WITH {CHECKED}, n AS (SELECT entry_id, string_agg(field_name || '=' || new_value, ',' ORDER BY field_name) AS given FROM verification_fields GROUP BY 1)
SELECT e.entry_id, CASE WHEN reason IS NULL THEN 'verified' ELSE e.status END AS status,
  CASE WHEN reason IS NULL THEN verifier_id ELSE verified_by END AS verified_by,
  CASE WHEN reason IS NULL THEN given ELSE 'before=' || e.entry_id END AS verified_data
FROM entries e JOIN d ON e.entry_id = d.entry_id JOIN n ON n.entry_id = e.entry_id""")
def _(v):
    before = v.entries.withColumn("verified_data", F.create_map(F.lit("before"), F.col("entry_id").cast("string")))
    done = lifecycle.apply_verifications(before, v.fields, verifications(v), v.users)
    shown = F.transform(F.array_sort(F.map_entries("verified_data")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done["entries"].select("entry_id", "status", "verified_by", F.array_join(shown, ",").alias("verified_data"))


@query("apply_verifications_rejects", ["entries", "users"],
       f"WITH {CHECKED} SELECT entry_id, verifier_id, reason FROM d WHERE reason IS NOT NULL")
def _(v):
    done = lifecycle.apply_verifications(v.entries.withColumn("verified_data", F.lit(None)), v.fields, verifications(v), v.users)
    return done["rejects"].select("entry_id", "verifier_id", "reason")


@query("apply_verifications_audit", ["entries", "users"],
       f"WITH {CHECKED} SELECT verifier_id AS user_id, entry_id AS entity_id, 'verify' AS action FROM d WHERE reason IS NULL")
def _(v):
    done = lifecycle.apply_verifications(v.entries.withColumn("verified_data", F.lit(None)), v.fields, verifications(v), v.users)
    return done["audit_log"].select("user_id", "entity_id", "action")


def asked(v):
    return v.customer.select(F.col("c_custkey").alias("entry_id"))


ASKED = "(SELECT c_custkey FROM customer)"


@query("reset_for_retry_entries", ["entries"], f"""
WITH r AS (SELECT *, entry_id IN {ASKED} AND status IN ('uploaded', 'processing') AS x FROM entries)
SELECT entry_id, CASE WHEN x THEN 'uploaded' ELSE status END AS status, CASE WHEN NOT x THEN raw_ocr_data END AS raw_ocr_data,
  CASE WHEN NOT x THEN confidence_score END AS confidence_score, CASE WHEN NOT x THEN processing_time END AS processing_time FROM r""")
def _(v):
    return lifecycle.reset_for_retry(v.entries, v.fields, asked(v))[0].select(
        "entry_id", "status", "raw_ocr_data", "confidence_score", "processing_time")


@query("reset_for_retry_fields", ["entries", "fields"], f"""
SELECT entry_id, field_name FROM fields WHERE entry_id NOT IN (SELECT entry_id FROM entries WHERE entry_id IN {ASKED} AND status IN ('uploaded', 'processing'))""")
def _(v):
    return lifecycle.reset_for_retry(v.entries, v.fields, asked(v))[1].select("entry_id", "field_name")


def retries(v):
    """Every customer asks for the retry of the entry of its number (some do not exist) and of one of its own."""
    own = v.entries.groupBy(F.col("uploaded_by").alias("user_id")).agg(F.max("entry_id").alias("entry_id"))
    return v.customer.select(F.col("c_custkey").alias("entry_id"), F.col("c_custkey").alias("user_id")).unionByName(own)


RETRIES = """q AS (SELECT c_custkey AS entry_id, c_custkey AS user_id FROM customer UNION ALL SELECT max(entry_id), uploaded_by FROM entries GROUP BY 2),
k AS (SELECT q.*, CASE WHEN e.entry_id IS NULL THEN 'entry not found'
    WHEN coalesce(role, 'encoder') = 'encoder' AND uploaded_by IS DISTINCT FROM q.user_id THEN 'not the uploader'
    WHEN e.status NOT IN ('uploaded', 'processing') THEN 'cannot retry in status ' || e.status END AS reason
  FROM q LEFT JOIN entries e USING (entry_id) LEFT JOIN users u ON u.user_id = q.user_id)"""


@query("retry_requests_rejects", ["entries", "users"], f"WITH {RETRIES} SELECT entry_id, user_id, reason FROM k WHERE reason IS NOT NULL")
def _(v):
    return lifecycle.retry_requests(v.entries, v.fields, retries(v), v.users)["rejects"].select("entry_id", "user_id", "reason")


@query("retry_requests_entries", ["entries", "users"], f"""
WITH {RETRIES}, x AS (SELECT DISTINCT entry_id FROM k WHERE reason IS NULL)
SELECT entry_id, CASE WHEN x.entry_id IS NOT NULL THEN 'uploaded' ELSE status END AS status,
  CASE WHEN x.entry_id IS NULL THEN confidence_score END AS confidence_score FROM entries LEFT JOIN x USING (entry_id)""")
def _(v):
    return lifecycle.retry_requests(v.entries, v.fields, retries(v), v.users)["entries"].select("entry_id", "status", "confidence_score")


@query("delete_entries", ["entries", "fields"], f"""
SELECT entry_id, 'entry' AS kind, count(*) AS n FROM entries WHERE entry_id NOT IN {ASKED} GROUP BY 1
UNION ALL SELECT entry_id, 'field', count(*) FROM fields WHERE entry_id NOT IN {ASKED} GROUP BY 1""")
def _(v):
    left = lifecycle.delete_entries(v.entries, v.fields, asked(v))
    counts = [df.groupBy("entry_id").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
              for df, kind in zip(left, ("entry", "field"))]
    return counts[0].unionByName(counts[1])


@query("create_entries", ["entries", "templates"], """
SELECT entry_id, template_id, CASE WHEN template_id IN (SELECT template_id FROM templates) THEN 'uploaded' ELSE 'template not found' END AS outcome FROM entries""")
def _(v):
    created, rejects = lifecycle.create_entries(v.entries.select("entry_id", "template_id"), v.templates)
    return created.withColumnRenamed("status", "outcome").unionByName(rejects.withColumnRenamed("reason", "outcome"))


@query("replace_extraction_fields", ["fields", "texts"], """
WITH n AS (SELECT ok AS entry_id, 'new' || ln AS field_name, name_text AS ocr_value FROM texts WHERE rf = 'R')
SELECT entry_id, field_name, ocr_value FROM fields WHERE entry_id NOT IN (SELECT entry_id FROM n) UNION ALL SELECT * FROM n""")
def _(v):
    return lifecycle.replace_extraction(v.entries, v.fields, _reprocessed(v))[1].select("entry_id", "field_name", "ocr_value")


def _reprocessed(v):
    return v.texts.filter("rf = 'R'").selectExpr(
        "ok AS entry_id", "concat('new', ln) AS field_name", "name_text AS ocr_value", "conf AS confidence", "'ai' AS source")


@query("replace_extraction_entries", ["entries", "texts"], f"""
WITH n AS (SELECT ok AS entry_id, {avg4('conf')} AS c, count(*) AS k FROM texts WHERE rf = 'R' GROUP BY 1)
SELECT e.entry_id, CASE WHEN n.k IS NULL THEN status ELSE 'extracted' END AS status,
  CASE WHEN n.k IS NULL THEN confidence_score ELSE c END AS confidence_score, n.k AS field_count FROM entries e LEFT JOIN n ON e.entry_id = n.entry_id""")
def _(v):
    return lifecycle.replace_extraction(v.entries, v.fields, _reprocessed(v))[0].select(
        "entry_id", "status", "confidence_score", "field_count")


CATEGORY = """CASE WHEN error_type = 'TimeoutError' OR contains(m, 'timeout') OR error_type IN ('ConnectionError', 'ConnectionResetError', 'BrokenPipeError')
    OR contains(m, 'rate_limit') OR contains(m, '429') OR contains(m, 'ratelimit') OR contains(m, 'temporarily unavailable') OR contains(m, 'service unavailable') THEN 'transient'
  WHEN error_type IN ('FileNotFoundError', 'ValueError', 'KeyError') OR contains(m, 'not found') OR contains(m, 'authentication') OR contains(m, 'unauthorized')
    OR contains(m, 'forbidden') OR contains(m, 'invalid_request') OR contains(m, 'bad request') THEN 'permanent'
  WHEN contains(m, 'json') AND contains(m, 'decode') THEN 'partial' ELSE 'unknown' END"""


@query("classify_errors", ["errors"], f"""
WITH e AS (SELECT *, lower(message) AS m FROM errors), c AS (SELECT *, {CATEGORY} AS category FROM e)
SELECT event_id, category, category IN ('transient', 'unknown') AS retry_safe, CASE WHEN error_type = 'TimeoutError' OR contains(m, 'timeout') THEN 'Request timeout during ' || stage
  WHEN error_type IN ('ConnectionError', 'ConnectionResetError', 'BrokenPipeError') THEN 'Connection error during ' || stage
  WHEN contains(m, '429') THEN 'API rate limited during ' || stage WHEN category = 'transient' THEN 'Service temporarily unavailable during ' || stage
  WHEN error_type = 'FileNotFoundError' OR contains(m, 'not found') THEN 'Required resource not found during ' || stage || ' (image/template missing)'
  WHEN error_type IN ('ValueError', 'KeyError') THEN 'Invalid input/config during ' || stage || ' (bad field schema or image format)'
  WHEN contains(m, 'invalid_request') THEN 'Invalid request during ' || stage || ' (malformed API call)'
  WHEN category = 'permanent' THEN 'Authentication failure during ' || stage || ' (bad API key or perms)'
  WHEN category = 'partial' THEN 'Failed to parse API response during ' || stage || ' (some fields may have been extracted)'
  ELSE 'Unclassified error during ' || stage || ': ' || error_type END AS reason FROM c""")
def _(v):
    return lifecycle.classify_errors(v.errors).select("event_id", "category", "retry_safe", "reason")


@query("plan_retries", ["errors"], f"""
WITH e AS (SELECT *, lower(message) AS m FROM errors), c AS (SELECT *, {CATEGORY} AS category FROM e)
SELECT event_id, category IN ('transient', 'unknown') AND attempt < 3 AS retry,
  CAST(CASE category WHEN 'permanent' THEN 0 WHEN 'partial' THEN 2 ELSE 10 * pow(2, attempt) END AS BIGINT) AS delay_seconds,
  CASE WHEN category = 'partial' THEN 'extracted' ELSE 'uploaded' END AS next_status FROM c""")
def _(v):
    return lifecycle.plan_retries(lifecycle.classify_errors(v.errors)).select("event_id", "retry", "delay_seconds", "next_status")


def store(v):
    """Stored results: every image's result, kept under its key from 10 or 40 minutes before its upload."""
    return v.images.selectExpr("template_id", "md5", "created_at - make_interval(0, 0, 0, 0, 0, CAST(10 + entry_id % 2 * 30 AS INT)) AS stored_at", "concat('r', entry_id) AS result")


STORE = """s AS (SELECT DISTINCT template_id, md5, created_at - to_minutes(CAST(10 + entry_id % 2 * 30 AS INTEGER)) AS stored_at FROM images),
m AS (SELECT i.entry_id, i.md5, i.created_at, s.stored_at FROM images i ASOF LEFT JOIN s
  ON i.template_id = s.template_id AND i.md5 = s.md5 AND i.created_at >= s.stored_at)"""


@query("reuse_results_hits", ["images"], f"""
WITH {STORE} SELECT entry_id, md5, stored_at FROM m WHERE created_at < stored_at + INTERVAL 15 MINUTE""")
def _(v):
    return lifecycle.reuse_results(v.images.drop("text"), store(v), 900)[0].select("entry_id", "md5", "stored_at")


@query("reuse_results_misses", ["images"], f"""
WITH {STORE} SELECT entry_id, md5 FROM m WHERE coalesce(created_at >= stored_at + INTERVAL 15 MINUTE, true)""")
def _(v):
    return lifecycle.reuse_results(v.images.drop("text"), store(v), 900)[1].select("entry_id", "md5")


@query("invalidate_results", ["images"], "SELECT template_id, count(*) AS n FROM images WHERE template_id <> 1 GROUP BY 1")
def _(v):
    return lifecycle.invalidate(store(v), 1).groupBy("template_id").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_images", ["images"], """
SELECT template_id, md5, count(*) AS copies, min(entry_id) AS first_entry FROM images GROUP BY 1, 2 HAVING count(*) > 1""")
def _(v):
    return lifecycle.duplicate_images(v.images)


@query("duplicate_members", ["images"], """
WITH f AS (SELECT *, min(entry_id) OVER (PARTITION BY template_id, md5) AS first_entry FROM images)
SELECT entry_id, first_entry, template_id, md5 FROM f WHERE entry_id <> first_entry""")
def _(v):
    return lifecycle.duplicate_members(v.images)


@query("catalog_images", ["images"], """
SELECT path, CAST(entry_id AS VARCHAR) AS entry_id, md5, CAST(strlen(text) AS BIGINT) AS length,
  CASE WHEN text LIKE '%PDF%' AND left(text, 4) = '%PDF' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
  2024 AS year, CAST(entry_id % 12 + 1 AS INTEGER) AS month FROM images""")
def _(v):
    files = v.images.select("path", F.col("text").cast("binary").alias("content"))
    return documents.describe_images(files)


@query("detection_documents", ["detections"], """
SELECT entry_id, count(*) AS n, string_agg(name, '|' ORDER BY det_no) AS names, string_agg(state, '|' ORDER BY det_no) AS states FROM detections GROUP BY 1""")
def _(v):
    boxed = v.detections.withColumn("box", F.lit(None).cast("struct<top:double,left:double,bottom:double,right:double>"))
    nested = documents.detection_documents(boxed)
    return nested.select("entry_id", F.col("total_checkboxes_detected").cast("bigint").alias("n"),
                         F.array_join("checkboxes.name", "|").alias("names"), F.array_join("checkboxes.state", "|").alias("states"))


# --- progress ------------------------------------------------------------------------------------------------

@query("progress_changes", ["progress_events"], """
WITH l AS (SELECT *, lag(status) OVER w AS ps, lag(confidence_score) OVER w AS pc, row_number() OVER w AS n FROM progress_events
  WINDOW w AS (PARTITION BY form_id ORDER BY ts, event_id))
SELECT event_id, form_id, status, confidence_score FROM l WHERE n = 1 OR ps IS DISTINCT FROM status OR pc IS DISTINCT FROM confidence_score""")
def _(v):
    return lifecycle.progress_changes(v.progress_events).select("event_id", "form_id", "status", "confidence_score")


@query("latest_status", ["progress_events"], """
SELECT form_id, status, confidence_score, message, ts FROM (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY ts DESC, event_id DESC) AS n FROM progress_events) WHERE n = 1""")
def _(v):
    return lifecycle.latest_status(v.progress_events)


@query("stuck_entries", ["progress_events"], """
SELECT form_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY ts DESC, event_id DESC) AS n FROM progress_events)
WHERE n = 1 AND status = 'processing' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 MINUTE""")
def _(v):
    return lifecycle.stuck_entries(v.progress_events, "2024-01-31 00:00:00").select("form_id", "ts")


@query("latest_snapshot", ["progress_events"], """
SELECT form_id, status, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY form_id, status ORDER BY ts DESC, event_id DESC) AS n FROM progress_events) WHERE n = 1""")
def _(v):
    rows = v.progress_events.select("form_id", "status", "event_id", "ts")
    return lifecycle.latest_snapshot(rows, ["form_id", "status"], "ts")
