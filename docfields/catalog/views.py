"""Canonical tables derived from the given star-schema tables, by the same arithmetic in both engines.

Nothing is sampled or cut: every view covers its source tables whole. Forms are orders, fields are line
items, OCR lines are the lines of the documents, templates are the nations (a table of fixed size).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docfields.catalog.dialects import DUCK, SPARK
from docfields.functions.materialize import free_shuffles, materialize
from docfields.sources.templates import explode_template_fields

AS_OF = "2001-08-02"
DAYS = 365
BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations"]

# The fields every template of the views declares: name, label (None = defaulted), type, rest of the JSON.
SCHEMA_FIELDS: list[tuple[str, str | None, str, str]] = [
    ("birth_date", None, "date", ""),
    ("owner_phone", "Owner Phone", "phone", ""),
    ("capitalization", "Capitalization", "amount", '"required": true'),
    ("activity_service", "Activity Service", "checkbox", ""),
    ("first_name", None, "text", '"required": true'),
    ("biz_street", "Street", "text", ""),
    ("certificate_no", "Certificate No", "text", ""),
    ("word_the", "The", "text", ""),
    ("word_der", "Der", "text", '"extraction": {"anchor_labels": ["zzzz", "und ", "der "]}'),
    ("word_que", "Que", "text",
     '"extraction": {"anchor_labels": ["que ", "la "], "search_region": {"y_min": 0.25, "x_max": 0.9}}'),
    ("mark_is", "Is", "checkbox", '"extraction": {"strategy": "checkbox_mark", "anchor_labels": ["is "]}'),
    ("civil_status", "Status", "radio",
     '"options": ["single", "married", "legally_separated"], "extraction": {"anchor_labels": ["on ", "en "]}'),
    ("activity_retailer", "Retailer Activity", "checkbox", ""),
    ("partner_sss", "SSS Member", "checkbox", ""),
    ("same_as_business", "Same as Business", "checkbox", ""),
]


def _field_json(name: str, label: str | None, kind: str, rest: str) -> str:
    parts = [f'"name": "{name}"', f'"type": "{kind}"']
    if label is not None:
        parts.append(f'"label": "{label}"')
    if rest:
        parts.append(rest)
    return "{" + ", ".join(parts) + "}"


FIELDS_JSON = ", ".join(_field_json(*f) for f in SCHEMA_FIELDS)


def _li(d) -> str:
    """Every line item. The source repeats (order, number), so items are numbered anew by all their columns; after
    seven the kinds of value start again, and names get the number of the repetition (``rep``)."""
    return f"""
    SELECT ok, ln, (ln - 1) % 7 + 1 AS kind, CAST(floor((ln - 1) / 7) AS BIGINT) AS rep, pk, sk, qty, cents, rf, sd
    FROM (SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS BIGINT) AS qty,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS rf, l_shipdate AS sd,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS ln
      FROM {d.table('lineitem')}) i"""


def _texts(d) -> str:
    """Noisy raw strings per line item: dates, phones, amounts, marks, names, streets, numbers."""
    sub = "lpad(CAST((pk * 7919 + sk * 104729) % 100000000 AS STRING), 8, '0')"
    plain = "CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0')"
    return f"""
    SELECT t.*,
      CASE h % 7 WHEN 0 THEN {d.date('sd', 'dmy')} WHEN 1 THEN {d.date('sd', 'ymd')}
        WHEN 2 THEN {d.date('sd', 'long')} WHEN 3 THEN {d.date('sd', 'short')}
        WHEN 4 THEN translate({d.date('sd', 'dmy')}, '/01', '-Ol') WHEN 5 THEN '31/02/' || {d.date('sd', 'y')}
        ELSE ' ' || replace({d.date('sd', 'dmy')}, '/', '.') || ' ' END AS date_text,
      CASE h % 6 WHEN 0 THEN '091' || sub
        WHEN 1 THEN '+63 92' || substr(sub, 1, 1) || ' ' || substr(sub, 2, 3) || '-' || substr(sub, 5, 4)
        WHEN 2 THEN '(0917) ' || substr(sub, 1, 3) || '-' || substr(sub, 4, 4) WHEN 3 THEN '917' || substr(sub, 1, 7)
        WHEN 4 THEN translate('091' || sub, '01', 'Ol') ELSE sub END AS phone_text,
      CASE h % 7 WHEN 0 THEN '₱' || {d.money('cents / 100.0E0')} WHEN 1 THEN 'P ' || {plain}
        WHEN 2 THEN CAST(cents AS STRING) WHEN 3 THEN 'PHP ' || {plain}
        WHEN 4 THEN '-' || {plain} WHEN 5 THEN '$₱' || CAST(qty AS STRING)
        ELSE translate({plain}, '01', 'Ol') END AS amount_text,
      CASE h % 12 WHEN 0 THEN 'yes' WHEN 1 THEN 'X' WHEN 2 THEN '✓' WHEN 3 THEN 'no' WHEN 4 THEN '0'
        WHEN 5 THEN '☐' WHEN 6 THEN 'maybe' WHEN 7 THEN '' WHEN 8 THEN 'Checked ' WHEN 9 THEN 'true'
        WHEN 10 THEN 'service' ELSE '[]' END AS mark_text,
      CASE pk % 5 WHEN 0 THEN 'JUAN' WHEN 1 THEN 'maria' WHEN 2 THEN 'o''brien' WHEN 3 THEN 'JOHN' ELSE 'Smith l' END
        || ' ' || CASE qty % 4 WHEN 0 THEN 'dela cruz' WHEN 1 THEN 'SANTOS' WHEN 2 THEN 'reyes-garcia'
        ELSE 'de  leon 3rd' END AS name_text,
      CASE h % 9 WHEN 0 THEN '123 rizal st.' WHEN 1 THEN '45 mabini ave , brgy. 7' WHEN 2 THEN 'cavit laguna blvd'
        WHEN 3 THEN 'Qurzon city' WHEN 4 THEN 'BGC no. 5' WHEN 5 THEN 'makati av' WHEN 6 THEN 'IlOilo Sta Ana'
        WHEN 7 THEN 'st luke barangay 3' ELSE '  Lot 5   Block 8 ' END AS street_text,
      CASE h % 6 WHEN 0 THEN 'NR0:' || substr(sub, 1, 6) WHEN 1 THEN 'NR ' || substr(sub, 1, 6)
        WHEN 2 THEN 'nr0' || substr(sub, 1, 6) || '9' WHEN 3 THEN 'ABC-' || sub
        WHEN 4 THEN substr(sub, 1, 3) || '-' || substr(sub, 4, 3) || '-' || substr(sub, 6, 3)
        ELSE sub || substr(sub, 1, 4) END AS number_text
    FROM (SELECT ok, ln, kind, rep, pk, sk, qty, cents, rf, sd, pk * 7 + qty AS h, {sub} AS sub,
            CAST((pk * 37 + qty * 101) % 10001 AS BIGINT) / 10000.0E0 AS conf FROM {d.table('li')}) t"""


def _templates(d) -> str:
    return f"""
    SELECT CAST(n_nationkey AS BIGINT) AS template_id,
      CASE WHEN n_regionkey = 0 THEN 'DTI ' ELSE 'Form ' END || n_name AS name,
      'Form of ' || n_name AS description,
      CASE WHEN n_nationkey = 24 THEN '{d.lb}"fields": []{d.rb}' WHEN n_nationkey = 23 THEN 'not json'
        ELSE '{d.lb}"fields": [{FIELDS_JSON.replace('{', d.lb).replace('}', d.rb)}]{d.rb}' END AS field_schema,
      n_nationkey % 6 <> 5 AS is_active
    FROM {d.table('nation')}"""


def _template_fields_duck(d) -> str:
    """The exploded schema as SQL sees it; the Spark side derives it with ``explode_template_fields``."""
    rows = []
    for pos, (name, label, kind, rest) in enumerate(SCHEMA_FIELDS):
        shown = label if label is not None else name.replace("_", " ").title()
        rows.append(f"({pos}, '{name}', '{shown}', '{kind}', {'true' if 'required' in rest else 'false'})")
    return f"""
    SELECT template_id, f.field_pos, f.name, f.label, f.type, f.required FROM {d.table('templates')},
      (VALUES {', '.join(rows)}) AS f(field_pos, name, label, type, required)
    WHERE template_id NOT IN (23, 24)"""


def _entries(d) -> str:
    seconds = ("CAST(CAST(floor((o_orderkey * 13 % 3000) / 100) AS BIGINT) AS STRING) || '.' || "
               "lpad(CAST(o_orderkey * 13 % 100 AS STRING), 2, '0')")
    return f"""
    SELECT o_orderkey AS entry_id, o_custkey % 27 AS template_id, o_custkey AS uploaded_by,
      'dev' || CAST(o_custkey % 50 AS STRING) AS device_id,
      CASE WHEN o_orderkey % 5 >= 3 THEN (o_custkey * 3) % 1000 END AS verified_by,
      'forms/' || {d.date('o_orderdate', 'path')} || '/' || CAST(o_orderkey AS STRING) || '/page.png' AS image_url,
      CASE o_orderkey % 5 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'extracted'
        WHEN 3 THEN 'verified' ELSE 'archived' END AS status,
      CASE WHEN o_orderkey % 17 = 0 THEN NULL
        WHEN o_orderkey % 3 = 0 THEN '{d.lb}"raw_lines_count": ' || CAST(o_orderkey % 40 AS STRING) || '{d.rb}'
        ELSE '{d.lb}"raw_lines_count": ' || CAST(o_orderkey % 40 AS STRING) || ', "processing_time": ' || {seconds}
          || '{d.rb}' END AS raw_ocr_data,
      CASE WHEN o_orderkey % 50 <> 2 THEN CAST((o_orderkey * 37) % 10001 AS BIGINT) / 10000.0E0 END AS confidence_score,
      CAST((o_orderkey * 13) % 3000 AS BIGINT) / 100.0E0 AS processing_time,
      o_orderdate AS created_at, {d.days('o_orderdate', 'CAST(o_orderkey % 10 AS INT)')} AS updated_at
    FROM {d.table('orders')}"""


REPEATED = " || CASE WHEN rep > 0 THEN '_' || CAST(rep + 1 AS STRING) ELSE '' END"


def _field_name(d) -> str:
    names = [f[0] for f in SCHEMA_FIELDS[:7]]
    return "CASE kind " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, 1)) + f" END{REPEATED}"


def _fields(d) -> str:
    value = ("CASE kind WHEN 1 THEN date_text WHEN 2 THEN phone_text WHEN 3 THEN amount_text WHEN 4 THEN mark_text "
             "WHEN 5 THEN name_text WHEN 6 THEN street_text ELSE number_text END")
    return f"""
    SELECT entry_id, field_name, ocr_value,
      CASE rf WHEN 'R' THEN 'fixed ' || sub WHEN 'A' THEN ocr_value ELSE CASE WHEN h % 2 = 0 THEN '' END END
        AS verified_value,
      confidence, was_corrected, created_at, source
    FROM (SELECT ok AS entry_id, {_field_name(d)} AS field_name, CASE WHEN h % 29 <> 0 THEN {value} END AS ocr_value,
        conf AS confidence, rf = 'R' AS was_corrected, sd AS created_at, rf, sub, h,
        CASE sk % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'ai' WHEN 2 THEN 'rules' ELSE 'checkbox_detection' END
          AS source
      FROM {d.table('texts')}) f"""


def _users(d) -> str:
    return f"""
    SELECT c_custkey AS user_id, c_name AS full_name, CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'encoder' END
      AS role, c_custkey % 7 <> 0 AS is_active
    FROM {d.table('customer')}"""


def _ocr_lines(d) -> str:
    marks = ("CASE (doc_id * 3 + line_no) % 13 WHEN 0 THEN '✓ ' WHEN 1 THEN '[x] ' WHEN 2 THEN '☐ ' "
             "WHEN 3 THEN '[ ] ' WHEN 4 THEN '~' ELSE '' END")
    return f"""
    SELECT doc_id AS entry_id, line_no, {marks} ||
      CASE WHEN (doc_id + line_no) % 5 = 0 THEN {d.colon_after_first_word('line')} ELSE line END AS text,
      CAST((doc_id * 31 + line_no * 17) % 101 AS BIGINT) / 100.0E0 AS confidence,
      CAST(floor(line_no / 3) * 24 + (line_no % 3) * 4 AS DOUBLE) AS box_top,
      CAST((line_no % 3) * 180 + (doc_id % 7) * 5 AS DOUBLE) AS box_left,
      CAST(floor(line_no / 3) * 24 + (line_no % 3) * 4 + 14 AS DOUBLE) AS box_bottom,
      CAST((line_no % 3) * 180 + (doc_id % 7) * 5 + least(8 * length(line), 150) AS DOUBLE) AS box_right
    FROM ({d.split_lines('doc_id', 'text', d.table('documents'))}) s"""


LABELS = ["Manufacturer", "Producer", "Service", "Retailer", "Wholesaler", "Importer", "Exporter", "Single",
          "Married", "Widowed", "Legally Separated", "Male", "Female", "NEW", "RENEWAL", "With TIN", "Without TIN"]


def _mark_lines(d) -> str:
    """Short, box-like lines: one per line item, labelled from the form's words or the part's name."""
    label = "CASE pk % 23 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(LABELS)) + \
        " WHEN 17 THEN 'A. SECTION OF ' || upper(p_name) WHEN 18 THEN 'a longer line about ' || p_name ELSE p_name END"
    return f"""
    SELECT entry_id, line_no, text, confidence, CAST(line_no * 18 + jitter AS DOUBLE) AS box_top,
      CAST(lft AS DOUBLE) AS box_left, CAST(line_no * 18 + jitter + 12 AS DOUBLE) AS box_bottom,
      CAST(lft + 60 AS DOUBLE) AS box_right
    FROM (SELECT ok AS entry_id, row_number() OVER (PARTITION BY ok ORDER BY ln) - 1 AS line_no,
        CASE h % 16 WHEN 0 THEN '✓ ' WHEN 1 THEN '[x] ' WHEN 2 THEN '☐ ' WHEN 3 THEN '[ ] ' WHEN 4 THEN '~ '
          WHEN 5 THEN '■ ' WHEN 6 THEN 'x ' ELSE '' END || {label} AS text, conf AS confidence,
        (pk % 4) * 15 AS jitter, (pk % 3) * 45 AS lft
      FROM {d.table('texts')} JOIN {d.table('part')} ON p_partkey = pk) m"""


def _visual_boxes(d) -> str:
    return f"""
    SELECT ok AS entry_id, ln AS box_no, CAST((pk % 3) * 45 + (sk % 7) * 10 AS DOUBLE) AS x,
      CAST((ln - 1) * 18 + (qty % 5) * 9 AS DOUBLE) AS y, 12.0E0 AS width, 12.0E0 AS height,
      conf * 100 AS fill_percentage, conf > 0.5 AS is_checked, conf AS confidence
    FROM {d.table('texts')}"""


def _detections(d) -> str:
    names = ["activity_service", "Activity_Service", "checkbox_activity_service_box", "field_service activity",
             "retailer activiti", "activity_retailer", "SSS Membr", "input_sss partner", "same as busines", "other mark",
             "partner_sss_member", "the same/as business"]
    name = "CASE pk % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
    return f"""
    SELECT ok AS entry_id, ln AS det_no, {name} AS name,
      CASE h % 3 WHEN 0 THEN 'checked' WHEN 1 THEN 'unchecked' ELSE 'unclear' END AS state, conf AS confidence,
      name_text AS anchor_text
    FROM {d.table('texts')}"""


def _responses(d) -> str:
    """Model responses: JSON objects of field values, bare, fenced, with leading chatter or cut off."""
    body = (f"'{d.lb}\"first_name\": \"' || replace(c_name, '#', ' ') || '\", \"is_renewal\": \"' || "
            "CASE o_orderkey % 5 WHEN 0 THEN 'Checked' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN '✓' ELSE 'maybe' END "
            f"|| '\", \"capitalization\": ' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) || '")
    return f"""
    SELECT o_orderkey AS entry_id, CAST(o_orderkey % 2 + 1 AS INT) AS pass_no,
      CASE o_orderkey % 6 WHEN 0 THEN {body}{d.rb}'
        WHEN 1 THEN '```json\n' || {body}{d.rb}' || '\n```'
        WHEN 2 THEN 'Here it is: ' || {body}{d.rb}'
        WHEN 3 THEN '```\n' || {body}{d.rb}' || '\n```'
        WHEN 4 THEN {body}, "owner_email": "a@b'
        ELSE 'no answer' END AS response_text
    FROM {d.table('orders')} JOIN {d.table('customer')} ON c_custkey = o_custkey"""


def _progress(d) -> str:
    return f"""
    SELECT event_id, user_id AS form_id, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
        WHEN 'signup' THEN 'uploaded' WHEN 'purchase' THEN 'extracted' ELSE 'verified' END AS status,
      CASE WHEN event_type IN ('purchase', 'error') THEN CAST(floor(value / 60) AS DOUBLE) / 10.0E0 END AS confidence_score,
      event_type AS message, ts
    FROM {d.table('events')}"""


def _errors(d) -> str:
    types = ["TimeoutError", "ConnectionError", "RuntimeError", "FileNotFoundError", "ValueError", "KeyError",
             "JSONDecodeError", "BrokenPipeError", "Exception"]
    messages = ["Request Timeout after 30s", "connection reset", "HTTP 429 rate_limit", "Service Unavailable",
                "template not found", "bad value", "Authentication failed", "invalid_request: body",
                "JSON decode failed", "temporarily unavailable", "Forbidden", "something odd"]
    kind = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(types)) + " END"
    text = "CASE (event_id + user_id) % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(messages)) + " END"
    return f"""
    SELECT event_id, user_id AS entry_id, CASE event_id % 3 WHEN 0 THEN 'download' WHEN 1 THEN 'ocr' ELSE 'save' END
      AS stage, {kind} AS error_type, {text} AS message, CAST(event_id % 4 AS INT) AS attempt, ts
    FROM {d.table('events')}"""


def _images(d) -> str:
    return f"""
    SELECT 'forms/2024/' || lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') || '/' || CAST(doc_id AS STRING) || '/' || source
      || '.txt' AS path, doc_id AS entry_id, doc_id % 3 AS template_id, md5(text) AS md5,
      {d.minutes(d.instant('2024-01-01 00:00:00'), 'CAST(doc_id % 240 AS INT)')} AS created_at, text
    FROM {d.table('documents')}"""


def _verification_fields(d) -> str:
    """Submitted values in long form: one row per (entry, field name)."""
    return f"""
    SELECT entry_id, field_name, CASE WHEN length(field_name) % 2 = 0 THEN 'checked by hand'
      ELSE coalesce(ocr_value, 'none') END AS new_value FROM {d.table('fields')}
    UNION ALL SELECT entry_id, 'unknown_field', 'x' FROM {d.table('entries')}"""


def _post_fields(d) -> str:
    part = ("CASE h % 5 WHEN 0 THEN '199O' WHEN 1 THEN '85' WHEN 2 THEN 'l3' WHEN 3 THEN '2' ELSE 'abc' END")
    return f"""
    SELECT ok AS entry_id, CASE kind WHEN 1 THEN 'first_name'
        WHEN 2 THEN CASE h % 3 WHEN 0 THEN 'birth_year' WHEN 1 THEN 'birth_month' ELSE 'birth_day' END
        WHEN 3 THEN 'biz_mobile' WHEN 4 THEN 'owners_tin' WHEN 5 THEN 'biz_street' WHEN 6 THEN 'asset'
        ELSE CASE h % 2 WHEN 0 THEN 'employees_total' ELSE 'notes' END END{REPEATED} AS field_name,
      CASE kind WHEN 1 THEN name_text WHEN 2 THEN {part} WHEN 3 THEN phone_text WHEN 4 THEN number_text
        WHEN 5 THEN street_text WHEN 6 THEN amount_text ELSE CASE h % 3 WHEN 0 THEN CAST(qty AS STRING) || ' pax'
          WHEN 1 THEN '  l5 , 6 . ' ELSE 'none' END END AS value,
      conf AS confidence FROM {d.table('texts')}"""


def _bnr_fields(d) -> str:
    return f"""
    SELECT ok AS entry_id, CASE kind WHEN 1 THEN 'dob_year' WHEN 2 THEN 'dob_day' WHEN 3 THEN 'biz_house_building'
        WHEN 4 THEN 'biz_city_municipality' WHEN 5 THEN 'first_name' WHEN 6 THEN 'suffix' ELSE 'activity_service' END
        {REPEATED} AS field_name,
      CASE kind WHEN 1 THEN CASE h % 5 WHEN 0 THEN 'I985' WHEN 1 THEN '85' WHEN 2 THEN '4O' WHEN 3 THEN 'abc' ELSE '2001' END
        WHEN 2 THEN CASE h % 4 WHEN 0 THEN '7' WHEN 1 THEN '32' WHEN 2 THEN '15th' ELSE 'x' END
        WHEN 3 THEN street_text
        WHEN 4 THEN CASE h % 5 WHEN 0 THEN 'Manila' WHEN 1 THEN 'city of iloilo' WHEN 2 THEN 'QUEZON' WHEN 3 THEN ''
          ELSE 'Baguio ' END
        WHEN 5 THEN name_text WHEN 6 THEN CASE h % 3 WHEN 0 THEN 'Jr.' WHEN 1 THEN '' ELSE ' III ' END
        ELSE mark_text END AS value,
      conf AS confidence, CASE WHEN sk % 3 = 0 THEN 'checkbox_detection' ELSE 'ai' END AS source FROM {d.table('texts')}
    UNION ALL
    SELECT ok, CASE kind WHEN 1 THEN 'dob_month' WHEN 2 THEN 'certificate_no' WHEN 3 THEN 'biz_street'
        WHEN 4 THEN 'biz_province' WHEN 5 THEN 'last_name' WHEN 6 THEN 'capitalization' ELSE 'biz_phone' END
        {REPEATED},
      CASE kind WHEN 1 THEN CASE h % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'S' WHEN 2 THEN '13' ELSE 'May' END
        WHEN 2 THEN number_text WHEN 3 THEN street_text WHEN 4 THEN CASE WHEN h % 2 = 0 THEN 'Cavite' ELSE '' END
        WHEN 5 THEN CASE qty % 3 WHEN 0 THEN 'DELA CRUZ' WHEN 1 THEN 's4ntos' ELSE '' END
        WHEN 6 THEN amount_text ELSE phone_text END,
      conf, 'ai' FROM {d.table('texts')}"""


VIEWS: dict[str, Callable] = {
    "li": _li, "texts": _texts, "templates": _templates, "template_fields": _template_fields_duck,
    "entries": _entries, "fields": _fields, "users": _users, "ocr_lines": _ocr_lines, "mark_lines": _mark_lines,
    "visual_boxes": _visual_boxes, "detections": _detections, "model_responses": _responses,
    "progress_events": _progress, "errors": _errors, "images": _images,
    "verification_fields": _verification_fields, "post_fields": _post_fields, "bnr_fields": _bnr_fields,
}
REQUIRES: dict[str, list[str]] = {
    "texts": ["li"], "template_fields": ["templates"], "fields": ["texts"], "mark_lines": ["texts"],
    "visual_boxes": ["texts"], "detections": ["texts"], "verification_fields": ["fields", "entries"],
    "post_fields": ["texts"], "bnr_fields": ["texts"],
}
_BOXED = {"ocr_lines", "mark_lines"}
# Text-heavy sources of these views; see Views.spread.
_SPREAD = {"ocr_lines": "documents", "model_responses": "orders", "images": "documents"}


class Views:
    """Lazily built canonical DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table over all cores. Each given file is one row group and would be one task; a table of a
        cluster is dealt out in the same way."""
        return self.table(name).repartition(self.spark.sparkContext.defaultParallelism)

    def stored(self, name: str) -> DataFrame:
        """The view as a table of its own, as OCR lines would be; for jobs that read it several times."""
        key = f"stored:{name}"
        if key not in self._built:
            self._built[key] = materialize(getattr(self, name))
            free_shuffles(self.spark)
        return self._built[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in BASE_TABLES):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.table(name)
        if name == "template_fields":
            return explode_template_fields(self.templates)[0]
        text = VIEWS[name](SPARK)
        used = [t for t in [*BASE_TABLES, *VIEWS] if f"{{{t}}}" in text]
        sources = {t: self.spread(t) if _SPREAD.get(name) == t else getattr(self, t) for t in used}
        df = self.spark.sql(text, **sources)
        if name in _BOXED:
            df = df.selectExpr(
                "entry_id", "line_no", "text", "confidence",
                "named_struct('top', box_top, 'left', box_left, 'bottom', box_bottom, 'right', box_right) AS box")
        return df


def with_views(sql: str, views: list[str], recursive: bool = False) -> str:
    """The DuckDB text of a query: the needed views as common table expressions, then ``sql``."""
    order: list[str] = []

    def need(name: str) -> None:
        for inner in REQUIRES.get(name, []):
            need(inner)
        if name not in order:
            order.append(name)

    for view in views:
        need(view)
    ctes = [f"{name} AS ({VIEWS[name](DUCK)})" for name in order]
    body, lead = sql.strip(), "WITH RECURSIVE" if recursive else "WITH"
    if body[:5].upper() == "WITH ":
        return f"{lead} {', '.join([*ctes, body[5:].strip()])}"
    return f"{lead} {', '.join(ctes)} {body}" if ctes else body
