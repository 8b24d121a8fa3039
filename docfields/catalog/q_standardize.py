"""Standardisation profiles against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.catalog.registry import avg4, query
from docfields.operators import joins, reports
from docfields.operators import standardize as std
from docfields.operators.standardize import bnr, ocr, post, schema


def words(items: list[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


MONTH_LIST = f"[{words(list(schema.MONTHS))}]"
MONTH_NUMBERS = f"[{', '.join(str(n) for n in schema.MONTHS.values())}]"


def _date_cte(source: str, order: str) -> str:
    """CTEs from ``source`` (id, raw) to ``dated`` (id, shown) where shown is NULL for a bad date."""
    if order == "dmy":
        numeric = "CASE WHEN num THEN n2 END, CASE WHEN num THEN n1 END"
        name = (f"list_filter({MONTH_LIST}, lambda m: regexp_matches(v, '(?i)(?:(\\d{{1,2}})\\s+)?' || m || "
                "'(?:\\s+(\\d{1,2}),?)?\\s+(\\d{4})'))[1]")
        pattern = "'(?i)(?:(\\d{1,2})\\s+)?' || nm || '(?:\\s+(\\d{1,2}),?)?\\s+(\\d{4})'"
        day = f"coalesce(try_cast(regexp_extract(v, {pattern}, 1) AS INT), try_cast(regexp_extract(v, {pattern}, 2) AS INT))"
        year = f"try_cast(regexp_extract(v, {pattern}, 3) AS INT)"
    else:
        numeric = ("CASE WHEN num THEN CASE WHEN n1 > 12 THEN n2 ELSE n1 END END, "
                   "CASE WHEN num THEN CASE WHEN n1 > 12 THEN n1 ELSE n2 END END")
        name = (f"list_filter({MONTH_LIST}, lambda m: regexp_matches(v, '(?i)^(' || m || ')\\s+(\\d{{1,2}})[,\\s]+(\\d{{4}})$') "
                "OR regexp_matches(v, '(?i)^(\\d{1,2})\\s+(' || m || ')[,\\s]+(\\d{4})$'))[1]")
        day = "try_cast(regexp_extract(v, '(?:^|[^0-9])([0-9]{1,2})(?:[^0-9]|$)', 1) AS INT)"
        year = "try_cast(regexp_extract(v, '([0-9]{4})$', 1) AS INT)"
    month_numeric, day_numeric = numeric.split(", CASE WHEN num", 1)
    day_numeric = "CASE WHEN num" + day_numeric
    return f"""
a AS (SELECT *, trim(coalesce(raw, '')) AS v FROM {source}),
b AS (SELECT *, regexp_matches(v, '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}$') AS iso,
  regexp_matches(v, '^\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{4}}$') AS num, {name} AS nm FROM a),
c AS (SELECT *, try_cast(regexp_extract(v, '^(\\d+)[-/](\\d+)[-/](\\d+)$', 1) AS INT) AS n1,
  try_cast(regexp_extract(v, '^(\\d+)[-/](\\d+)[-/](\\d+)$', 2) AS INT) AS n2,
  try_cast(regexp_extract(v, '^(\\d+)[-/](\\d+)[-/](\\d+)$', 3) AS INT) AS n3 FROM b),
d AS (SELECT *, CASE WHEN iso THEN n1 WHEN num THEN n3 WHEN nm IS NOT NULL THEN {year} END AS yy,
  CASE WHEN iso THEN n2 WHEN num THEN {month_numeric} WHEN nm IS NOT NULL
    THEN {MONTH_NUMBERS}[list_position({MONTH_LIST}, nm)] END AS mm,
  CASE WHEN iso THEN n3 WHEN num THEN {day_numeric} WHEN nm IS NOT NULL THEN {day} END AS dd FROM c),
dated AS (SELECT *, CASE WHEN yy BETWEEN 1950 AND 2030 THEN strftime(try_cast(lpad(yy::VARCHAR, 4, '0') || '-' ||
  lpad(mm::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') AS DATE), '%d/%m/%Y') END AS shown FROM d)"""


def _apply(v, kind: str, raw: str, parsed, date_order: str = "dmy"):
    """One rule over every raw string of its kind: (entry, line item, value, confidence change)."""
    source = v.texts.select(F.col("ok").alias("entry_id"), "ln", F.col(raw).alias("raw"))
    done = parsed(source).withColumn("value_out", F.coalesce("value_out", F.lit("")))
    return done.select("entry_id", "ln", "value_out", F.round(
        schema.conf_delta(F.lit(kind), F.col("raw"), F.col("value_out"), date_order), 9).alias("conf_delta"))


for _order, _bad in (("dmy", "-0.2"), ("auto_mdy", "-0.25")):
    query(f"schema_date_{_order}", ["texts"], f"""
WITH raws AS (SELECT ok AS entry_id, ln, date_text AS raw FROM texts), {_date_cte('raws', _order)}
SELECT entry_id, ln, coalesce(shown, '') AS value_out,
  CAST(CASE WHEN shown IS NULL THEN {_bad} ELSE 0.1 END AS DOUBLE) AS conf_delta FROM dated""")(
        lambda v, order=_order: _apply(
            v, "date", "date_text", lambda df: schema.parse_dates(df, "raw", "value_out", order), order))

PHONE = """
CASE WHEN starts_with(k, '+63') THEN substr(k, 2) WHEN starts_with(k, '63') THEN k WHEN starts_with(k, '09')
  THEN '63' || substr(k, 2) WHEN starts_with(k, '9') AND length(k) >= 10 THEN '63' || k END"""


@query("schema_phone", ["texts"], f"""
WITH a AS (SELECT ok AS entry_id, ln, regexp_replace(phone_text, '[^0-9+]', '', 'g') AS k FROM texts),
b AS (SELECT *, {PHONE} AS p FROM a), c AS (SELECT *, coalesce(length(p) = 12 AND regexp_matches(p, '^639[012]'), false) AS good FROM b)
SELECT entry_id, ln, CASE WHEN good THEN '+' || p ELSE '' END AS value_out,
  CAST(CASE WHEN good THEN 0.05 ELSE -0.2 END AS DOUBLE) AS conf_delta FROM c""")
def _(v):
    return _apply(v, "phone", "phone_text", lambda df: schema.parse_phones(df, "raw", "value_out"))


@query("schema_checkbox", ["texts"], f"""
WITH a AS (SELECT ok AS entry_id, ln, lower(trim(mark_text)) AS w FROM texts)
SELECT entry_id, ln, CASE WHEN w IN ({words(schema.YES_WORDS)}) THEN 'Yes' WHEN w IN ({words(schema.NO_WORDS)}) THEN 'No'
  ELSE '' END AS value_out, CAST(CASE WHEN w = '' THEN 0 WHEN w IN ({words(schema.YES_WORDS + schema.NO_WORDS)}) THEN 0.05
  ELSE -0.05 END AS DOUBLE) AS conf_delta FROM a""")
def _(v):
    return _apply(v, "checkbox", "mark_text", lambda df: df.withColumn("value_out", schema.checkbox_value(F.col("raw"))))


AMOUNT_CTE = """
a1 AS (SELECT *, trim(coalesce(raw, '')) AS av FROM {source}),
b1 AS (SELECT *, len(regexp_extract_all(av, '[₱$€£¥]')) + len(regexp_extract_all(av, 'P[0-9\\s]')) AS signs,
  translate(av, '₱$€£¥P ', '') AS bare FROM a1),
c1 AS (SELECT *, CASE WHEN signs <= 1 AND regexp_matches(bare, '^-?\\d{{1,3}}(,?\\d{{3}})*\\.?\\d{{0,2}}$')
  THEN CASE WHEN starts_with(bare, '-') THEN '-' ELSE '' END ||
    format('{{:,.2f}}', CAST(translate(ltrim(bare, '-'), ',', '') AS DOUBLE)) END AS shown1 FROM b1)"""


@query("schema_amount", ["texts"], f"""
WITH raws AS (SELECT ok AS entry_id, ln, amount_text AS raw FROM texts), {AMOUNT_CTE.format(source='raws')}
SELECT entry_id, ln, coalesce(shown1, '') AS value_out,
  CAST(CASE WHEN shown1 IS NULL THEN -0.2 ELSE 0.08 END AS DOUBLE) AS conf_delta FROM c1""")
def _(v):
    return _apply(v, "amount", "amount_text", lambda df: schema.parse_amounts(df, "raw", "value_out"))


def typed_fields(v):
    fields = joins.fields_with_entries(v.fields, v.entries, "template_id")
    return joins.with_field_schema(fields, v.template_fields, "type", "required")


SCHEMA_CTES = f"""
WITH raws AS (SELECT f.entry_id, f.field_name, f.ocr_value AS raw, f.confidence, e.template_id, t.type, t.required
  FROM fields f JOIN entries e ON f.entry_id = e.entry_id
  LEFT JOIN template_fields t ON t.template_id = e.template_id AND t.name = f.field_name),
{_date_cte('raws', 'dmy')}, {AMOUNT_CTE.format(source='dated')},
p AS (SELECT *, regexp_replace(v, '[^0-9+]', '', 'g') AS k, lower(v) AS w FROM c1),
q AS (SELECT *, {PHONE} AS ph FROM p),
r AS (SELECT *, CASE type WHEN 'date' THEN coalesce(shown, '')
    WHEN 'phone' THEN CASE WHEN length(ph) = 12 AND regexp_matches(ph, '^639[012]') THEN '+' || ph ELSE '' END
    WHEN 'checkbox' THEN CASE WHEN w IN ({words(schema.YES_WORDS)}) THEN 'Yes' WHEN w IN ({words(schema.NO_WORDS)}) THEN 'No' ELSE '' END
    WHEN 'amount' THEN coalesce(shown1, '') ELSE raw END AS value_out FROM q),
s AS (SELECT *, CASE type WHEN 'date' THEN CASE WHEN value_out = '' THEN -0.2 ELSE 0.1 END
    WHEN 'phone' THEN CASE WHEN value_out = '' THEN -0.2 ELSE 0.05 END
    WHEN 'checkbox' THEN CASE WHEN value_out <> '' THEN 0.05 WHEN w = '' THEN 0 ELSE -0.05 END
    WHEN 'amount' THEN CASE WHEN value_out = '' THEN -0.2 ELSE 0.08 END ELSE 0 END
  + CASE WHEN type IS NULL OR NOT required THEN 0 WHEN trim(coalesce(value_out, '')) <> '' THEN 0.05 ELSE -0.25 END AS delta FROM r)"""


@query("standardize_schema", ["fields", "entries", "template_fields"], SCHEMA_CTES + """
SELECT entry_id, field_name, value_out, CAST(delta AS DOUBLE) AS conf_delta,
  round(greatest(0.0, least(1.0, confidence + CAST(delta AS DOUBLE))), 9) AS conf_out,
  value_out IS DISTINCT FROM raw AS changed FROM s""")
def _(v):
    return std.standardize_schema(typed_fields(v)).select(
        "entry_id", "field_name", "value_out", "conf_delta", "conf_out", "changed")


@query("before_after_rules", ["fields", "entries", "template_fields"], SCHEMA_CTES + f"""
SELECT template_id, count(CASE WHEN coalesce(raw, '') <> '' THEN 1 END) AS filled_before, coalesce({avg4('confidence')}, 0.0) AS avg_confidence_before,
  count(CASE WHEN coalesce(value_out, '') <> '' THEN 1 END) AS filled_after,
  coalesce({avg4('round(greatest(0.0, least(1.0, confidence + CAST(delta AS DOUBLE))), 9)')}, 0.0) AS avg_confidence_after FROM s GROUP BY 1""")
def _(v):
    after = std.standardize_schema(typed_fields(v))
    before = after.selectExpr("template_id", "value_in AS value", "conf_in AS confidence")
    rules = after.selectExpr("template_id", "value_out AS value", "conf_out AS confidence")
    return reports.before_after(before, rules, ["template_id"])


@query("clamp_confidence", ["texts"], """
SELECT ok AS entry_id, ln, greatest(0.0, least(1.0, conf * 3 - 1)) AS confidence FROM texts""")
def _(v):
    return std.clamp_confidence(v.texts.selectExpr("ok AS entry_id", "ln", "conf * 3 - 1 AS confidence"))


# --- profile ocr ---------------------------------------------------------------------------------------------

OCR_TYPE = ("CASE kind WHEN 1 THEN 'date' WHEN 2 THEN 'phone' WHEN 3 THEN 'amount' WHEN 4 THEN 'checkbox' "
            "WHEN 5 THEN 'name' WHEN 6 THEN 'address' ELSE CASE WHEN h % 50 = 0 THEN 'colour' ELSE 'id_number' END END")
OCR_VALUE = ("CASE kind WHEN 1 THEN date_text WHEN 2 THEN phone_text WHEN 3 THEN amount_text WHEN 4 THEN mark_text "
             "WHEN 5 THEN name_text WHEN 6 THEN street_text ELSE number_text END")
PLACE_COUNT = " + ".join(f"CASE WHEN contains(lower(x), '{p}') THEN 1 ELSE 0 END" for p in ocr.PLACES)


def _chain(start: str, pairs: dict[str, str], flags: str) -> str:
    for wrong, right in pairs.items():
        start = f"regexp_replace({start}, '{wrong}', '{right}', '{flags}')"
    return start


ABBR_COUNT = " + ".join(f"CASE WHEN regexp_matches(placed, '(?i){p}') THEN 1 ELSE 0 END" for p in ocr.ABBREVIATIONS)


def _ocr_date(separator: str) -> str:
    pattern = f"'^\\s*([0-9]+)\\s*{separator}\\s*([0-9]+)\\s*{separator}\\s*([0-9]+)\\s*$'"
    part = lambda g, n: f"lpad(try_cast(regexp_extract(fixed, {pattern}, {g}) AS INT)::VARCHAR, {n}, '0')"
    return (f"CASE WHEN try_cast(regexp_extract(fixed, {pattern}, 3) AS INT) BETWEEN 1950 AND 2030 "
            f"THEN strftime(try_cast({part(3, 4)} || '-' || {part(2, 2)} || '-' || {part(1, 2)} AS DATE), '%d/%m/%Y') END")


TITLE = "array_to_string(list_transform(string_split(fixed, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@query("standardize_ocr", ["texts"], f"""
WITH src AS (SELECT ok AS entry_id, ln, {OCR_TYPE} AS type, {OCR_VALUE} AS value_in, conf AS conf_in FROM texts),
a AS (SELECT *, trim(regexp_replace(value_in, '\\s+', ' ', 'g')) AS x FROM src WHERE type <> 'colour'),
b AS (SELECT *, NOT regexp_matches(lower(x), 'bgc|no') AND NOT (type = 'name' AND
    list_has_any(string_split(lower(x), ' '), [{words(ocr.COMMON_WORDS)}])) AND regexp_matches(x, '[OIlSZB]') AS hit FROM a),
c AS (SELECT *, CASE WHEN hit THEN translate(x, 'OIlSZB', '011528') ELSE x END AS fixed, {PLACE_COUNT} AS places FROM b),
d AS (SELECT *, CASE WHEN places > 0 THEN {_chain('x', ocr.PLACES, 'gi')} ELSE fixed END AS placed,
    regexp_replace(fixed, '[^0-9]', '', 'g') AS num, trim(translate(fixed, '$€£¥₱¢,', '')) AS bare,
    upper(regexp_replace(fixed, '[^A-Za-z0-9]', '', 'g')) AS idn, {TITLE} AS titled, lower(x) AS w,
    coalesce({', '.join(_ocr_date(s) for s in ('/', '-', '[.]'))}) AS dat FROM c),
e AS (SELECT *, CASE WHEN starts_with(num, '63') THEN CASE WHEN length(num) = 12 THEN '+' || num END
      WHEN regexp_matches(num, '^0[0-9]{{10}}$') THEN '+63' || substr(num, 2) WHEN length(num) = 10 THEN '+63' || num END AS pho,
    CASE WHEN regexp_matches(bare, '^-?[0-9]+([.][0-9]+)?$') THEN regexp_extract(bare, '^(-?[0-9]+)', 1) || '.' ||
      substr(rpad(regexp_extract(bare, '[.]([0-9]+)$', 1), 2, '0') || '', 1, 2) END AS amo FROM d),
f AS (SELECT *, CASE WHEN x = '' THEN '' WHEN type = 'name' THEN titled
    WHEN type = 'address' THEN {_chain('placed', ocr.ABBREVIATIONS, 'gi')}
    WHEN type = 'phone' THEN coalesce(pho, fixed) WHEN type = 'amount' THEN coalesce(amo, fixed)
    WHEN type = 'date' THEN coalesce(dat, fixed)
    WHEN type = 'id_number' THEN CASE WHEN length(idn) BETWEEN 8 AND 12 THEN idn ELSE fixed END
    WHEN w IN ({words(ocr.NO_WORDS)}) THEN 'No' ELSE 'Yes' END AS value_out,
  CASE WHEN hit THEN 0.05 ELSE 0 END AS sub FROM e),
g AS (SELECT *, CAST(CASE WHEN x = '' THEN 0 WHEN type = 'name' THEN sub + CASE WHEN titled <> fixed THEN 0.05 ELSE 0 END
    WHEN type = 'address' THEN places * 0.08 + CASE WHEN places = 0 THEN sub ELSE 0 END + ({ABBR_COUNT}) * 0.03
    WHEN type = 'phone' THEN CASE WHEN pho IS NULL THEN -0.2 ELSE sub + 0.1 END
    WHEN type = 'amount' THEN CASE WHEN amo IS NULL THEN -0.2 ELSE sub + 0.08 END
    WHEN type = 'date' THEN CASE WHEN dat IS NULL THEN -0.2 ELSE sub + 0.1 END
    WHEN type = 'id_number' THEN sub + CASE WHEN length(idn) BETWEEN 8 AND 12 THEN 0.05 ELSE -0.05 END
    WHEN w IN ({words(ocr.NO_WORDS + ocr.YES_WORDS)}) THEN 0.05 ELSE 0 END AS DOUBLE) AS delta FROM f)
SELECT entry_id, ln, type, value_out, delta AS conf_delta, round(greatest(0.0, least(1.0, conf_in + delta)), 9) AS conf_out FROM g""")
def _(v):
    return std.standardize_ocr(ocr_source(v))[0].select(
        "entry_id", "ln", "type", "value_out", "conf_delta", "conf_out")


def ocr_source(v):
    return v.texts.selectExpr(
        "ok AS entry_id", "ln", f"{OCR_TYPE} AS type", f"{OCR_VALUE} AS value_in", "conf AS conf_in")


@query("standardize_ocr_rejects", ["texts"], """
SELECT ok AS entry_id, ln, 'unknown type' AS reason FROM texts WHERE kind = 7 AND h % 50 = 0""")
def _(v):
    return std.standardize_ocr(ocr_source(v))[1].select("entry_id", "ln", "reason")


# --- profile post --------------------------------------------------------------------------------------------

POST_TYPE = "CASE " + " ".join(
    f"WHEN field_name IN ({words(names)}) THEN '{kind}'" for kind, names in post.FIELD_TYPES.items()) + " ELSE 'text' END"
# RE2 has no look-ahead; the following non-word character is captured and put back.
POST_ADDRESS = _chain("clean", {p.replace(r"(?!\w)", r"(\W|$)"): r + "\\1" for p, r in post.ABBREVIATIONS.items()}, "gi")
POST_NAME = ("array_to_string(list_transform(string_split(clean, ' '), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]{2,}$') "
             "THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE w END), ' ')")


@query("standardize_post", ["post_fields"], f"""
WITH a AS (SELECT *, {POST_TYPE} AS rule,
    regexp_replace(trim(regexp_replace(value, '\\s+', ' ', 'g')), '\\s+([.,;:])', '\\1', 'g') AS clean FROM post_fields),
b AS (SELECT *, translate(clean, 'OolISsBG', '00115586') AS fixed FROM a),
c AS (SELECT *, regexp_replace(fixed, '[^0-9]', '', 'g') AS num FROM b),
d AS (SELECT *, CASE WHEN trim(value) = '' THEN value WHEN rule = 'name' THEN {POST_NAME}
    WHEN rule = 'year' AND length(num) = 4 THEN num
    WHEN rule = 'year' AND length(num) = 2 THEN CASE WHEN CAST(num AS INT) < 50 THEN '20' ELSE '19' END || num
    WHEN rule = 'month' AND num <> '' THEN lpad(greatest(1, least(12, CAST(num AS INT)))::VARCHAR, 2, '0')
    WHEN rule = 'day' AND num <> '' THEN lpad(greatest(1, least(31, CAST(num AS INT)))::VARCHAR, 2, '0')
    WHEN rule = 'phone' THEN trim(regexp_replace(fixed, '[^0-9+\\-()\\s]', '', 'g'))
    WHEN rule = 'tin' AND length(num) IN (9, 12) THEN rtrim(regexp_replace(num, '(...)', '\\1-', 'g'), '-')
    WHEN rule = 'address' THEN {POST_ADDRESS}
    WHEN rule = 'currency' THEN regexp_replace(fixed, '[^0-9,.]', '', 'g')
    WHEN rule = 'integer' AND num <> '' THEN num ELSE clean END AS value_out FROM c)
SELECT entry_id, field_name, rule, value_out, value_out <> value AS changed,
  CASE WHEN value_out <> value THEN round(least(confidence + 0.02, 0.98), 9) ELSE confidence END AS conf_out FROM d""")
def _(v):
    fields = v.post_fields.withColumnsRenamed({"value": "value_in", "confidence": "conf_in"})
    return std.standardize_post(fields).select("entry_id", "field_name", "rule", "value_out", "changed", "conf_out")


# --- profile bnr ---------------------------------------------------------------------------------------------

BNR_MARKS_TRUE = " OR ".join(f"contains(v, '{m}')" for m in bnr.TRUE_MARKS)
BNR_MARKS_FALSE = " OR ".join(f"contains(v, '{m}')" for m in bnr.FALSE_MARKS)
BNR_PARTS = [*bnr.DOB_PARTS, *bnr.ADDRESS_PARTS, *bnr.NAME_PARTS]
BNR_CITY = ("coalesce(CASE WHEN w IN ({c}) THEN w END, list_filter([{c}], lambda c: contains(w, c) OR contains(c, w))[1], "
            "trim(biz_city_municipality))").format(c=words(bnr.CITIES))
PY_TITLE = ("array_to_string(list_transform(regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)'), "
            "lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '')")


def _bnr_name(part: str) -> str:
    cleaned = f"regexp_replace(trim({part}), '[^a-zA-Z\\s\\-'']', '', 'g')"
    return f"CASE WHEN {part} <> '' AND {cleaned} <> '' THEN {PY_TITLE.format(x=cleaned)} END"


@query("standardize_bnr", ["bnr_fields"], f"""
WITH a AS (SELECT *, trim(value) AS v, lower(trim(value)) AS w, regexp_replace(value, '[^0-9]', '', 'g') AS num,
    regexp_replace(value, '[^0-9.,]', '', 'g') AS kept FROM bnr_fields),
b AS (SELECT *, CASE WHEN starts_with(num, '63') THEN '0' || substr(num, 3) WHEN starts_with(num, '9') THEN '0' || num ELSE num END AS loc,
    CASE WHEN translate(kept, ',', '') = '' THEN 0.0 ELSE try_cast(translate(kept, ',', '') AS DOUBLE) END AS amo FROM a),
c AS (SELECT entry_id, field_name, CASE WHEN field_name = 'activity_service' THEN
      CASE WHEN source = 'checkbox_detection' AND v IN ('true', 'false') THEN {{'v': value, 'c': confidence}}
        WHEN w IN ({words(bnr.TRUE_WORDS)}) THEN {{'v': 'true', 'c': least(0.95, confidence * 1.1)}}
        WHEN w IN ({words(bnr.FALSE_WORDS)}) THEN {{'v': 'false', 'c': least(0.95, confidence * 1.1)}}
        WHEN v = '' OR w IN ({words(bnr.LABEL_WORDS)}) THEN {{'v': '', 'c': greatest(0.5, confidence * 0.7)}}
        WHEN {BNR_MARKS_TRUE} THEN {{'v': 'true', 'c': 0.8}} WHEN {BNR_MARKS_FALSE} THEN {{'v': 'false', 'c': 0.8}}
        ELSE {{'v': value, 'c': confidence}} END
    WHEN field_name = 'certificate_no' AND value <> '' THEN
      CASE WHEN regexp_matches(v, '(?i)^NR0?(:| |)[0-9]{{6}}') AND regexp_matches(v, '[0-9]{{6}}$')
        THEN {{'v': 'NR0:' || right(v, 6), 'c': CASE WHEN regexp_matches(v, '(?i)^NR0?(:| |)[0-9]{{6}}$') THEN 0.9 ELSE 0.8 END}}
        ELSE {{'v': v, 'c': 0.5}} END
    WHEN field_name = 'biz_phone' AND value <> '' THEN
      CASE WHEN length(num) BETWEEN 10 AND 12 AND regexp_matches(loc, '^09[0-9]{{9}}$')
        THEN {{'v': substr(loc, 1, 4) || '-' || substr(loc, 5), 'c': 0.85}} ELSE {{'v': value, 'c': 0.4}} END
    WHEN field_name = 'capitalization' AND value <> '' THEN
      CASE WHEN contains(value, '-') THEN {{'v': '', 'c': 0.0}} WHEN amo IS NULL THEN {{'v': '', 'c': 0.2}}
        ELSE {{'v': '₱' || format('{{:,.2f}}', amo), 'c': CASE WHEN contains(kept, ',') THEN 0.85 ELSE 0.75 END}} END
    ELSE {{'v': value, 'c': confidence}} END AS r FROM b),
wide AS (SELECT entry_id, {', '.join(f"coalesce(max(CASE WHEN field_name = '{p}' THEN value END), '') AS {p}" for p in BNR_PARTS)}
  FROM bnr_fields WHERE field_name IN ({words(BNR_PARTS)}) GROUP BY 1),
w2 AS (SELECT *, lower(trim(biz_city_municipality)) AS w, translate(trim(dob_year), 'IO', '10') AS y,
    translate(trim(dob_month), 'IS', '15') AS m, trim(dob_day) AS dy FROM wide),
w3 AS (SELECT *, try_cast(regexp_replace(y, '[^0-9]', '', 'g') AS BIGINT) AS yn, regexp_replace(m, '[^0-9]', '', 'g') AS md,
    regexp_replace(dy, '[^0-9]', '', 'g') AS dd FROM w2),
w4 AS (SELECT *, list_filter([CASE WHEN yn < 50 THEN (2000 + yn)::VARCHAR WHEN yn < 100 THEN (1900 + yn)::VARCHAR ELSE y END,
    CASE WHEN md = '' THEN m WHEN CAST(md AS BIGINT) BETWEEN 1 AND 12 THEN lpad(CAST(md AS BIGINT)::VARCHAR, 2, '0') ELSE '' END,
    CASE WHEN dd = '' THEN dy WHEN CAST(dd AS BIGINT) BETWEEN 1 AND 31 THEN lpad(CAST(dd AS BIGINT)::VARCHAR, 2, '0') ELSE '' END],
    lambda p: p <> '') AS parts FROM w3),
extra AS (SELECT entry_id, 'dob_composite' AS field_name, array_to_string(parts, '-') AS v,
    CASE WHEN len(parts) = 3 THEN 0.82 ELSE 0.6 END AS c FROM w4
  UNION ALL SELECT entry_id, 'biz_address_composite', array_to_string(list_filter([
    {', '.join("CASE WHEN " + p + " <> '' THEN " + (BNR_CITY if p == 'biz_city_municipality' else 'trim(' + p + ')') + " END" for p in bnr.ADDRESS_PARTS)}],
    lambda p: p IS NOT NULL), ', '), 0.75 FROM w4
  UNION ALL SELECT entry_id, 'owner_name_composite', CASE WHEN first_name || middle_name || last_name <> '' THEN
    array_to_string(list_filter([{', '.join(_bnr_name(p) for p in bnr.NAME_PARTS[:3])},
    CASE WHEN suffix <> '' THEN trim(suffix) END], lambda p: p IS NOT NULL), ' ') ELSE '' END, 0.8 FROM w4)
SELECT entry_id, field_name, r.v AS value_out, round(CAST(r.c AS DOUBLE), 9) AS conf_out FROM c
UNION ALL SELECT entry_id, field_name, v, CAST(c AS DOUBLE) FROM extra WHERE v <> ''""")
def _(v):
    fields = v.bnr_fields.withColumnsRenamed({"value": "value_in", "confidence": "conf_in"})
    return std.standardize_bnr(fields).select("entry_id", "field_name", "value_out", "conf_out")


# --- profile model -------------------------------------------------------------------------------------------

MODEL_NAME = ("CASE kind WHEN 1 THEN 'date_of_birth' WHEN 2 THEN 'owner_phone' WHEN 3 THEN 'capitalization' "
              "WHEN 4 THEN 'is_renewal' WHEN 5 THEN 'first_name' WHEN 6 THEN 'business_street' ELSE 'psic_code' END")


@query("adapt_model_fields", ["texts"], f"""
WITH a AS (SELECT ok AS entry_id, {MODEL_NAME} AS field_name, {OCR_VALUE} AS raw,
    CASE WHEN h % 13 <> 0 THEN conf END AS conf FROM texts)
SELECT entry_id, field_name, CASE WHEN raw = '' THEN '' WHEN field_name = 'is_renewal' THEN
    CASE WHEN lower(trim(raw)) IN ('true', 'checked', '✓', 'x', 'yes', '1') THEN 'true' ELSE 'false' END
  WHEN field_name = 'capitalization' THEN regexp_replace(trim(raw), '[^0-9.,]', '', 'g') ELSE trim(raw) END AS value_out,
  coalesce(conf, 0.85) AS conf_out, 'model' AS source FROM a""")
def _(v):
    fields = v.texts.selectExpr("ok AS entry_id", f"{MODEL_NAME} AS field_name", f"{OCR_VALUE} AS value_in",
                                "CASE WHEN h % 13 <> 0 THEN conf END AS conf_in")
    return std.adapt_model_fields(fields).select("entry_id", "field_name", "value_out", "conf_out", "source")


TYPED = ("CASE kind WHEN 1 THEN 'radio' WHEN 2 THEN 'number' WHEN 3 THEN 'number' WHEN 4 THEN 'checkbox' WHEN 5 THEN 'radio' "
         "WHEN 6 THEN 'checkbox-group' ELSE 'text' END")
CHOICE = ("CASE h % 6 WHEN 0 THEN ' Single ' WHEN 1 THEN 'legally/separated' WHEN 2 THEN 'is married now' "
          "WHEN 3 THEN 'Legally-Separated' WHEN 4 THEN 'widow' ELSE 'the legally_separated one' END")
VALUE = ("CASE kind WHEN 1 THEN {choice} WHEN 2 THEN phone_text WHEN 3 THEN amount_text WHEN 4 THEN mark_text "
         "WHEN 5 THEN {choice} WHEN 6 THEN street_text ELSE number_text END").format(choice=CHOICE)


@query("normalise_by_type", ["texts"], f"""
WITH a AS (SELECT ok AS entry_id, ln, {TYPED} AS type, trim({VALUE}) AS v,
    CASE WHEN kind = 1 THEN ['single', 'married', 'legally_separated'] ELSE [] END AS options FROM texts),
b AS (SELECT *, lower(v) AS low, regexp_split_to_array(translate(lower(v), '_/', '  '), '\\s+') AS raw_words FROM a),
c AS (SELECT entry_id, ln, CASE type WHEN 'checkbox' THEN CASE WHEN low IN ('yes', 'true', 'checked', '1', 'x', '✓', '✔', 'on',
      'selected', 'filled') THEN 'true' ELSE '' END
    WHEN 'radio' THEN CASE WHEN len(options) = 0 THEN v ELSE coalesce(list_filter(options, lambda o: lower(o) = low)[1],
      list_filter(options, lambda o: lower(o) = translate(low, '/- ', '___'))[1],
      list_filter(options, lambda o: list_has_all(raw_words, string_split(replace(lower(o), '_', ' '), ' ')))[1], '') END
    WHEN 'number' THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE v END AS value_out FROM b)
SELECT *, CAST(CASE WHEN value_out <> '' THEN 0.92 ELSE 0 END AS DOUBLE) AS conf_out FROM c""")
def _(v):
    fields = v.texts.selectExpr(
        "ok AS entry_id", "ln", f"{TYPED} AS type", f"{VALUE} AS value_in",
        "CASE WHEN kind = 1 THEN array('single', 'married', 'legally_separated') ELSE CAST(array() AS array<string>) END AS options")
    return std.normalise_by_type(fields).select("entry_id", "ln", "value_out", "conf_out")


# --- confidence ----------------------------------------------------------------------------------------------

RAW_CONF = ("CASE WHEN kind = 1 THEN '1.5' WHEN kind = 2 THEN '-0.2' WHEN kind = 3 THEN CAST(conf AS {s}) WHEN kind = 4 THEN 'true' "
            "WHEN kind = 5 THEN '\"high\"' END")
# Values are words of the documents, so that many fields do occur in their entry's lines.
RAW_WORD = ("CASE h % 6 WHEN 0 THEN 'the' WHEN 1 THEN 'de' WHEN 2 THEN ' la ' WHEN 3 THEN 'Und' WHEN 4 THEN 'x' ELSE 'no such words' END")


@query("repair_confidence", ["texts", "ocr_lines"], f"""
WITH f AS (SELECT ok AS entry_id, ln, {RAW_CONF.format(s='VARCHAR')} AS raw, lower(trim({RAW_WORD})) AS w FROM texts),
n AS (SELECT *, CASE WHEN raw = 'true' THEN 1.0 ELSE try_cast(raw AS DOUBLE) END AS num FROM f),
e AS (SELECT n.entry_id, n.ln, avg(CAST(confidence AS DECIMAL(18,8))) AS est FROM n JOIN ocr_lines l ON n.entry_id = l.entry_id
  WHERE num IS NULL AND length(w) > 1 AND CASE WHEN length(w) > 2 THEN
    regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || w || '($|[^\\p{{L}}\\p{{N}}_])') ELSE lower(text) = w END GROUP BY 1, 2)
SELECT n.entry_id, n.ln, round(coalesce(CASE WHEN num IS NOT NULL THEN greatest(0.0, least(1.0, num)) END, est, 0.5), 9) AS confidence FROM n
LEFT JOIN e ON n.entry_id = e.entry_id AND n.ln = e.ln""")
def _(v):
    fields = v.texts.selectExpr(
        "ok AS entry_id", "ln", "concat('f', ln) AS field_name", f"{RAW_CONF.format(s='STRING')} AS confidence_raw",
        f"{RAW_WORD} AS value")
    return std.repair_confidence(fields, v.ocr_lines).select(
        "entry_id", "ln", F.round("confidence", 9).alias("confidence"))
