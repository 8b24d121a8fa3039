"""OCR lines, anchors, regions, check boxes and patterns against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docfields.catalog.q_standardize import AMOUNT_CTE, PHONE, _date_cte, words
from docfields.catalog.registry import avg4, query
from docfields.catalog.views import SCHEMA_FIELDS
from docfields.operators import lines as line_ops
from docfields.operators.layout import anchors, checkboxes, patterns, positional, regions
from docfields.operators.standardize import schema
from docfields.sources import boxes

# A word character as Unicode sees it; RE2's \b knows ASCII only.
EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


@query("summarize_lines", ["entries", "ocr_lines"], f"""
SELECT e.entry_id, count(l.line_no) AS line_count, coalesce(md5(string_agg(l.text, chr(10) ORDER BY l.line_no)), md5('')) AS text_md5,
  coalesce({avg4('l.confidence')}, 0.0) AS avg_confidence FROM entries e LEFT JOIN ocr_lines l ON e.entry_id = l.entry_id GROUP BY 1""")
def _(v):
    return line_ops.summarize_lines(v.entries, v.ocr_lines).select(
        "entry_id", "line_count", F.md5("full_text").alias("text_md5"), "avg_confidence")


@query("line_mark_statistics", ["ocr_lines"], """
SELECT entry_id, count(*) AS total_lines,
  count(CASE WHEN regexp_matches(text, '[✓✔☑☐○●■█\\[\\]()xX]') THEN 1 END) AS lines_with_marks,
  count(CASE WHEN regexp_matches(lower(text), 'manufacturer|producer|service|retailer|wholesaler|importer|exporter') THEN 1 END)
    AS lines_with_activity_words,
  count(CASE WHEN contains(text, '[') OR contains(text, ']') THEN 1 END) AS lines_with_brackets
FROM ocr_lines GROUP BY 1""")
def _(v):
    return line_ops.line_mark_statistics(v.ocr_lines)


def _score(form: str) -> str:
    terms = [f"CASE WHEN bool_or(contains(lower(text), '{w}')) THEN {x} ELSE 0 END"
             for w, x in line_ops.FORM_KEYWORDS[form].items()]
    return f"CAST({' + '.join(terms)} AS DOUBLE) AS {form}"


@query("form_type_score", ["ocr_lines"], f"""
WITH s AS (SELECT entry_id, {', '.join(_score(f) for f in line_ops.FORM_KEYWORDS)} FROM ocr_lines GROUP BY 1),
b AS (SELECT *, greatest(dti_bnr, barangay_clearance, community_tax) AS best_score FROM s)
SELECT *, CASE WHEN best_score < 0.8 THEN 'unknown' WHEN dti_bnr = best_score THEN 'dti_bnr'
    WHEN barangay_clearance = best_score THEN 'barangay_clearance' ELSE 'community_tax' END AS form_type,
  CASE WHEN best_score >= 1.5 THEN 'high' WHEN best_score >= 0.8 THEN 'medium' ELSE 'low' END AS certainty FROM b""")
def _(v):
    return line_ops.form_type_score(v.ocr_lines)


def _inventory_sql() -> str:
    parts = [f"SELECT entry_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM ocr_lines"
             for kind, pattern in line_ops.INVENTORY.items()]
    return "SELECT DISTINCT entry_id, kind, value FROM (" + " UNION ALL ".join(parts) + ") m"


@query("pattern_matches", ["ocr_lines"], _inventory_sql())
def _(v):
    return line_ops.pattern_matches(v.ocr_lines)


@query("pattern_inventory", ["ocr_lines"], "SELECT entry_id, count(*) AS n, count(CASE WHEN kind = 'email' THEN 1 END) AS n_email FROM ("
       + _inventory_sql() + ") d GROUP BY 1")
def _(v):
    found = line_ops.pattern_inventory(v.ocr_lines)
    total = sum((F.size(k) for k in line_ops.INVENTORY), F.lit(0))
    return found.select("entry_id", total.cast("bigint").alias("n"), F.size("email").cast("bigint").alias("n_email"))


@query("reading_order", ["ocr_lines"], """
SELECT entry_id, line_no, row_number() OVER (PARTITION BY entry_id ORDER BY box_top, box_left, line_no) AS reading_no FROM ocr_lines""")
def _(v):
    return line_ops.reading_order(v.ocr_lines).select("entry_id", "line_no", "reading_no")


@query("next_lines", ["ocr_lines"], """
SELECT entry_id, line_no, md5(lead(text) OVER w) AS next_md5, lead(confidence) OVER w AS next_confidence
FROM ocr_lines WINDOW w AS (PARTITION BY entry_id ORDER BY line_no)""")
def _(v):
    return line_ops.next_lines(v.ocr_lines).select(
        "entry_id", "line_no", F.md5("next_text").alias("next_md5"), "next_confidence")


@query("page_extent", ["ocr_lines"],
       "SELECT entry_id, max(box_right) AS page_width, max(box_bottom) AS page_height FROM ocr_lines GROUP BY 1")
def _(v):
    return line_ops.page_extent(v.ocr_lines)


# --- boxes ---------------------------------------------------------------------------------------------------

@query("normalize_bbox", ["ocr_lines"], """
SELECT entry_id, line_no, box_top, box_left, box_bottom, box_right FROM ocr_lines WHERE line_no % 4 <> 3""")
def _(v):
    corners = ("'[[', box.left, ',', box.bottom, '],[', box.right, ',', box.bottom, '],[', box.right, ',', box.top, '],[', "
               "box.left, ',', box.top, ']]'")
    raw = v.ocr_lines.selectExpr(
        "entry_id", "line_no",
        f"CASE line_no % 4 WHEN 0 THEN concat({corners}) WHEN 3 THEN IF(line_no % 8 = 3, '[[10]]', 'oops') "
        "ELSE concat('[', box.left, ',', box.top, ',', box.right, ',', box.bottom, ']') END AS bbox")
    good = boxes.normalize_bbox(raw)[0]
    return good.select("entry_id", "line_no", *[F.col(f"box.{s}").alias(f"box_{s}") for s in ("top", "left", "bottom", "right")])


@query("box_predicates", ["mark_lines", "visual_boxes"], """
SELECT l.entry_id, line_no, box_no,
  CASE WHEN least(box_right, x + width) > greatest(box_left, x) AND least(box_bottom, y + height) > greatest(box_top, y) THEN
    (least(box_right, x + width) - greatest(box_left, x)) * (least(box_bottom, y + height) - greatest(box_top, y))
      / ((box_right - box_left) * (box_bottom - box_top)) >= 0.5 ELSE false END AS overlaps,
  NOT (box_right < x OR box_left > x + width) AS overlaps_x,
  abs((box_top + box_bottom) / 2 - (y + y + height) / 2) <= 20 AS overlaps_y,
  x BETWEEN box_left AND box_right AND y BETWEEN box_top AND box_bottom AS contains_corner
FROM mark_lines l JOIN visual_boxes b ON l.entry_id = b.entry_id AND l.line_no + 1 = b.box_no""")
def _(v):
    visual = v.visual_boxes.select("entry_id", "box_no", "x", "y", boxes.box_struct(
        F.col("y"), F.col("x"), F.col("y") + F.col("height"), F.col("x") + F.col("width")).alias("other"))
    pairs = v.mark_lines.withColumn("box_no", F.col("line_no") + 1).join(visual, ["entry_id", "box_no"])
    box, other = F.col("box"), F.col("other")
    return pairs.select(
        "entry_id", "line_no", "box_no", boxes.overlaps(box, other).alias("overlaps"),
        boxes.overlaps_x(box, other).alias("overlaps_x"), boxes.overlaps_y(box, other).alias("overlaps_y"),
        boxes.contains_point(box, F.col("x"), F.col("y")).alias("contains_corner"))


# --- anchors -------------------------------------------------------------------------------------------------

def _anchor_rows() -> str:
    """(field, label, type, candidate, needle, region bounds) of every template, as SQL values."""
    import json

    rows = []
    for name, label, kind, rest in SCHEMA_FIELDS:
        extra = json.loads("{" + rest + "}") if rest else {}
        directives = extra.get("extraction", {})
        shown = label if label is not None else name.replace("_", " ").title()
        region = directives.get("search_region", {})
        bounds = [region.get(k, d) for k, d in (("x_min", 0.0), ("y_min", 0.0), ("x_max", 1.0), ("y_max", 1.0))]
        option = (extra.get("options") or [""])[0]
        for i, needle in enumerate(directives.get("anchor_labels") or [shown]):
            rows.append(f"('{name}', '{shown}', '{kind}', '{option}', {i}, '{needle.lower().strip()}', "
                        + ", ".join(f"{b}::DOUBLE" for b in bounds) + ")")
    return ("a(field_name, label, type, opt, cand, needle, x0, y0, x1, y1) AS (SELECT * FROM (VALUES "
            + ", ".join(rows) + ") t)")


PLACED = """
ext AS (SELECT entry_id, max(box_right) AS pw, max(box_bottom) AS ph FROM ocr_lines GROUP BY 1),
placed AS (SELECT l.*, e.template_id, (box_left + box_right) / 2 AS cx, (box_top + box_bottom) / 2 AS cy, pw, ph
  FROM ocr_lines l JOIN entries e ON l.entry_id = e.entry_id JOIN ext ON l.entry_id = ext.entry_id
  WHERE e.template_id < 23)"""
IN_REGION = "cx / pw BETWEEN x0 AND x1 AND cy / ph BETWEEN y0 AND y1"
AFTER = ("CASE WHEN contains({t}, ':') AND trim(substr({t}, strpos({t}, ':') + 1), E' \\t\\n\\r') <> '' "
         "THEN trim(substr({t}, strpos({t}, ':') + 1), E' \\t\\n\\r') END")
TOKENS = " OR ".join(f"contains(lower(atext), '{t}')" for t in anchors.CHECK_TOKENS)


@query("extract_template_map", ["entries", "ocr_lines"], f"""
WITH {_anchor_rows()}, {PLACED},
hits AS (SELECT entry_id, field_name, label, type, opt, x0, y0, x1, y1, line_no AS aline, text AS atext, confidence AS aconf,
    cx AS ax, cy AS ay, row_number() OVER (PARTITION BY entry_id, field_name ORDER BY cand, line_no) AS n
  FROM placed JOIN a ON contains(lower(text), needle) WHERE {IN_REGION}),
first AS (SELECT *, {AFTER.format(t='atext')} AS after FROM hits WHERE n = 1),
near AS (SELECT f.entry_id, f.field_name, p.text AS ntext, p.confidence AS nconf,
    row_number() OVER (PARTITION BY f.entry_id, f.field_name ORDER BY abs(cx - ax) + abs(cy - ay), p.line_no) AS n
  FROM first f JOIN placed p ON f.entry_id = p.entry_id AND f.type NOT IN ('checkbox', 'radio') AND f.after IS NULL
    AND p.line_no <> f.aline AND trim(p.text) <> '' AND lower(trim(p.text)) <> lower(f.label) AND cx >= ax AND {IN_REGION}),
want AS (SELECT DISTINCT e.entry_id, a.field_name FROM entries e, a WHERE e.template_id < 23),
r AS (SELECT w.entry_id, w.field_name, CASE WHEN f.type IN ('checkbox', 'radio') THEN
      CASE WHEN {TOKENS} THEN CASE WHEN f.type = 'checkbox' THEN 'true' ELSE opt END END
    ELSE coalesce(after, trim(ntext, E' \\t\\n\\r')) END AS val, CASE WHEN f.type IN ('checkbox', 'radio') OR after IS NOT NULL THEN aconf ELSE nconf END AS conf,
    CASE WHEN atext IS NULL THEN 0 WHEN ntext IS NULL THEN 1 ELSE 2 END AS n_context
  FROM want w LEFT JOIN first f ON w.entry_id = f.entry_id AND w.field_name = f.field_name
  LEFT JOIN near n ON w.entry_id = n.entry_id AND w.field_name = n.field_name AND n.n = 1)
SELECT entry_id, field_name, coalesce(val, '') AS value, CASE WHEN val IS NULL THEN 0.0 ELSE conf END AS confidence,
  val IS NULL AS unresolved, n_context FROM r""")
def _(v):
    return anchors.extract_template_map(v.entries, v.stored("ocr_lines"), v.template_fields).select(
        "entry_id", "field_name", "value", "confidence", "unresolved", F.size("context_lines").alias("n_context"))


@query("page_membership", ["entries", "ocr_lines"], f"""
WITH {_anchor_rows()}, {PLACED}
SELECT entry_id, line_no, count(*) AS n_fields, string_agg(field_name, ',' ORDER BY field_name) AS names
FROM placed JOIN (SELECT DISTINCT field_name, x0, y0, x1, y1 FROM a) f ON {IN_REGION} GROUP BY 1, 2""")
def _(v):
    return anchors.page_membership(v.ocr_lines, v.entries, v.template_fields).select(
        "entry_id", "line_no", F.size("field_names").cast("bigint").alias("n_fields"), F.array_join("field_names", ",").alias("names"))


@query("extract_by_label_position", ["entries", "ocr_lines", "template_fields"], """
WITH hits AS (SELECT l.entry_id, t.name AS field_name, min(line_no) AS line_no FROM ocr_lines l
    JOIN entries e ON l.entry_id = e.entry_id JOIN template_fields t ON t.template_id = e.template_id AND contains(lower(l.text), lower(t.label))
  GROUP BY 1, 2),
lab AS (SELECT h.entry_id, h.field_name, box_top AS t0, box_left AS l0, box_bottom AS b0, box_right AS r0 FROM hits h JOIN ocr_lines l
  ON h.entry_id = l.entry_id AND h.line_no = l.line_no),
vals AS (SELECT a.entry_id, a.field_name, string_agg(l.text, ' ' ORDER BY l.line_no) AS txt, avg(CAST(confidence AS DECIMAL(18,8))) AS conf
  FROM lab a JOIN ocr_lines l ON a.entry_id = l.entry_id
  WHERE NOT (box_top = t0 AND box_left = l0 AND box_bottom = b0 AND box_right = r0)
    AND ((box_left > r0 AND abs(box_top - t0) < 30) OR (box_top > t0 AND abs(box_left - l0) < 50)) AND box_left - r0 < 150 GROUP BY 1, 2)
SELECT e.entry_id, t.name AS field_name, md5(coalesce(trim(txt), '')) AS value_md5, round(coalesce(conf, 0.0), 9) AS confidence
FROM entries e JOIN template_fields t ON e.template_id = t.template_id
LEFT JOIN vals v ON v.entry_id = e.entry_id AND v.field_name = t.name""")
def _(v):
    return positional.extract_by_label_position(v.entries, v.stored("ocr_lines"), v.template_fields).select(
        "entry_id", "field_name", F.md5("value").alias("value_md5"), F.round("confidence", 9).alias("confidence"))


def _groups_sql(edge: str, threshold: int, name: str) -> str:
    return f"""
WITH c AS (SELECT DISTINCT entry_id, box_{edge} AS v FROM ocr_lines),
g AS (SELECT entry_id, min(v) AS s FROM c GROUP BY 1
  UNION ALL SELECT g.entry_id, min(c.v) FROM g JOIN c ON g.entry_id = c.entry_id AND c.v > g.s + {threshold} GROUP BY g.entry_id, g.s),
n AS (SELECT entry_id, s, row_number() OVER (PARTITION BY entry_id ORDER BY s) AS {name},
  coalesce(lead(s) OVER (PARTITION BY entry_id ORDER BY s), 1e18) AS nxt FROM g)
SELECT l.entry_id, line_no, {name} FROM ocr_lines l JOIN n ON l.entry_id = n.entry_id AND box_{edge} >= s AND box_{edge} < nxt"""


@query("group_rows", ["ocr_lines"], _groups_sql("top", 15, "row_no"), recursive=True)
def _(v):
    return positional.group_rows(v.stored("ocr_lines")).select("entry_id", "line_no", "row_no")


@query("group_columns", ["ocr_lines"], _groups_sql("left", 50, "column_no"), recursive=True)
def _(v):
    return positional.group_columns(v.stored("ocr_lines")).select("entry_id", "line_no", "column_no")


@query("extract_naive", ["entries", "ocr_lines", "template_fields"], f"""
WITH lab AS (SELECT template_id, name AS field_name, list_distinct(string_split(lower(label), ' ')) AS lw FROM template_fields),
l AS (SELECT *, {AFTER.format(t='text')} AS after, lead(text) OVER w AS ntext, lead(confidence) OVER w AS nconf,
    regexp_split_to_array(trim(lower(text)), '\\s+') AS words FROM ocr_lines WINDOW w AS (PARTITION BY entry_id ORDER BY line_no)),
hits AS (SELECT l.entry_id, field_name, after, ntext, confidence, nconf, row_number() OVER (PARTITION BY l.entry_id, field_name ORDER BY line_no) AS n
  FROM l JOIN entries e ON l.entry_id = e.entry_id JOIN lab ON lab.template_id = e.template_id
  WHERE len(list_intersect(lw, words)) >= greatest(1, len(lw) * 0.6) AND (after IS NOT NULL OR ntext IS NOT NULL))
SELECT e.entry_id, lab.field_name, md5(coalesce(after, ntext, '')) AS value_md5,
  coalesce(CASE WHEN after IS NOT NULL THEN confidence ELSE nconf END, 0.0) AS confidence
FROM entries e JOIN lab ON e.template_id = lab.template_id
LEFT JOIN hits h ON h.entry_id = e.entry_id AND h.field_name = lab.field_name AND h.n = 1""")
def _(v):
    return anchors.extract_naive(v.entries, v.stored("ocr_lines"), v.template_fields).select(
        "entry_id", "field_name", F.md5("ocr_value").alias("value_md5"), "confidence")


@query("find_anchor", ["ocr_lines"], """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY line_no) AS n FROM ocr_lines
  WHERE contains(lower(text), 'und') AND confidence >= 0.7)
SELECT h.entry_id, h.line_no AS line_index, h.text AS anchor_text, h.confidence AS anchor_confidence,
  coalesce(md5(string_agg(l.text, '|' ORDER BY l.line_no)), md5('')) AS context_md5
FROM h LEFT JOIN ocr_lines l ON l.entry_id = h.entry_id AND l.line_no BETWEEN h.line_no + 1 AND h.line_no + 3 WHERE n = 1 GROUP BY 1, 2, 3, 4""")
def _(v):
    return anchors.find_anchor(v.ocr_lines, "UND ", 0.7, 3).select(
        "entry_id", "line_index", "anchor_text", "anchor_confidence", F.md5(F.array_join("context_lines", "|")).alias("context_md5"))


@query("section_lines", ["ocr_lines"], f"""
WITH s(section, t, l, b, r) AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {t}::DOUBLE, {l}::DOUBLE, {b}::DOUBLE, {r}::DOUBLE)" for n, (t, l, b, r) in anchors.SECTIONS.items())}) v),
ext AS (SELECT entry_id, max(box_right) AS pw, max(box_bottom) AS ph FROM ocr_lines GROUP BY 1)
SELECT o.entry_id, section, line_no FROM ocr_lines o JOIN ext ON o.entry_id = ext.entry_id JOIN s
  ON (box_top + box_bottom) / 2 / ph BETWEEN t AND b AND (box_left + box_right) / 2 / pw BETWEEN l AND r""")
def _(v):
    return anchors.section_lines(v.ocr_lines).select("entry_id", "section", "line_no")


# --- regions and check boxes ---------------------------------------------------------------------------------

# The sequential rule as a walk over (seed i, candidate j) per entry, one recursion step per decision.
SHORT = "length(trim(text)) < 20 AND len(regexp_split_to_array(trim(text), '\\s+')) <= 3"
GROUPS = f"""
base AS (SELECT entry_id, list(box_top ORDER BY line_no) AS t, list(box_left ORDER BY line_no) AS l, list(box_bottom ORDER BY line_no) AS b,
    list(box_right ORDER BY line_no) AS r, list({SHORT} ORDER BY line_no) AS s, count(*) AS n FROM mark_lines GROUP BY 1),
walk AS (
  SELECT base.*, 1::BIGINT AS i, 1::BIGINT AS j, false AS open, 0.0::DOUBLE AS rb, 0.0::DOUBLE AS rl, 0.0::DOUBLE AS rr,
    []::BIGINT[] AS used, []::BIGINT[] AS seeds, []::BIGINT[] AS members FROM base
  UNION ALL
  SELECT entry_id, t, l, b, r, s, n, CASE WHEN k IN ('skip', 'end') THEN i + 1 ELSE i END, CASE k WHEN 'seed' THEN i + 1 WHEN 'take' THEN j + 1 WHEN 'next' THEN j + 1 ELSE j END,
    CASE k WHEN 'seed' THEN true WHEN 'end' THEN false ELSE open END, CASE k WHEN 'seed' THEN b[i] WHEN 'take' THEN b[j] ELSE rb END,
    CASE k WHEN 'seed' THEN l[i] WHEN 'take' THEN l[j] ELSE rl END, CASE k WHEN 'seed' THEN r[i] WHEN 'take' THEN r[j] ELSE rr END,
    CASE k WHEN 'seed' THEN list_append(used, i) WHEN 'take' THEN list_append(used, j) ELSE used END,
    CASE k WHEN 'take' THEN list_append(seeds, i) ELSE seeds END, CASE k WHEN 'take' THEN list_append(members, j) ELSE members END
  FROM (SELECT *, CASE WHEN NOT open THEN CASE WHEN list_contains(used, i) OR NOT s[i] THEN 'skip' ELSE 'seed' END WHEN j > n THEN 'end'
      WHEN list_contains(used, j) THEN 'next' WHEN t[j] - rb > 30 THEN 'end'
      WHEN t[j] - rb > -5 AND NOT (r[j] < rl OR l[j] > rr) AND s[j] THEN 'take' ELSE 'next' END AS k FROM walk WHERE i <= n) w),
pairs AS (SELECT entry_id, unnest(seeds) - 1 AS group_no, unnest(members) - 1 AS line_no FROM walk WHERE i > n),
groups_ AS (SELECT entry_id, line_no, group_no FROM pairs UNION SELECT entry_id, group_no, group_no FROM pairs)"""


@query("detect_checkbox_groups", ["mark_lines"], f"WITH {GROUPS} SELECT entry_id, line_no, group_no FROM groups_", recursive=True)
def _(v):
    return regions.detect_checkbox_groups(v.stored("mark_lines"))


TITLE = ("length(trim(text)) BETWEEN 2 AND 99 AND regexp_matches(trim(text), '^\\p{L}\\.') AND upper(trim(text)) = trim(text) "
         "AND lower(trim(text)) <> trim(text)")


@query("classify_regions", ["mark_lines"], f"""
WITH {GROUPS},
titles AS (SELECT *, 'section_title' AS region_type, line_no AS region_key FROM mark_lines WHERE {TITLE}),
boxes_ AS (SELECT m.*, 'checkbox_group' AS region_type, group_no AS region_key FROM mark_lines m JOIN groups_ g ON m.entry_id = g.entry_id AND m.line_no = g.line_no),
rest AS (SELECT m.* FROM mark_lines m WHERE NOT ({TITLE}) AND NOT EXISTS (SELECT 1 FROM groups_ g WHERE g.entry_id = m.entry_id AND g.line_no = m.line_no)),
gaps AS (SELECT *, CASE WHEN box_top - max(box_bottom) OVER (PARTITION BY entry_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 50 THEN 1 ELSE 0 END AS o FROM rest),
blocks AS (SELECT * EXCLUDE (o), 'text_field' AS region_type, CAST(sum(o) OVER (PARTITION BY entry_id ORDER BY line_no) AS BIGINT) AS region_key FROM gaps),
members_ AS (SELECT * FROM titles UNION ALL BY NAME SELECT * FROM boxes_ UNION ALL BY NAME SELECT * FROM blocks),
found AS (SELECT entry_id, region_type, min(box_top) AS top, min(line_no) AS first_line, count(*) AS line_count,
    coalesce(nullif(string_agg(trim(text), ' ' ORDER BY line_no), ''), CASE region_type WHEN 'checkbox_group' THEN 'Checkbox Group' ELSE 'Text Field' END) AS name
  FROM members_ GROUP BY entry_id, region_type, region_key)
SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY top, CASE region_type WHEN 'section_title' THEN 0 WHEN 'checkbox_group' THEN 1 ELSE 2 END, first_line) AS region_no,
  region_type, name, CAST(CASE region_type WHEN 'section_title' THEN 0.85 WHEN 'checkbox_group' THEN 0.7 ELSE 0.75 END AS DOUBLE) AS confidence, first_line, line_count FROM found""",
       recursive=True)
def _(v):
    return regions.classify_regions(v.stored("mark_lines")).select(
        "entry_id", "region_no", "region_type", "name", "confidence", "first_line", "line_count")


STATE = r"""CASE WHEN {c} = '' THEN 'unclear' WHEN regexp_matches({c}, '~|\.{{2,}}|\?') THEN 'unclear'
    WHEN regexp_matches({c}, '(?i)✓|✔|\bx\b|☑|\|\||█|■|●|\[\s*[x✓✔]\s*\]') THEN 'checked' ELSE 'unchecked' END AS state,
  CASE WHEN {c} = '' THEN 0.3 WHEN regexp_matches({c}, '~|\.{{2,}}|\?') THEN 0.5
    WHEN regexp_matches({c}, '(?i)✓|✔|\bx\b|☑|\|\||█|■|●|\[\s*[x✓✔]\s*\]') THEN CASE WHEN length({c}) > 10 THEN 0.88 ELSE 0.92 END
    WHEN regexp_matches({c}, '☐|○|\[\s*\]|\(\s*\)') THEN 0.85
    WHEN length({c}) > 2 AND NOT regexp_matches({c}, '[\p{{L}}\p{{N}}]') THEN 0.65 ELSE 0.7 END::DOUBLE AS sconf"""
LABEL_NAMES = " ".join(f"WHEN '{label}' THEN '{name}'" for label, name in checkboxes.LABEL_FIELDS.items())


@query("detect_checkboxes", ["mark_lines"], f"""
WITH {GROUPS},
m AS (SELECT l.*, trim(text) AS a, group_no, min(box_top) OVER (PARTITION BY l.entry_id, group_no) AS gtop FROM mark_lines l JOIN groups_ g ON l.entry_id = g.entry_id AND l.line_no = g.line_no),
s AS (SELECT *, {STATE.format(c='a')} FROM m WHERE a <> '')
SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY gtop, group_no, line_no) AS det_no, line_no,
  CASE a {LABEL_NAMES} ELSE replace(lower(a), ' ', '_') END AS name, state, sconf * confidence AS confidence, a AS anchor_text FROM s""", recursive=True)
def _(v):
    return checkboxes.detect_checkboxes(v.stored("mark_lines")).drop("box")


@query("text_blocks", ["ocr_lines"], """
WITH m AS (SELECT entry_id, line_no, CASE WHEN box_top - max(box_bottom) OVER (PARTITION BY entry_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 9 THEN 1 ELSE 0 END AS o FROM ocr_lines)
SELECT entry_id, line_no, CAST(sum(o) OVER (PARTITION BY entry_id ORDER BY line_no) AS BIGINT) AS block_no FROM m""")
def _(v):
    from docfields.functions.scans import running_max_before, running_sum

    below = running_max_before(v.ocr_lines, ["entry_id"], "line_no", F.col("box.bottom"), "_b")
    opens = F.when(F.col("box.top") - F.col("_b") > 9, 1).otherwise(0)
    return running_sum(below, ["entry_id"], "line_no", opens, "block_no").select("entry_id", "line_no", "block_no")


@query("checkbox_state", ["mark_lines"], f"""
SELECT entry_id, line_no, state, sconf AS confidence FROM (SELECT entry_id, line_no, {STATE.format(c='text')} FROM mark_lines) s""")
def _(v):
    return v.mark_lines.select("entry_id", "line_no", checkboxes.checkbox_state(F.col("text")).alias("s")).select(
        "entry_id", "line_no", "s.state", "s.confidence")


@query("apply_checkbox_overrides", ["fields", "detections"], """
WITH d AS (SELECT entry_id, name AS field_name, arg_max(state, det_no) AS state FROM detections
  WHERE confidence >= 0.75 AND state IN ('checked', 'unchecked') GROUP BY 1, 2)
SELECT coalesce(f.entry_id, d.entry_id) AS entry_id, coalesce(f.field_name, d.field_name) AS field_name,
  CASE d.state WHEN 'checked' THEN 'true' WHEN 'unchecked' THEN '' ELSE f.ocr_value END AS value, d.state IS NOT NULL AS overridden
FROM fields f FULL JOIN d ON f.entry_id = d.entry_id AND f.field_name = d.field_name""")
def _(v):
    fields = v.fields.select("entry_id", "field_name", F.col("ocr_value").alias("value"))
    return checkboxes.apply_checkbox_overrides(fields, v.detections)


TOKEN_SQL = ("list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower({c}), '^checkbox_', ''), "
             "'^field_', ''), '^input_', ''), '[_\\-\\s/]+'), lambda w: w <> '' AND w NOT IN (" + words(checkboxes.STOPWORDS) + ")))")


@query("name_tokens", ["detections"], f"""
SELECT entry_id, det_no, array_to_string(list_sort({TOKEN_SQL.format(c='name')}), ' ') AS tokens FROM detections""")
def _(v):
    return v.detections.select("entry_id", "det_no", F.array_join(
        F.array_sort(checkboxes.name_tokens(F.col("name"))), " ").alias("tokens"))


@query("similar_labels", ["detections", "entries", "template_fields"], """
SELECT d.entry_id, det_no, t.name AS field_name FROM detections d JOIN entries e ON d.entry_id = e.entry_id
JOIN template_fields t ON t.template_id = e.template_id AND t.type = 'checkbox'
WHERE lower(d.name) = lower(t.label) OR 1.0 - levenshtein(lower(d.name), lower(t.label)) / greatest(length(d.name), length(t.label))::DOUBLE >= 0.7""")
def _(v):
    fields = v.template_fields.filter("type = 'checkbox'").select("template_id", F.col("name").alias("field_name"), "label")
    placed = v.detections.join(v.entries.select("entry_id", "template_id"), "entry_id")
    # Each distinct name is compared with the labels of its template once.
    names = placed.select("template_id", "name").distinct().join(fields, "template_id")
    alike = names.filter(checkboxes.similar(F.col("name"), F.col("label"), 0.7)).select("template_id", "name", "field_name")
    return placed.join(alike, ["template_id", "name"]).select("entry_id", "det_no", "field_name")


def _mapping_sql() -> str:
    """The three phases unrolled: one CTE per (phase, field) in schema order adds at most one pick per entry."""
    fields = [(name, label) for name, label, kind, _ in SCHEMA_FIELDS if kind == "checkbox"]
    tokens = lambda c: TOKEN_SQL.format(c=c)
    ctes = [f"d AS (SELECT x.*, {tokens('x.name')} AS tok FROM detections x JOIN entries e ON x.entry_id = e.entry_id WHERE e.template_id < 23)",
            "p0 AS (" + " UNION ALL ".join(
                f"SELECT entry_id, '{name}' AS field_name, min(det_no) AS det_no, 1 AS phase FROM d WHERE lower(name) = '{name}' GROUP BY 1" for name, _ in fields) + ")"]
    step = 0
    for phase in (2, 3):
        for name, label in fields:
            if phase == 2:
                fits = (f"len(list_intersect(tok, {tokens(repr(name))})) / len({tokens(repr(name))})::DOUBLE > 0.7")
            else:
                fits = (f"(lower(name) = lower('{label}') OR 1.0 - levenshtein(lower(name), lower('{label}')) / greatest(length(name), {len(label)})::DOUBLE >= 0.7)")
            ctes.append(f"""p{step + 1} AS (SELECT * FROM p{step} UNION ALL SELECT entry_id, '{name}', det_no, {phase} FROM (
  SELECT d.entry_id, d.det_no, row_number() OVER (PARTITION BY d.entry_id ORDER BY confidence DESC, d.det_no) AS k FROM d
  WHERE {fits} AND NOT EXISTS (SELECT 1 FROM p{step} u WHERE u.entry_id = d.entry_id AND (u.det_no = d.det_no OR u.field_name = '{name}'))) c WHERE k = 1)""")
            step += 1
    return "WITH " + ", ".join(ctes) + f"""
SELECT p.entry_id, field_name, CASE state WHEN 'checked' THEN 'true' WHEN 'unchecked' THEN 'false' ELSE '' END AS value, confidence,
  'checkbox_detection' AS source, anchor_text, state, phase, p.det_no FROM p{step} p JOIN d ON p.entry_id = d.entry_id AND p.det_no = d.det_no"""


@query("map_checkboxes", ["detections", "entries"], _mapping_sql())
def _(v):
    return checkboxes.map_checkboxes(v.detections, v.entries, v.template_fields)


@query("match_visual_boxes", ["mark_lines", "visual_boxes"], """
WITH p AS (SELECT l.entry_id, trim(text) AS label, line_no, box_no, is_checked,
    sqrt(pow(x - (box_left + box_right) / 2, 2) + pow(y - (box_top + box_bottom) / 2, 2)) AS d
  FROM mark_lines l JOIN visual_boxes b ON l.entry_id = b.entry_id WHERE trim(text) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY entry_id, line_no ORDER BY d, box_no) AS k FROM p WHERE d < 60),
w AS (SELECT *, row_number() OVER (PARTITION BY entry_id, label ORDER BY line_no DESC) AS m FROM n WHERE k = 1)
SELECT entry_id, label, line_no, box_no, is_checked, round(d, 6) AS distance FROM w WHERE m = 1""")
def _(v):
    return checkboxes.match_visual_boxes(v.mark_lines, v.visual_boxes).select(
        "entry_id", "label", "line_no", "box_no", "is_checked", F.round("distance", 6).alias("distance"))


# --- patterns ------------------------------------------------------------------------------------------------

def _texts(v):
    return v.spread("documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("full_text"))


def _wanted(v):
    """The typed schema fields of every document, one in three already filled."""
    rows = [(1, "birth_date", "date"), (2, "owner_phone", "phone"), (3, "capitalization", "amount"), (4, "activity_service", "checkbox")]
    fields = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("field_name"), F.lit(t).alias("type")) for i, n, t in rows])
    return v.documents.select(F.col("doc_id").alias("entry_id"), F.explode(fields).alias("f")).select(
        "entry_id", "f.field_name", "f.type",
        F.when((F.col("entry_id") + F.col("f.i")) % 3 == 0, "given").when((F.col("entry_id") + F.col("f.i")) % 3 == 1, " ").alias("ocr_value"))


WANT = """want AS (SELECT doc_id AS entry_id, field_name, type FROM documents, (VALUES (1, 'birth_date', 'date'), (2, 'owner_phone', 'phone'),
  (3, 'capitalization', 'amount'), (4, 'activity_service', 'checkbox')) f(i, field_name, type) WHERE (doc_id + i) % 3 <> 0)"""


def _extract(column: str, items: list[str], group: int = 0, flags: str = "") -> str:
    parts = [f"CASE WHEN regexp_matches({column}, '{flags}{p}') THEN regexp_extract({column}, '{flags}{p}', {group}) END" for p in items]
    return f"coalesce({', '.join(parts)})"


YES = f"(?i)✓|✔|{EDGE_L}yes{EDGE_R}|{EDGE_L}checked{EDGE_R}|{EDGE_L}[Xx][\\s•·*]"
NO = f"(?i)☐|☒|{EDGE_L}no\\s|(?m:{EDGE_L}no$)|{EDGE_L}unchecked{EDGE_R}"


@query("extract_patterns_basic", [], f"""
WITH {WANT},
m AS (SELECT doc_id AS entry_id, {_extract('text', [p.replace('(?iU)', '(?i)').replace(chr(92) + 'w*', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]*') for p in patterns.BASIC_DATE])} AS dat,
    regexp_replace({_extract('text', patterns.BASIC_PHONE)}, '[^0-9+]', '', 'g') AS ph,
    CASE WHEN regexp_matches(text, '{YES}') THEN 'Yes' WHEN regexp_matches(text, '{NO}') THEN 'No' END AS box,
    {_extract('text', patterns.BASIC_AMOUNT, 1)} AS amo FROM documents)
SELECT w.entry_id, w.field_name, CASE type WHEN 'date' THEN dat WHEN 'phone' THEN CASE WHEN starts_with(ph, '+63') THEN ph
    WHEN starts_with(ph, '63') THEN '+' || ph WHEN starts_with(ph, '9') THEN '+63' || ph ELSE '+639' || right(ph, 10) END
    WHEN 'checkbox' THEN box ELSE format('{{:,.2f}}', CAST(replace(amo, ',', '') AS DOUBLE)) END AS ocr_value,
  CAST(CASE type WHEN 'date' THEN 0.5 WHEN 'phone' THEN 0.55 WHEN 'checkbox' THEN 0.45 ELSE 0.4 END AS DOUBLE) AS confidence
FROM want w JOIN m ON w.entry_id = m.entry_id WHERE CASE type WHEN 'date' THEN dat WHEN 'phone' THEN ph WHEN 'checkbox' THEN box ELSE amo END IS NOT NULL""")
def _(v):
    return patterns.extract_patterns_basic(_texts(v), _wanted(v))


V = patterns.VALIDATED
# RE2 has no look-ahead: a mark followed by white space or the end of a line is captured without what follows.
BOX_V = (f"coalesce(CASE WHEN regexp_matches(text, '(?m)[✓✔☑☒✅]\\s*(\\s|$)') THEN regexp_extract(text, '(?m)([✓✔☑☒✅])\\s*(\\s|$)', 1) END, "
         f"CASE WHEN regexp_matches(text, '(?i){EDGE_L}(yes|no|true|false){EDGE_R}') THEN regexp_extract(text, '(?i){EDGE_L}(yes|no|true|false){EDGE_R}', 2) END)")


@query("extract_patterns_validated", [], f"""
WITH {WANT},
m AS (SELECT doc_id AS entry_id, {_extract('text', V['date'], 0, '(?im)')} AS dat, {_extract('text', V['phone'], 0, '(?im)')} AS pho,
    {_extract('text', V['amount'], 0, '(?im)')} AS amo, {BOX_V} AS box FROM documents),
raws AS (SELECT *, dat AS raw FROM m), {_date_cte('raws', 'dmy').replace('dated AS', 'dated0 AS')},
dated AS (SELECT * REPLACE (amo AS raw) FROM dated0), {AMOUNT_CTE.format(source='dated')},
p AS (SELECT *, regexp_replace(pho, '[^0-9+]', '', 'g') AS k, lower(trim(box)) AS bw FROM c1),
q AS (SELECT *, {PHONE} AS ph FROM p),
z AS (SELECT *, CASE WHEN length(ph) = 12 AND regexp_matches(ph, '^639[012]') THEN '+' || ph END AS pv,
  CASE WHEN bw IN ({words(schema.YES_WORDS)}) THEN 'Yes' WHEN bw IN ({words(schema.NO_WORDS)}) THEN 'No' END AS bv FROM q)
SELECT w.entry_id, w.field_name, CASE type WHEN 'date' THEN shown WHEN 'phone' THEN pv WHEN 'amount' THEN shown1 ELSE bv END AS ocr_value,
  CAST(CASE type WHEN 'date' THEN 0.6 WHEN 'phone' THEN 0.55 WHEN 'amount' THEN 0.58 ELSE 0.55 END AS DOUBLE) AS confidence
FROM want w JOIN z ON w.entry_id = z.entry_id
WHERE CASE type WHEN 'date' THEN shown WHEN 'phone' THEN pv WHEN 'amount' THEN shown1 ELSE bv END IS NOT NULL""")
def _(v):
    return patterns.extract_patterns_validated(_texts(v), _wanted(v)).drop("pattern_extracted")
