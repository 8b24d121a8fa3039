"""Check boxes: state of a line, detections from groups, overrides, and matching to schema fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import text
from docfields.functions.materialize import materialize
from docfields.functions.scans import ordered_rank
from docfields.operators.layout.regions import detect_checkbox_groups

# Marks of each state, tried in this order: unclear, checked, unchecked.
UNCLEAR = r"~|\.{2,}|\?"
CHECKED = r"✓|✔|\bx\b|☑|\|\||█|■|●|\[\s*[x✓✔]\s*\]"
UNCHECKED = r"☐|○|\[\s*\]|\(\s*\)"

# Labels of the registration form and the fields they stand for (case matters).
LABEL_FIELDS = {
    "Manufacturer": "activity_manufacturer", "Producer": "activity_producer", "Service": "activity_service",
    "Retailer": "activity_retailer", "Wholesaler": "activity_wholesaler", "Importer": "activity_importer",
    "Exporter": "activity_exporter", "Single": "civil_status_single", "Married": "civil_status_married",
    "Widowed": "civil_status_widowed", "Legally Separated": "civil_status_legally_separated",
    "Male": "gender_male", "Female": "gender_female", "NEW": "reg_type_new", "RENEWAL": "reg_type_renewal",
    "With TIN": "tin_status_with_tin", "Without TIN": "tin_status_without_tin",
}
LINE_CONFIDENCE, OVERRIDE_CONFIDENCE = 0.9, 0.75

# Prefixes and words without meaning in a field name.
PREFIXES = ["checkbox_", "field_", "input_"]
STOPWORDS = ["the", "a", "an", "and", "or", "of", "in", "is", "it"]
TOKEN_OVERLAP, LABEL_SIMILARITY, BOX_DISTANCE = 0.7, 0.70, 60.0
GRID = 4  # side of a grid cell, in distances


def checkbox_state(column: Column) -> Column:
    """struct(state, confidence) of a line of text."""
    value = F.coalesce(column, F.lit(""))

    def found(pattern: str) -> Column:
        return value.rlike(f"(?iU){pattern}")

    def result(state: str, confidence: float | Column) -> Column:
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(state).alias("state"), confidence.alias("confidence"))

    return (
        F.when(value == "", result("unclear", 0.3))
        .when(found(UNCLEAR), result("unclear", 0.5))
        .when(found(CHECKED), result("checked", F.when(F.length(value) > 10, 0.88).otherwise(0.92)))
        .when(found(UNCHECKED), result("unchecked", 0.85))
        .when((F.length(value) > 2) & ~value.rlike(r"[\p{L}\p{N}]"), result("unchecked", 0.65))
        .otherwise(result("unchecked", 0.70))
    )


def detect_checkboxes(lines: DataFrame) -> DataFrame:
    """One detection per non-blank line of a check-box group, numbered in reading order of the groups."""
    # Written once: the group tops, the rows and their ranks all start from it.
    members = materialize(lines.join(detect_checkbox_groups(lines), ["entry_id", "line_no"]).select(
        "entry_id", "line_no", "group_no", "confidence", "box",
        text.strip(F.coalesce("text", F.lit(""))).alias("anchor_text")))
    tops = members.groupBy("entry_id", "group_no").agg(F.min("box.top").alias("_top"))
    known = F.create_map(*[F.lit(x) for pair in LABEL_FIELDS.items() for x in pair])
    name = F.coalesce(F.element_at(known, F.col("anchor_text")),
                      F.replace(F.lower("anchor_text"), F.lit(" "), F.lit("_")))
    rows = (
        members.filter("anchor_text <> ''").join(tops, ["entry_id", "group_no"])
        .withColumn("_s", checkbox_state(F.col("anchor_text")))
        .select(
            "entry_id", "group_no", "line_no", "_top", name.alias("name"), F.col("_s.state").alias("state"),
            (F.col("_s.confidence") * F.coalesce("confidence", F.lit(LINE_CONFIDENCE))).alias("confidence"),
            "box", "anchor_text")
    )
    return ordered_rank(rows, ["entry_id"], ["_top", "group_no", "line_no"], "det_no").select(
        "entry_id", "det_no", "line_no", "name", "state", "confidence", "box", "anchor_text")


def apply_checkbox_overrides(fields: DataFrame, detections: DataFrame) -> DataFrame:
    """Values of (entry, field) replaced by confident detections: checked 'true', unchecked ''.

    Unclear detections leave the value; of several detections of one name the last one decides.
    """
    sure = detections.filter((F.col("confidence") >= OVERRIDE_CONFIDENCE) & F.col("state").isin("checked", "unchecked"))
    last = sure.groupBy("entry_id", F.col("name").alias("field_name")).agg(F.max_by("state", "det_no").alias("_state"))
    joined = fields.join(last, ["entry_id", "field_name"], "full_outer")
    decided = F.when(F.col("_state") == "checked", "true").when(F.col("_state") == "unchecked", "")
    return joined.withColumn("value", F.when(F.col("_state").isNotNull(), decided).otherwise(F.col("value"))).withColumn(
        "overridden", F.col("_state").isNotNull()).drop("_state")


def name_tokens(name: Column) -> Column:
    """Lower-case words of a field name without prefix and stop words. camelCase is not split."""
    cleaned = F.lower(name)
    for prefix in PREFIXES:
        cleaned = F.regexp_replace(cleaned, f"^{prefix}", "")
    words = F.split(cleaned, r"[_\-\s/]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS)))


def similar(left: Column, right: Column, threshold: float = 0.75) -> Column:
    """1 - edit distance / longer length reaches ``threshold`` (stripped, case-free)."""
    a, b = F.lower(text.strip(left)), F.lower(text.strip(right))
    longest = F.greatest(F.length(a), F.length(b))
    # The length difference is a lower bound of the distance and spares most distance computations.
    possible = (1.0 - F.abs(F.length(a) - F.length(b)) / longest) >= threshold
    close = (1.0 - F.levenshtein(a, b) / longest) >= threshold
    return F.when(a == b, True).when((a == "") | (b == ""), False).when(possible, close).otherwise(False)


def map_checkboxes(detections: DataFrame, entries: DataFrame, template_fields: DataFrame) -> DataFrame:
    """Match detections to the check-box fields of the entry's template, one to one.

    Phase 1 takes equal names, phase 2 name tokens, phase 3 similar labels; phases 2 and 3 go through the
    fields in schema order and take the most confident free detection. At most F - 1 detections can be
    taken before a field's turn (F = check-box fields of the template), so its F best candidates
    are enough for an exact result and the last step works on at most F x F numbers per entry.
    """
    boxes = template_fields.filter("type = 'checkbox'").select(
        "template_id", "field_pos", F.col("name").alias("field_name"), F.lower("name").alias("_key"), "label",
        name_tokens(F.col("name")).alias("_tokens"),
        F.count(F.lit(1)).over(Window.partitionBy("template_id")).alias("_limit"))
    found = detections.join(entries.select("entry_id", "template_id"), "entry_id")
    exact = (
        found.withColumn("_key", F.lower("name")).join(boxes, ["template_id", "_key"])
        .groupBy("entry_id", "template_id", "field_pos", "field_name").agg(F.min("det_no").alias("det_no"))
    )
    free = found.join(exact.select("entry_id", "det_no"), ["entry_id", "det_no"], "left_anti")
    # Names repeat from form to form: each distinct (template, name) is compared with the fields once.
    names = found.select("template_id", "name").distinct().withColumn("_words", name_tokens(F.col("name")))
    shared = F.size(F.array_intersect("_tokens", "_words"))
    by_token = (F.size("_tokens") > 0) & (shared / F.size("_tokens") > TOKEN_OVERLAP)
    by_label = (F.coalesce("label", F.lit("")) != "") & similar(F.col("name"), F.col("label"), LABEL_SIMILARITY)
    phases = F.array_compact(F.array(F.when(by_token, F.lit(2)), F.when(by_label, F.lit(3))))
    matches = names.join(boxes, "template_id").select(
        "template_id", "name", "field_pos", "field_name", "_limit", F.explode(phases).alias("phase"))
    best = Window.partitionBy("entry_id", "field_pos", "phase").orderBy(F.col("confidence").desc(), "det_no")
    candidates = (
        free.join(matches, ["template_id", "name"])
        .select("entry_id", "field_pos", "field_name", "det_no", "confidence", "phase", "_limit")
        .withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= F.col("_limit"))
    )
    taken = exact.select("entry_id", "field_pos")
    offers = (
        candidates.join(taken, ["entry_id", "field_pos"], "left_anti")
        .groupBy("entry_id", "phase", "field_pos", "field_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "det_no"))), lambda s: s["det_no"]).alias("dets"))
        .groupBy("entry_id")
        .agg(F.array_sort(F.collect_list(F.struct("phase", "field_pos", "field_name", "dets"))).alias("_offers"))
    )
    start = F.array().cast("array<struct<phase:int,field_pos:int,field_name:string,det_no:bigint>>")

    def assign(done: Column, offer: Column) -> Column:
        used = F.transform(done, lambda d: d["det_no"])
        pick = F.get(F.filter(offer["dets"], lambda d: ~F.array_contains(used, d)), 0)
        served = F.exists(done, lambda d: d["field_pos"] == offer["field_pos"])
        row = F.struct(offer["phase"].alias("phase"), offer["field_pos"].alias("field_pos"),
                       offer["field_name"].alias("field_name"), pick.alias("det_no"))
        return F.when(served | pick.isNull(), done).otherwise(F.concat(done, F.array(row)))

    fuzzy = offers.select("entry_id", F.explode(F.aggregate("_offers", start, assign)).alias("m")).select(
        "entry_id", "m.field_name", "m.det_no", "m.phase")
    mapped = exact.select("entry_id", "field_name", "det_no", F.lit(1).alias("phase")).unionByName(fuzzy)
    value = F.when(F.col("state") == "checked", "true").when(F.col("state") == "unchecked", "false").otherwise("")
    return mapped.join(detections, ["entry_id", "det_no"]).select(
        "entry_id", F.lower("field_name").alias("field_name"), value.alias("value"), "confidence",
        F.lit("checkbox_detection").alias("source"), F.coalesce("anchor_text", F.lit("")).alias("anchor_text"),
        "state", "phase", "det_no")


def box_cells(visual_boxes: DataFrame) -> DataFrame:
    """Each box once for every grid cell (_cx, _cy) that a centre under 60 px from it can lie in."""
    side = GRID * BOX_DISTANCE

    def reached(place: str) -> Column:
        low, high = F.col(place) - BOX_DISTANCE, F.col(place) + BOX_DISTANCE
        return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))

    return visual_boxes.withColumn("_cx", reached("x")).withColumn("_cy", reached("y")).select(
        "entry_id", "box_no", "x", "y", "is_checked", F.col("confidence").alias("box_confidence"), "_cx", "_cy")


def match_visual_boxes(lines: DataFrame, visual_boxes: DataFrame) -> DataFrame:
    """Nearest visual box (under 60 px from the label's centre) per label text; the last line of a text wins.

    Lines and boxes meet in a grid of 240 px cells. A line is in the cell of its centre; a box in every cell that a
    centre under 60 px from it can lie in, one to four and 2.25 of them on average. That covers every such pair without
    pairing all lines and boxes of an entry.
    """
    side = GRID * BOX_DISTANCE
    labels = (
        lines.filter("box is not null").withColumns({
            "label": text.strip(F.coalesce("text", F.lit(""))),
            "_lx": (F.col("box.left") + F.col("box.right")) / 2, "_ly": (F.col("box.top") + F.col("box.bottom")) / 2})
        .filter("label <> ''")
        .select("entry_id", "line_no", "label", "_lx", "_ly",
                F.floor(F.col("_lx") / side).alias("_cx"), F.floor(F.col("_ly") / side).alias("_cy"))
    )
    distance = F.sqrt(F.pow(F.col("x") - F.col("_lx"), 2) + F.pow(F.col("y") - F.col("_ly"), 2))
    pairs = labels.join(box_cells(visual_boxes), ["entry_id", "_cx", "_cy"]).withColumn("distance", distance).filter(
        F.col("distance") < BOX_DISTANCE)
    # The last line and its nearest box in one aggregate; a line without a number comes behind all others.
    order = F.when(F.col("line_no").isNotNull(), F.struct(-F.col("line_no"), "distance", "box_no"))
    last = pairs.groupBy("entry_id", "label").agg(F.min_by(F.struct(
        "line_no", F.struct("box_no", "is_checked", "box_confidence", "distance").alias("b")), order).alias("w"))
    return last.select("entry_id", "label", "w.line_no", "w.b.box_no", "w.b.is_checked", "w.b.box_confidence",
                       "w.b.distance")
