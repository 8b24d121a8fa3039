"""Layout jobs against plain loops written for the tests, on random pages and on one very large entry."""

import random

import pytest
from pyspark.sql import functions as F

from docfields.functions import scans
from docfields.functions.percentiles import exact_percentiles
from docfields.operators import lines as line_ops
from docfields.operators.layout import anchors, checkboxes, positional, regions
from docfields.sources import boxes

LINE = "entry_id long, line_no long, text string, confidence double, box struct<top:double,left:double,bottom:double,right:double>"


def page(rng, entry, n):
    rows, y = [], 0
    for i in range(n):
        y += rng.choice([0, 4, 12, 18, 25, 45, 70])
        x = rng.choice([0, 30, 60, 120, 300])
        text = rng.choice(["yes", "no", "", "Service", "A. OWNER", "With TIN now", "a rather long line of text here", "one two three four", "✓ Retailer"])
        top = max(0, y + rng.choice([-20, 0, 0, 3]))
        rows.append((entry, i, text, rng.randint(0, 100) / 100, (float(top), float(x), float(top + rng.choice([8, 12, 20])), float(x + rng.choice([20, 60, 150])))))
    return rows


def slow_groups(rows):
    """Seed by seed, looking ahead: the rule as it is stated."""
    short = [len(r[2].strip()) < 20 and len(r[2].split()) <= 3 for r in rows]
    used, found = set(), {}
    for i, row in enumerate(rows):
        if i in used or not short[i]:
            continue
        used.add(i)
        members, ref = [i], row[4]
        for j in range(i + 1, len(rows)):
            if j in used:
                continue
            top, left, bottom, right = rows[j][4]
            gap = top - ref[2]
            if gap > 30:
                break
            if gap > -5 and not (right < ref[1] or left > ref[3]) and short[j]:
                members.append(j)
                used.add(j)
                ref = rows[j][4]
        if len(members) > 1:
            found.update({j: i for j in members})
    return found


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(7)
    data = [page(rng, e, rng.randint(1, 60)) for e in range(60)] + [page(rng, 99, 9000)]
    return data, spark.createDataFrame([r for p in data for r in p], LINE).repartition(4).cache()


def test_checkbox_groups_match_the_plain_loop(pages):
    data, df = pages
    got = {(r.entry_id, r.line_no): r.group_no for r in regions.detect_checkbox_groups(df).collect()}
    want = {(p[0][0], j): i for p in data for j, i in slow_groups(p).items()}
    assert got == want


def test_large_entry_is_cut_into_segments(pages):
    _, df = pages
    boxed = df.filter("entry_id = 99")
    sizes = regions._segments(boxed).groupBy("segment").count().agg(F.max("count"), F.count("count")).first()
    assert sizes[1] > 50 and sizes[0] < 2000


def test_regions(pages):
    data, df = pages
    got = regions.classify_regions(df).cache()
    counts = {(r.entry_id, r.region_type): r.n for r in got.groupBy("entry_id", "region_type").agg(F.count("*").alias("n")).collect()}
    for p in data:
        groups, entry = slow_groups(p), p[0][0]
        titles = [i for i, r in enumerate(p) if r[2].strip() == "A. OWNER"]
        rest = [r for i, r in enumerate(p) if i not in groups and i not in titles]
        blocks, bottom = 0, None
        for r in rest:
            if bottom is None or r[4][0] - bottom > 50:
                blocks, bottom = blocks + 1, r[4][2]
            bottom = max(bottom, r[4][2])
        assert counts.get((entry, "section_title"), 0) == len(titles)
        assert counts.get((entry, "checkbox_group"), 0) == len(set(groups.values()))
        assert counts.get((entry, "text_field"), 0) == blocks
    ordered = got.filter("entry_id = 3").orderBy("region_no").select("box.top").collect()
    assert [r.top for r in ordered] == sorted(r.top for r in ordered)
    assert got.filter("name = ''").count() == 0


@pytest.mark.parametrize("edge, threshold, job", [(0, 15, positional.group_rows), (1, 50, positional.group_columns)])
def test_rows_and_columns(pages, edge, threshold, job):
    data, df = pages
    column = "row_no" if edge == 0 else "column_no"
    got = {(r.entry_id, r.line_no): r[column] for r in job(df).collect()}
    for p in data:
        group, first = 0, None
        for r in sorted(p, key=lambda r: r[4][edge]):
            if first is None or r[4][edge] - first > threshold:
                group, first = group + 1, r[4][edge]
            assert got[r[0], r[1]] == group


def test_scans_equal_loops(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 999)) for k, n in ((1, 3), (2, 20000)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    out = scans.running_sum(scans.running_max_before(df, ["k"], "i", F.col("v"), "m", 512), ["k"], "i", F.col("v"), "s", 512)
    got = {(r.k, r.i): (r.m, r.s) for r in out.collect()}
    for k in (1, 2):
        best, total = None, 0
        for _, i, v in (r for r in rows if r[0] == k):
            total += v
            assert got[k, i] == (best, total)
            best = v if best is None else max(best, v)


def test_exact_percentiles(spark):
    import numpy as np

    rng = random.Random(2)
    data = {k: [round(rng.random(), 3) for _ in range(n)] for k, n in ((1, 1), (2, 2), (3, 999), (4, 5000))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [(5, None)], "k int, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], F.col("v"), {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert [got[k].a, got[k].b, got[k].c] == pytest.approx(list(np.percentile(vs, [25, 50, 90])))


def test_percentiles_of_values_that_lie_close_together(spark):
    """Values far outside [0, 1], in a sliver of it, tied, infinite: no node of more than a few values is ranked."""
    import numpy as np

    rng = random.Random(4)
    groups = {
        "sliver": [0.5 + rng.random() / 10_000 for _ in range(3000)], "wide": [rng.uniform(-1e9, 1e9) for _ in range(1500)],
        "skewed": [10.0 ** rng.uniform(-9, 9) * rng.choice([-1, 1]) for _ in range(500)], "ties": [rng.randrange(3) / 7 for _ in range(900)],
        "one": [4.5], "huge": [1.7e308 * (i / 200 - 1) for i in range(400)]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("none", None), ("inf", float("inf")), ("inf", 1.0), ("inf", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.937, "e": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], F.col("v"), wanted, buckets=64, together=60).collect()}
    assert set(got) == {*groups, "inf"} and tuple(got["inf"])[1:] == (1.0, float("inf"), float("inf"), float("inf"), float("inf"))
    for k, values in groups.items():
        for name, p in wanted.items():
            low, high = (sorted(values)[int(f((len(values) - 1) * p))] for f in (np.floor, np.ceil))
            assert min(low, high) <= got[k][name] <= max(low, high)
            if k != "huge":
                assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-9)
    every = exact_percentiles(df.filter("k = 'sliver'"), [], F.col("v"), {"m": 0.5}, buckets=256, together=20).first().m
    assert every == pytest.approx(np.quantile(groups["sliver"], 0.5), rel=1e-12)
    assert exact_percentiles(df.limit(0), ["k"], F.col("v"), {"m": 0.5}).count() == 0


def greedy(detections, fields):
    """Phase by phase in schema order, for one entry."""
    def tokens(name):
        import re
        name = name.lower()
        for prefix in checkboxes.PREFIXES:
            if name.startswith(prefix):
                name = name[len(prefix):]
        return {t for t in re.split(r"[_\-\s/]+", name) if t and t not in checkboxes.STOPWORDS}

    def close(a, b):
        a, b = a.lower().strip(), b.lower().strip()
        if a == b:
            return True
        if not a or not b:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return 1 - row[-1] / max(len(a), len(b)) >= 0.7

    mapped, used = {}, set()
    for name, _ in fields:
        for no, det, _ in detections:
            if no not in used and det.lower() == name.lower():
                mapped[name], _ = no, used.add(no)
                break
    for test in (lambda d, n, l: len(tokens(n) & tokens(d)) / max(len(tokens(n)), 1) > 0.7, lambda d, n, l: bool(l) and close(d, l)):
        for name, label in fields:
            if name in mapped:
                continue
            fit = [(-conf, no) for no, det, conf in detections if no not in used and test(det, name, label)]
            if fit:
                mapped[name] = min(fit)[1]
                used.add(min(fit)[1])
    return mapped


def test_checkbox_mapping_matches_the_greedy_loop(spark):
    rng = random.Random(5)
    fields = [("activity_service", "Service"), ("activity_retailer", "Retailer Activity"), ("partner_sss", "SSS Member"),
              ("same_as_business", "Same as Business"), ("service_area", "Service Area")]
    names = ["activity_service", "service activity", "Activity_Service", "retailer activiti", "sss membr", "input_sss partner", "same as busines",
             "service", "servic", "area_service", "checkbox_service_area", "other", "retailer", "activity retailer x"]
    data = {e: [(i, rng.choice(names), rng.randint(0, 20) / 20) for i in range(rng.randint(1, 25))] for e in range(80)}
    det = spark.createDataFrame([(e, i, n, "checked", c, "t") for e, ds in data.items() for i, n, c in ds],
                                "entry_id long, det_no long, name string, state string, confidence double, anchor_text string")
    entries = spark.createDataFrame([(e, 1) for e in data], "entry_id long, template_id long")
    schema = spark.createDataFrame([(1, p, n, l, "checkbox") for p, (n, l) in enumerate(fields)],
                                   "template_id long, field_pos int, name string, label string, type string")
    got = {(r.entry_id, r.field_name): r.det_no for r in checkboxes.map_checkboxes(det, entries, schema).collect()}
    assert got == {(e, n): no for e, ds in data.items() for n, no in greedy(ds, fields).items()}


def test_visual_boxes_match_all_pairs(spark):
    rng = random.Random(3)
    lines = [(1, i, f"label {i % 40}", 0.9, (float(y), float(x), y + 10.0, x + 40.0)) for i in range(120)
             for x, y in [(rng.randint(-200, 800), rng.randint(-200, 800))]]
    marks = [(1, i, float(rng.randint(-200, 800)), float(rng.randint(-200, 800)), bool(i % 2), 0.5) for i in range(150)]
    got = {r.label: r.box_no for r in checkboxes.match_visual_boxes(
        spark.createDataFrame(lines, LINE),
        spark.createDataFrame(marks, "entry_id long, box_no long, x double, y double, is_checked boolean, confidence double")).collect()}
    want = {}
    for _, _, label, _, (t, l, b, r) in lines:
        d = [(((m[2] - (l + r) / 2) ** 2 + (m[3] - (t + b) / 2) ** 2) ** 0.5, m[1]) for m in marks]
        if min(d)[0] < 60:
            want[label] = min(d)[1]
    assert got == want


def test_boxes_lie_in_few_cells(spark):
    rng = random.Random(4)
    marks = [(1, i, rng.uniform(-500, 500), rng.uniform(-500, 500), True, 0.5) for i in range(2000)]
    df = spark.createDataFrame(marks, "entry_id long, box_no long, x double, y double, is_checked boolean, confidence double")
    cells = checkboxes.box_cells(df).groupBy("box_no").count().collect()
    assert len(cells) == 2000 and max(r["count"] for r in cells) <= 4 and sum(r["count"] for r in cells) < 2.5 * 2000


def test_checkbox_states(spark):
    cases = {"✓": ("checked", 0.92), "X": ("checked", 0.92), "☐": ("unchecked", 0.85), "[]": ("unchecked", 0.85), "~": ("unclear", 0.5),
             "??": ("unclear", 0.5), "Manufacturer": ("unchecked", 0.70), "": ("unclear", 0.3), "[x] Manufacturer": ("checked", 0.88),
             "---": ("unchecked", 0.65), "box": ("unchecked", 0.70), "a..b": ("unclear", 0.5)}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", checkboxes.checkbox_state(F.col("t")).alias("s"))
    assert [(r.s.state, r.s.confidence) for r in df.orderBy("i").collect()] == list(cases.values())


def one_template(spark, fields):
    rows = [(1, i, n, l, t, o, a, (0.0, 0.0, 1.0, 1.0), None) for i, (n, l, t, o, a) in enumerate(fields)]
    return spark.createDataFrame(rows, "template_id long, field_pos int, name string, label string, type string, options array<string>, "
                                 "anchor_labels array<string>, region struct<x_min:double,y_min:double,x_max:double,y_max:double>, ai_prompt_hint string")


def test_template_map(spark):
    entries = spark.createDataFrame([(1, 1), (2, 1)], "entry_id long, template_id long")
    lines = spark.createDataFrame([
        (1, 0, "Business Name: ACME Trading", 0.9, (0.0, 0.0, 10.0, 100.0)), (1, 1, "Owner Name", 0.8, (200.0, 0.0, 210.0, 50.0)),
        (1, 2, "Juan Dela Cruz", 0.7, (200.0, 60.0, 210.0, 120.0)), (1, 3, "[x] Renewal", None, (400.0, 0.0, 410.0, 50.0)),
        (1, 4, "Status: yes", 0.5, (600.0, 0.0, 610.0, 50.0))], LINE)
    fields = one_template(spark, [("business_name", "Business Name", "text", [], []), ("owner", "Owner Name", "text", [], []),
                                  ("renewal", "Renewal", "checkbox", [], []), ("status", "Status", "radio", ["new", "old"], []),
                                  ("missing", "Nothing Here", "text", [], [])])
    got = {(r.entry_id, r.field_name): (r.value, r.confidence, r.unresolved) for r in anchors.extract_template_map(entries, lines, fields).collect()}
    assert got[1, "business_name"] == ("ACME Trading", 0.9, False)
    assert got[1, "owner"] == ("Juan Dela Cruz", 0.7, False)
    assert got[1, "renewal"] == ("true", 0.6, False)
    assert got[1, "status"] == ("new", 0.5, False)
    assert got[1, "missing"] == ("", 0.0, True) and got[2, "owner"] == ("", 0.0, True)
    found = {r.field_name: r.value for r in positional.extract_by_label_position(entries.filter("entry_id = 1"), lines, fields).collect()}
    assert found["owner"].startswith("Juan Dela Cruz")
    naive = {r.field_name: (r.ocr_value, r.confidence) for r in anchors.extract_naive(entries.filter("entry_id = 1"), lines, fields).collect()}
    assert naive["owner"] == ("Juan Dela Cruz", 0.7) and naive["missing"] == ("", 0.0)


def test_boxes(spark):
    cases = {"[[30,90],[80,90],[80,110],[30,110]]": (90, 30, 110, 80), "[30, 90, 80, 110]": (90, 30, 110, 80), "[[10]]": None, "oops": None, "[1,2]": None}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, bbox string")
    good, bad = boxes.normalize_bbox(df)
    assert [tuple(r.box) for r in good.orderBy("i").collect()] == [v for v in cases.values() if v]
    assert bad.count() == 3
    assert boxes.normalize_bbox(df, on_bad="default")[0].filter("box.right = 100").count() == 3


def test_reading_order_and_full_text(spark):
    lines = spark.createDataFrame([(1, 0, "A", 0.9, (5.0, 100.0, 9.0, 120.0)), (1, 1, "B", 0.9, (5.0, 50.0, 9.0, 70.0)), (1, 2, "C", 0.9, (5.0, 150.0, 9.0, 170.0))], LINE)
    assert [r.text for r in line_ops.reading_order(lines).orderBy("reading_no").collect()] == ["B", "A", "C"]
    many = spark.range(10000).selectExpr("1L AS entry_id", "id AS line_no", "string(id) AS text")
    assert line_ops.full_text(many).first().full_text == "\n".join(str(i) for i in range(10000))


def test_a_hot_page_is_ranked_by_several_tasks(spark):
    """One entry holds a third of all lines, half of them without a box; its rows lie in several blocks."""
    lines = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END entry_id", "id line_no", "concat('t', id) text", "0.5D confidence",
        "CASE WHEN id % 2 = 0 THEN named_struct('top', (id * 7919) % 13 + 0.0D, 'left', (id % 40) * 10.0D, 'bottom', 0.0D, 'right', 0.0D) END box")
    order = ["top", "left", "line_no"]
    placed = lines.select("entry_id", "line_no", F.col("box.top").alias("top"), F.col("box.left").alias("left"))
    for partitions in (None, 40):
        blocks = scans.ordered_blocks(placed, ["entry_id"], order, partitions).filter("entry_id = 0")
        if partitions:
            sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
            assert len(sizes) > 8 and max(sizes) < 500
            assert blocks.filter("top is null").select("_block").distinct().count() > 3
        ranked = scans.ordered_rank(placed, ["entry_id"], order, "n", partitions)
        rows = [(r.top is not None, r.top, r.left, r.line_no, r.n) for r in ranked.filter("entry_id = 0").collect()]
        assert [r[-1] for r in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2] or 0, r[3]))] == list(range(1, 2001))
        assert ranked.filter("entry_id <> 0").agg(F.min("n"), F.max("n"), F.count("n")).first() == (1, 1, 4000)
    got = line_ops.reading_order(lines)
    assert got.columns == [*lines.columns, "reading_no"] and got.filter("entry_id = 0").agg(F.count_distinct("reading_no")).first()[0] == 2000


def _walked(values, threshold):
    start, out = None, {}
    for c in sorted(set(values)):
        if start is None or c > start + threshold:
            start = c
        out[c] = start
    return out


def test_long_runs_equal_the_walk(spark):
    rng = random.Random(6)
    pages = {k: [rng.randrange(span) / 4 for _ in range(n)] for k, n, span in ((1, 600, 2500), (2, 40, 4000), (3, 1, 5), (4, 300, 900))}
    rows = [(k, i, (c, 0.0, 0.0, 0.0)) for k, cs in pages.items() for i, c in enumerate(cs)]
    lines = spark.createDataFrame(rows, "entry_id bigint, line_no bigint, box struct<top:double,left:double,bottom:double,right:double>")
    walked = sorted(tuple(r) for r in positional._grouped(lines, "top", 15.0, "row_no").select("entry_id", "line_no", "row_no").collect())
    for limit in (50,):
        got = positional._grouped(lines, "top", 15.0, "row_no", limit).select("entry_id", "line_no", "row_no")
        assert sorted(tuple(r) for r in got.collect()) == walked
    for k, cs in pages.items():
        starts = _walked(cs, 15.0)
        number = {c: i for i, c in enumerate(sorted(set(starts.values())), 1)}
        assert {(i, n) for e, i, n in walked if e == k} == {(i, number[starts[c]]) for i, c in enumerate(cs)}


def test_an_unbroken_run_is_solved_on_many_tasks(spark):
    """Every step of the doubling is dealt by single coordinates."""
    runs = spark.range(1000).selectExpr("1L entry_id", "0.0D _run", "id * 1.0D _c")
    got = positional.long_run_starts(runs, 15.0)
    assert {r._c: r._start for r in got.collect()} == {float(i): float(i // 16 * 16) for i in range(1000)}


def test_rows_of_an_unbroken_run(spark):
    lines = spark.range(500).selectExpr("1L entry_id", "id line_no", "named_struct('top', id * 4.0D, 'left', 0.0D, 'bottom', 0.0D, 'right', 0.0D) box")
    got = {r.line_no: r.row_no for r in positional.group_rows(lines).collect()}
    assert got == {i: i // 4 + 1 for i in range(500)}


def test_rows_of_a_template_are_not_collected_for_each_entry(spark):
    entries = spark.range(20000).select(F.col("id").alias("entry_id"), F.lit(1).cast("long").alias("template_id"))
    lines = spark.range(20000).selectExpr("id AS entry_id", "0L AS line_no", "'Some label 3: value' AS text", "0.9D AS confidence",
                                         "named_struct('top', 0D, 'left', 0D, 'bottom', 10D, 'right', 50D) AS box")
    fields = one_template(spark, [(f"field_number_{i}", f"Some label {i}", "text", [], []) for i in range(60)])
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64MB")
    try:
        assert anchors.page_membership(lines, entries, fields).count() == 20000
        got = anchors.extract_template_map(entries, lines, fields).filter("not unresolved").collect()
        assert len(got) == 20000 and {(r.field_name, r.value) for r in got} == {("field_number_3", "value")}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_repeated_entries_multiply_lines_as_before(spark):
    entries = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1)], "entry_id long, template_id long")
    lines = spark.createDataFrame([(1, 0, "x", 0.9, (0.0, 0.0, 10.0, 50.0)), (2, 0, "x", 0.9, None), (None, 0, "x", 0.9, None)], LINE)
    got = anchors.page_membership(lines, entries, one_template(spark, [("a", "A", "text", [], [])])).collect()
    assert [(r.entry_id, r.line_no, r.field_names) for r in got] == [(1, 0, ["a"])] * 4


def test_sum_of_steps_over_running_maxima_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, *range(500)])) for k, n in ((1, 4), (2, 700), (None, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i long, v long").repartition(5)
    step = lambda before: F.when(F.col("v") > before, 1).otherwise(0)
    got = scans.running_sum_of_steps(df, ["k"], "i", F.col("v"), step, "s", block=64)
    assert got.columns == ["k", "i", "v", "s"]
    want = {}
    for k, i, v in rows:
        total, most = want.get((k, i - 1), (0, None))
        total += most is not None and v is not None and v > most
        want[k, i] = total, v if most is None else max(most, v if v is not None else most)
    # A null key has no carry, as in the other scans.
    assert {(r.k, r.i): r.s for r in got.where("k is not null").collect()} == {k: v[0] for k, v in want.items() if k[0] is not None}
    # The rows are dealt out once for both steps.
    plan = got._jdf.queryExecution().executedPlan().toString()
    old = scans.running_sum(scans.running_max_before(df, ["k"], "i", F.col("v"), "m", block=64), ["k"], "i", step(F.col("m")), "s", block=64)
    assert plan.count("Exchange hashpartitioning") < old._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
