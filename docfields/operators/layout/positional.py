"""Values beside or below their label, and rows and columns of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.kernels import ship_by_value
from docfields.functions.materialize import materialize
from docfields.functions.scans import BLOCK, ordered_blocks, ordered_rank, previous_value, running_max_through
from docfields.operators.layout.anchors import with_template_rows

# Distances in pixels.
SAME_ROW, SAME_COLUMN, REACH = 30.0, 50.0, 150.0
DEFAULT_CONFIDENCE = 0.5
LONG_RUN = 100_000  # coordinates one task walks through

ship_by_value(__name__)


def _value_of(label: Column, box: Column) -> Column:
    """Is ``box`` right of or below ``label`` and within reach?"""
    right = (box["left"] > label["right"]) & (F.abs(box["top"] - label["top"]) < SAME_ROW)
    below = (box["top"] > label["top"]) & (F.abs(box["left"] - label["left"]) < SAME_COLUMN)
    return (right | below) & (box["left"] - label["right"] < REACH)


def label_boxes(entries: DataFrame, lines: DataFrame, template_fields: DataFrame) -> DataFrame:
    """Box of the first line (with a box) that contains the label, per (entry, field)."""
    labels = template_fields.select("template_id", F.col("name").alias("field_name"),
                                    F.lower("label").alias("_label"))
    boxed = with_template_rows(
        lines.filter("box is not null").withColumn("_hay", F.lower("text")), entries, labels, "_labels")
    fitting = F.filter("_labels", lambda a: F.col("_hay").contains(a["_label"]))
    hits = boxed.withColumn("_hit", F.explode(fitting)).select("*", "_hit.field_name")
    return hits.groupBy("entry_id", "field_name").agg(F.min_by("box", "line_no").alias("label_box"))


def extract_by_label_position(entries: DataFrame, lines: DataFrame, template_fields: DataFrame) -> DataFrame:
    """Text of all lines right of or below the label in line order, with their mean confidence."""
    found = label_boxes(entries, lines, template_fields)
    pairs = (
        lines.filter("box is not null").join(found, "entry_id")
        .filter((F.col("box") != F.col("label_box")) & _value_of(F.col("label_box"), F.col("box")))
    )
    keys = ["entry_id", "field_name"]
    # One pass: texts and sums of blocks of lines, then a few blocks of each field.
    number = F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).cast("decimal(18,8)")
    blocks = pairs.groupBy(*keys, F.floor(F.col("line_no") / BLOCK).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text")))).alias("_l"),
        F.sum(number).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    blocks = blocks.select(*keys, "_block", F.array_join("_l.text", " ").alias("_text"), "_sum", "_n")
    joined = blocks.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_block", "_text")))["_text"], " ").alias("_text"),
        (F.sum("_sum").cast("decimal(28,12)") / F.sum("_n").cast("decimal(12,0)")).cast("decimal(22,12)").cast("double").alias("_conf"))
    wanted = entries.select("entry_id", "template_id").join(
        template_fields.select("template_id", F.col("name").alias("field_name")), "template_id")
    return wanted.join(joined, keys, "left").select(
        *keys, F.coalesce(F.trim("_text"), F.lit("")).alias("value"),
        F.coalesce("_conf", F.lit(0.0)).alias("confidence"))


def _walk(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """The start of each coordinate's group, over rows sorted by (entry, run, coordinate); the state is one number."""
    key, start = None, 0.0
    for batch in batches:
        starts = []
        for entry, run, c in zip(*(batch[n].tolist() for n in ("entry_id", "_run", "_c"))):
            if (entry, run) != key or c > start + threshold:
                key, start = (entry, run), c
            starts.append(start)
        yield pd.DataFrame({"entry_id": batch["entry_id"], "_c": batch["_c"], "_start": starts})


def _next_starts(coords: DataFrame, threshold: float) -> DataFrame:
    """(entry_id, _c, _next): the first coordinate of the entry that would open a group after one that starts at _c.

    Coordinates and the ends of their groups are put into one falling order; the last coordinate seen before an end is
    the first one beyond it.
    """
    ends = coords.select("entry_id", "_c", (-(F.col("_c") + threshold)).alias("_w"), F.lit(0).alias("_node"))
    nodes = coords.select("entry_id", "_c", (-F.col("_c")).alias("_w"), F.lit(1).alias("_node"))
    order = ["_w", "_node"]
    seen = running_max_through(ordered_blocks(ends.unionAll(nodes), ["entry_id"], order), ["entry_id"], order,
                               F.when(F.col("_node") == 1, F.col("_w")), "_seen")
    return seen.filter("_node = 0").select("entry_id", "_c", (-F.col("_seen")).alias("_next"))


def long_run_starts(runs: DataFrame, threshold: float) -> DataFrame:
    """(entry_id, _c, _start) of runs of any length, given (entry_id, _run, _c), without a walk.

    Which coordinates start a group is a chain: from the first of the run to the first one beyond its group, and so on.
    Pointer doubling finds the chain in as many rounds as its length has bits: what is reached also reaches its jump, and
    jumps double. Every round is a join on single coordinates, so a run of any length is spread over all tasks.
    """
    runs = materialize(runs.select("entry_id", "_run", "_c"))
    own = runs.select("entry_id", F.col("_c").alias("_next"), F.col("_run").alias("_next_run"))
    jumps = runs.join(_next_starts(runs.select("entry_id", "_c"), threshold), ["entry_id", "_c"]).join(
        own, ["entry_id", "_next"]).filter("_run = _next_run").select("entry_id", "_c", "_next")
    jumps = materialize(jumps)
    reached = runs.select("entry_id", F.col("_run").alias("_c")).distinct()
    while not jumps.isEmpty():
        further = reached.join(jumps, ["entry_id", "_c"]).select("entry_id", F.col("_next").alias("_c"))
        reached = materialize(reached.union(further).distinct())
        double = jumps.withColumnRenamed("_next", "_mid").join(
            jumps.select("entry_id", F.col("_c").alias("_mid"), "_next"), ["entry_id", "_mid"])
        jumps = materialize(double.select("entry_id", "_c", "_next"))
    marked = runs.join(reached.withColumn("_opens", F.lit(True)), ["entry_id", "_c"], "left")
    found = running_max_through(ordered_blocks(marked, ["entry_id"], ["_c"]), ["entry_id"], ["_c"],
                                F.when(F.col("_opens"), F.col("_c")), "_start")
    return found.select("entry_id", "_c", "_start")


def _grouped(lines: DataFrame, edge: str, threshold: float, name: str, long_run: int = LONG_RUN) -> DataFrame:
    """Number groups of lines along one edge.

    A line opens a new group when it lies more than ``threshold`` from the group's first line. Only the
    distinct coordinates matter. A gap above the threshold between neighbours always opens a group, which
    cuts a page into independent runs; within a run of up to ``long_run`` coordinates one ordered walk remembers the
    start of the open group, and longer ones are solved by ``long_run_starts``.
    """
    coords = lines.filter("box is not null").select("entry_id", F.col(f"box.{edge}").alias("_c")).distinct()
    linked = previous_value(ordered_blocks(coords, ["entry_id"], ["_c"]), ["entry_id"], "_c", "_prev")
    opens = F.col("_prev").isNull() | (F.col("_c") > F.col("_prev") + threshold)
    runs = materialize(running_max_through(linked, ["entry_id"], ["_c"], F.when(opens, F.col("_c")), "_run").select(
        "entry_id", "_run", "_c"))
    long = runs.groupBy("entry_id", "_run").count().filter(F.col("count") > long_run).select("entry_id", "_run")
    any_long = not long.isEmpty()
    short = runs.join(long, ["entry_id", "_run"], "left_anti") if any_long else runs
    ordered = short.repartition("entry_id", "_run").sortWithinPartitions("entry_id", "_run", "_c")
    kind = lines.schema["entry_id"].dataType.simpleString()
    starts = ordered.mapInPandas(
        lambda batches: _walk(batches, threshold), f"entry_id {kind}, _c double, _start double")
    if any_long:
        starts = starts.unionByName(long_run_starts(runs.join(long, ["entry_id", "_run"], "left_semi"), threshold))
    starts = materialize(starts)
    numbered = ordered_rank(starts.select("entry_id", "_start").distinct(), ["entry_id"], ["_start"], name)
    placed = lines.filter("box is not null").withColumn("_c", F.col(f"box.{edge}"))
    return placed.join(starts, ["entry_id", "_c"]).join(numbered, ["entry_id", "_start"]).drop("_c", "_start")


def group_rows(lines: DataFrame, threshold: float = 15.0) -> DataFrame:
    """Add ``row_no`` (1-based from the top); lines without a box are left out."""
    return _grouped(lines, "top", threshold, "row_no")


def group_columns(lines: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Add ``column_no`` (1-based from the left); lines without a box are left out."""
    return _grouped(lines, "left", threshold, "column_no")
