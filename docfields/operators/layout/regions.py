"""Regions of a form: section titles, check-box groups and blocks of text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import text
from docfields.functions.kernels import ship_by_value
from docfields.functions.materialize import materialize
from docfields.functions.scans import BLOCK, ordered_rank, running_sum_of_steps

# Confidence by kind of region, distances in pixels, limits of a box-like line.
TITLE_CONFIDENCE, GROUP_CONFIDENCE, TEXT_CONFIDENCE = 0.85, 0.70, 0.75
GROUP_GAP, GROUP_OVERLAP, TEXT_GAP = 30.0, -5.0, 50.0
SHORT_LENGTH, SHORT_WORDS = 20, 3

ship_by_value(__name__)


def is_title(column: Column) -> Column:
    """'A. SOMETHING': a letter, a dot, all upper case, 2 to 99 characters."""
    value = text.strip(column)
    upper = (F.upper(value) == value) & (F.lower(value) != value)
    return F.length(value).between(2, 99) & value.rlike(r"^\p{L}\.") & upper


def is_short(column: Column) -> Column:
    """Under 20 characters and at most three words (an empty line counts)."""
    value = text.strip(column)
    return (F.length(value) < SHORT_LENGTH) & (F.size(F.split(value, r"\s+")) <= SHORT_WORDS)


def _segments(lines: DataFrame) -> DataFrame:
    """Cut each entry where no group can continue, so that even one huge entry runs on many tasks.

    A group's scan stops at the first unused line that starts more than 30 px below its last member. A
    line that starts more than 30 px below *every* short line before it therefore stops all earlier
    groups: what follows is independent of what precedes.
    """
    short = lines.select(
        "entry_id", "line_no", F.col("box.top").alias("top"), F.col("box.left").alias("left"),
        F.col("box.bottom").alias("bottom"), F.col("box.right").alias("right"), is_short(F.col("text")).alias("short"))
    return running_sum_of_steps(
        short, ["entry_id"], "line_no", F.when(F.col("short"), F.col("bottom")),
        lambda reach: F.when(F.col("top") - reach > GROUP_GAP, 1).otherwise(0).cast("bigint"), "segment")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chain short lines into groups, one pass over lines sorted by (entry, segment, line).

    State is the list of open chains of the current segment only. A line is offered to the chains in the
    order they were opened: a chain it lies too far below is closed, the first chain it fits takes it, and
    a short line nobody takes opens a chain of its own.
    """
    key, chains = None, []
    for batch in batches:
        out = []
        columns = ("entry_id", "segment", "line_no", "top", "left", "bottom", "right", "short")
        for entry, segment, line, top, left, bottom, right, short in zip(*(batch[c].tolist() for c in columns)):
            if (entry, segment) != key:
                key, chains = (entry, segment), []
            taken, still_open = False, []
            for chain in chains:
                if taken:
                    still_open.append(chain)
                    continue
                gap = top - chain["bottom"]
                if gap > GROUP_GAP:
                    continue
                still_open.append(chain)
                if short and gap > GROUP_OVERLAP and not (right < chain["left"] or left > chain["right"]):
                    if chain["size"] == 1:
                        out.append((entry, chain["seed"], chain["seed"]))
                    out.append((entry, line, chain["seed"]))
                    chain.update(bottom=bottom, left=left, right=right, size=chain["size"] + 1)
                    taken = True
            chains = still_open
            if short and not taken:
                chains.append({"seed": line, "bottom": bottom, "left": left, "right": right, "size": 1})
        yield pd.DataFrame(out, columns=["entry_id", "line_no", "group_no"])


def detect_checkbox_groups(lines: DataFrame) -> DataFrame:
    """(entry_id, line_no, group_no) of lines in groups of two or more; group_no is the first line's number.

    The walk is sequential within a segment only. It keeps the open chains, never a whole segment.
    """
    boxed = lines.filter("box is not null")
    ordered = (
        _segments(boxed).repartition("entry_id", "segment")
        .sortWithinPartitions("entry_id", "segment", "line_no")
    )
    kind = lines.schema["entry_id"].dataType.simpleString()
    return ordered.mapInPandas(_walk, f"entry_id {kind}, line_no bigint, group_no bigint")


def region_lines(lines: DataFrame) -> DataFrame:
    """Every line with the region it belongs to: (entry, region_type, region_key, line).

    A short title line can also be part of a check-box group and then appears twice, as documented.
    """
    boxed = lines.filter("box is not null")
    titles = boxed.filter(is_title(F.col("text"))).withColumns(
        {"region_type": F.lit("section_title"), "region_key": F.col("line_no")})
    members = detect_checkbox_groups(lines)
    # One join for members and for leftovers: a used line has a list, which is empty for one that is a title only.
    used = members.unionByName(titles.select("entry_id", "line_no", F.lit(None).cast("bigint").alias("group_no")))
    used = used.groupBy("entry_id", "line_no").agg(F.collect_list("group_no").alias("_groups"))
    marked = materialize(boxed.join(used, ["entry_id", "line_no"], "left"))  # scanned for groups and for each step below
    grouped = marked.withColumn("region_key", F.explode("_groups")).drop("_groups").withColumn(
        "region_type", F.lit("checkbox_group"))
    rest = marked.filter("_groups is null").drop("_groups")
    blocks = running_sum_of_steps(
        rest, ["entry_id"], "line_no", F.col("box.bottom"),
        lambda below: F.when(F.col("box.top") - below > TEXT_GAP, 1).otherwise(0), "region_key").withColumn(
        "region_type", F.lit("text_field"))
    return titles.unionByName(grouped).unionByName(blocks)


def classify_regions(lines: DataFrame) -> DataFrame:
    """One row per region, numbered from the top of each entry (ties: titles, groups, text; then line).

    A region is named by its whole text, one line after the other; like the full text of an entry this is one value.
    """
    members = materialize(region_lines(lines).select(
        "entry_id", "region_type", "region_key", "line_no", "text", "box"))
    keys = ["entry_id", "region_type", "region_key"]
    value = text.strip(F.coalesce("text", F.lit("")))
    # Blocks of lines first, so that no row holds the single lines of a large region.
    edges = {"top": F.min, "left": F.min, "bottom": F.max, "right": F.max}
    blocks = members.groupBy(*keys, F.floor(F.col("line_no") / BLOCK).alias("_block")).agg(
        *[fold(f"box.{edge}").alias(edge) for edge, fold in edges.items()], F.min("line_no").alias("first_line"),
        F.count(F.lit(1)).alias("line_count"), F.array_sort(F.collect_list(F.struct("line_no", value.alias("p")))).alias("_said"))
    blocks = blocks.withColumn("_said", F.array_join("_said.p", " "))
    bounds = blocks.groupBy(*keys).agg(
        F.struct(*[fold(edge).alias(edge) for edge, fold in edges.items()]).alias("box"), F.min("first_line").alias("first_line"),
        F.sum("line_count").alias("line_count"),
        F.array_join(F.array_sort(F.collect_list(F.struct("_block", "_said")))["_said"], " ").alias("_name"))
    kind = F.col("region_type")
    confidence = (
        F.when(kind == "section_title", TITLE_CONFIDENCE).when(kind == "checkbox_group", GROUP_CONFIDENCE)
        .otherwise(TEXT_CONFIDENCE)
    )
    fallback = F.when(kind == "checkbox_group", "Checkbox Group").otherwise("Text Field")
    placed = bounds.withColumns({
        "_top": F.col("box.top"),
        "_kind": F.when(kind == "section_title", 0).when(kind == "checkbox_group", 1).otherwise(2)})
    ranked = ordered_rank(placed, ["entry_id"], ["_top", "_kind", "first_line"], "region_no")
    return ranked.select(
        "entry_id", "region_no", "region_type", F.coalesce(F.nullif("_name", F.lit("")), fallback).alias("name"), "box",
        confidence.alias("confidence"), "first_line", "line_count")
