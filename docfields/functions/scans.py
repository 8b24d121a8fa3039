"""Running maxima, sums and ranks inside a group of any size.

A plain window over ``partitionBy(entry)`` sends one entry to one task, however large. Each function here cuts the
group into blocks, scans the blocks in parallel, scans the block totals (one row per block), and adds the carry of the
earlier blocks to every row. Blocks are ranges of the sort order with about as many rows each, or, where rows are
numbered without gaps, ranges of that number.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize

BLOCK = 4096  # positions per block


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` stored in ranges of (keys, order), with ``_block``, the number of a row's range.

    Ranges are cut where samples of the whole sort order say, so a group with many rows spans several of them even
    if all its rows agree in the first columns. Stored, because the number of a range must not change afterwards, and so
    that the input is not computed again for totals and for rows.
    """
    columns = [*keys, *order]
    ranged = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return materialize(ranged.withColumn("_block", F.spark_partition_id()))


def _with_carry(
    blocked: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    total: Callable[[], Column],
    fold: Callable[[Column], Column],
    frame_end: int,
) -> tuple[DataFrame, Window]:
    """Rows joined with ``_carry`` (fold over all earlier blocks) plus the within-block frame."""
    keys = list(keys)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Only groups of several blocks have a carry. Where every group fits one block this side is empty and
    # AQE drops the join.
    carry = (
        blocked.groupBy(*keys, "_block")
        .agg(total().alias("_total"))
        .withColumn("_carry", fold(F.col("_total")).over(earlier))
        .drop("_total").filter("_carry is not null")
    )
    frame = (
        Window.partitionBy(*keys, "_block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, frame_end)
    )
    return blocked.join(carry, [*keys, "_block"], "left"), frame


def _numbered(df: DataFrame, position: str, value: Column, block: int) -> DataFrame:
    return df.withColumns({"_value": value, "_block": F.floor(F.col(position) / block)})


def running_max_before(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name`` = max(value) over the strictly earlier rows (by integer ``position``); NULL at the start."""
    rows, frame = _with_carry(
        _numbered(df, position, value, block), keys, [position], lambda: F.max("_value"), F.max, -1)
    local = F.max("_value").over(frame)
    return rows.withColumn(name, F.greatest(local, F.col("_carry"))).drop("_block", "_carry", "_value")


def running_sum(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name`` = sum(value) over all rows up to and including this one (by integer ``position``)."""
    rows, frame = _with_carry(
        _numbered(df, position, value, block), keys, [position], lambda: F.sum("_value"), F.sum, 0)
    local = F.sum("_value").over(frame)
    return rows.withColumn(name, local + F.coalesce(F.col("_carry"), F.lit(0))).drop(
        "_block", "_carry", "_value")


def running_sum_of_steps(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, step: Callable[[Column], Column], name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name`` = ``running_sum`` of step(``running_max_before`` of value).

    The blocks are numbered once, so that rows are shuffled for the maximum and stay where they are for the sum.
    """
    kept = df.columns
    rows, frame = _with_carry(
        _numbered(df, position, value, block), keys, [position], lambda: F.max("_value"), F.max, -1)
    rows = rows.withColumn("_max", F.greatest(F.max("_value").over(frame), F.col("_carry")))
    rows = rows.select(*kept, "_block", step(F.col("_max")).alias("_value"))
    rows, frame = _with_carry(rows, keys, [position], lambda: F.sum("_value"), F.sum, 0)
    return rows.select(*kept, (F.sum("_value").over(frame) + F.coalesce(F.col("_carry"), F.lit(0))).alias(name))


def ordered_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based row number by ``order`` (nulls first)."""
    rows, frame = _with_carry(
        ordered_blocks(df, keys, order, partitions), keys, order, lambda: F.count(F.lit(1)), F.sum, 0)
    local = F.row_number().over(frame)
    return rows.withColumn(name, (local + F.coalesce(F.col("_carry"), F.lit(0))).cast("bigint")).drop(
        "_block", "_carry")


def previous_value(blocked: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Add ``name`` = the largest smaller ``column`` of the group; rows are ``ordered_blocks`` by it, distinct per group."""
    rows, frame = _with_carry(blocked, keys, [column], lambda: F.max(column), F.max, -1)
    local = F.max(column).over(frame)
    return rows.withColumn(name, F.coalesce(local, F.col("_carry"))).drop("_carry")


def running_max_through(blocked: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add ``name`` = max(value) over the rows up to this one; rows are ``ordered_blocks`` by ``order``."""
    rows, frame = _with_carry(blocked.withColumn("_value", value), keys, order, lambda: F.max("_value"), F.max, 0)
    local = F.max("_value").over(frame)
    return rows.withColumn(name, F.greatest(local, F.col("_carry"))).drop("_carry", "_value")
