"""Rounding, averages and clamping that do not depend on the order rows arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidences are averaged as decimals: a sum of doubles changes in its last bits with the
# partitioning, and a report rounded to four digits would then differ between two runs.
_EXACT = "decimal(18,8)"


def exact_avg(column: Column, digits: int = 4) -> Column:
    """Average rounded half-up; NULL for an empty group."""
    return F.round(F.avg(column.cast(_EXACT)), digits).cast("double")


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole rounded half-up, NULL when ``whole`` is zero."""
    ratio = F.try_divide(part.cast("decimal(20,0)") * F.lit(100), whole.cast("decimal(20,0)"))
    return F.round(ratio, digits).cast("double")


def count_where(condition: Column) -> Column:
    """Number of rows where the condition is true."""
    return F.count(F.when(condition, F.lit(1)))


def clamp01(column: Column) -> Column:
    """Clamp a confidence to [0, 1]; NULL stays NULL."""
    return F.when(column.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), column)))
