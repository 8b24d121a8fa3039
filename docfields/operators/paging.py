"""Ordered pages of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(
    df: DataFrame, page_no: int = 1, per_page: int = 20, order_by: str = "created_at", key: str = "entry_id"
) -> DataFrame:
    """Newest first, ties by id. Spark plans this as a top-k per partition, not as a full sort."""
    return (
        df.orderBy(F.col(order_by).desc_nulls_last(), F.col(key))
        .offset((page_no - 1) * per_page).limit(per_page)
    )


def page_after(
    df: DataFrame, last_time: str | None, last_key: object, per_page: int = 20, order_by: str = "created_at", key: str = "entry_id"
) -> DataFrame:
    """The page behind the row (``last_time``, ``last_key``), in the order of ``page``.

    Continues from the last row of the page before instead of counting up to it: what is before that row is filtered
    out, so each partition keeps ``per_page`` rows for whatever page. ``last_time`` None stands for a row without time, as
    those come last.
    """
    time, number = F.col(order_by), F.col(key)
    if last_time is None:
        behind = time.isNull() & (number > F.lit(last_key))
    else:
        last = F.lit(last_time).cast(df.schema[order_by].dataType)
        behind = (time < last) | ((time == last) & (number > F.lit(last_key))) | time.isNull()
    return df.filter(behind).orderBy(time.desc_nulls_last(), number).limit(per_page)


def page_counts(df: DataFrame, per_page: int = 20) -> DataFrame:
    """Total rows and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(per_page)).cast("bigint"))


def newest_users(users: DataFrame) -> DataFrame:
    return users.orderBy(F.col("created_at").desc(), F.col("user_id"))
