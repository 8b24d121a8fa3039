"""Row filters and narrow projections over entries and fields."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import text
from docfields.functions.materialize import materialize

VERIFIED = ["verified", "archived"]
EXTRACTED = ["extracted", "verified"]
RETRYABLE = ["uploaded", "processing"]
LOW_CONFIDENCE = 0.7


def _as_timestamp(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def verified_only(entries: DataFrame) -> DataFrame:
    """Entries that carry human-verified data."""
    return entries.filter(F.lower("status").isin(VERIFIED))


def extracted_or_verified(entries: DataFrame) -> DataFrame:
    """Entries whose extraction finished; the status is compared without case."""
    return entries.filter(F.lower("status").isin(EXTRACTED))


def within_days(df: DataFrame, days: int, as_of: datetime | str | Column, column: str = "created_at") -> DataFrame:
    """``column`` later than ``as_of`` minus ``days``. ``as_of`` is explicit so that runs repeat."""
    if days < 1:
        raise ValueError("days must be at least 1")
    start = _as_timestamp(as_of) - F.make_interval(days=F.lit(days))
    return df.filter(F.col(column) > start)


def matching(df: DataFrame, **equals: object) -> DataFrame:
    """Optional equality filters, e.g. ``template_id=3, status=None`` (None means no filter)."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def visible_to(entries: DataFrame, user_id: int, role: str) -> DataFrame:
    """Administrators see all entries, encoders their own uploads."""
    return entries if role == "admin" else entries.filter(F.col("uploaded_by") == F.lit(user_id))


def visible_pairs(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Per encoder the entries they may see (their uploads); administrators are not expanded."""
    encoders = users.filter((F.col("role") == "encoder") & F.col("is_active"))
    return entries.join(encoders.select("user_id"), entries["uploaded_by"] == encoders["user_id"])


def evaluable(fields: DataFrame) -> DataFrame:
    """Fields with a non-empty verified value."""
    return fields.filter(F.col("verified_value").isNotNull() & (F.col("verified_value") != ""))


def low_confidence(fields: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    return fields.filter(F.col("confidence") < threshold)


def active_templates(templates: DataFrame) -> DataFrame:
    return templates.filter("is_active").orderBy("name", "template_id")


def retryable(entries: DataFrame) -> DataFrame:
    return entries.filter(F.lower("status").isin(RETRYABLE))


def validate_field_records(
    fields: DataFrame, max_name: int | None = None, max_value: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Check records; returns (records of clean entries, violations).

    One bad record fails its whole entry. A NULL value becomes '', the name is stripped. Names and values are only
    limited in length where a limit is given.
    """
    name = text.strip(F.col("field_name"))
    checked = (
        fields.withColumn("field_name", name)
        .withColumn("ocr_value", F.coalesce("ocr_value", F.lit("")))
        .withColumn(
            "violation",
            F.when(F.coalesce(name, F.lit("")) == "", F.lit("blank name"))
            .when(F.length(name) > F.lit(max_name), F.lit("name too long"))
            .when(F.length(F.coalesce("ocr_value", F.lit(""))) > F.lit(max_value), F.lit("value too long"))
            .when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit("confidence missing"))
            .when(~F.col("confidence").between(0.0, 1.0), F.lit("confidence out of range")),
        )
    )
    violations = checked.filter("violation is not null")
    # Stored: where few entries fail, Spark knows that before it would deal out all records for the join.
    failed = materialize(violations.select("entry_id").distinct())
    clean = checked.join(failed, "entry_id", "left_anti").drop("violation")
    return clean, violations


def entry_summary_columns(entries: DataFrame) -> DataFrame:
    """Line count and processing time out of the entry's JSON; the time falls back to the column."""
    return entries.select(
        "*",
        F.get_json_object("raw_ocr_data", "$.raw_lines_count").try_cast("int").alias("line_count"),
        F.coalesce(
            F.get_json_object("raw_ocr_data", "$.processing_time").try_cast("double"), F.col("processing_time")
        ).alias("ocr_seconds"),
    )


def entry_listing(entries: DataFrame) -> DataFrame:
    """The narrow list projection."""
    return entries.select(
        "entry_id", "template_id", "uploaded_by", "image_url", "status", "confidence_score", "created_at")
