"""Rolling quality of extraction, duplicate uploads, upload joins, incremental standardisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docfields.functions.numbers import count_where, exact_avg, percent
from docfields.operators.filters import LOW_CONFIDENCE
from docfields.streaming.progress import foreach_batch

LATENESS, UPLOAD_MINUTES, RESULT_LIFETIME = "1 day", 15, "1 hour"


def confidence_windows(entries: DataFrame, length: str = "30 days", slide: str = "1 day") -> DataFrame:
    """Average, extremes and bin counts of the confidence per sliding window of ``created_at``.

    Entries are added up per ``slide`` first; the overlapping windows then add up those few rows, so that an entry is
    not copied into every window it lies in.
    """
    score = F.col("confidence_score")
    bins = {"very_low": score < 0.3, "low": (score >= 0.3) & (score < 0.7), "medium": (score >= 0.7) & (score < 0.85),
            "high": (score >= 0.85) & (score < 0.95), "very_high": score >= 0.95}
    parts = (
        entries.filter(F.lower("status").isin("extracted", "verified"))
        .withWatermark("created_at", LATENESS)
        .groupBy(F.window("created_at", slide).alias("day"))
        .agg(
            F.sum(score.cast("decimal(18,8)")).alias("_sum"), F.count(score).alias("_scored"),
            F.min(score).alias("_min"), F.max(score).alias("_max"), F.count(F.lit(1)).alias("_n"),
            *[count_where(condition).alias(f"_{name}") for name, condition in bins.items()],
        )
    )
    return (
        parts.groupBy(F.window(F.window_time("day"), length, slide).alias("w"))
        .agg(
            F.round(F.try_divide(F.sum("_sum"), F.sum("_scored").cast("decimal(20,0)")), 4).cast("double").alias("avg_confidence"),
            F.min("_min").alias("min_confidence"), F.max("_max").alias("max_confidence"), F.sum("_n").alias("total_entries"),
            *[F.sum(f"_{name}").alias(f"{name}_count") for name in bins],
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")
    )


def field_windows(fields: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Count, average, corrections and low-confidence share per field name and window."""
    total, corrected = F.count(F.lit(1)), count_where(F.col("was_corrected"))
    window = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return (
        fields.withWatermark("created_at", LATENESS).groupBy(window.alias("w"), "field_name")
        .agg(
            total.alias("total_instances"), exact_avg(F.col("confidence")).alias("avg_confidence"),
            corrected.alias("correction_count"), percent(corrected, total, 2).alias("correction_rate_pct"),
            percent(count_where(F.col("confidence") < LOW_CONFIDENCE), total, 2).alias("low_conf_pct"),
        )
        .select(F.col("w.start").alias("window_start"), "*").drop("w")
    )


def first_submissions(images: DataFrame, lifetime: str = RESULT_LIFETIME) -> DataFrame:
    """Uploads without those that repeat the same (template, md5) within ``lifetime``."""
    return images.withWatermark("created_at", lifetime).dropDuplicatesWithinWatermark(["template_id", "md5"])


def uploads_with_creations(uploads: DataFrame, creations: DataFrame, minutes: int = UPLOAD_MINUTES) -> DataFrame:
    """Stream-stream join: the creation follows the upload metadata within ``minutes``.

    Watermarks on both sides and the range condition let Spark drop state that can no longer match.
    """
    u = uploads.withWatermark("uploaded_at", f"{minutes} minutes").alias("u")
    c = creations.withWatermark("created_at", f"{minutes} minutes").alias("c")
    return u.join(
        c,
        (F.col("u.form_entry_id") == F.col("c.form_entry_id"))
        & (F.col("c.created_at") >= F.col("u.uploaded_at"))
        & (F.col("c.created_at") <= F.col("u.uploaded_at") + F.expr(f"INTERVAL {minutes} MINUTES")),
    ).drop(F.col("c.form_entry_id"))


def standardize_stream(
    fields: DataFrame, profile: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Apply a batch profile to every micro-batch; batch folders are overwritten when a batch is replayed."""
    return foreach_batch(
        fields, lambda df, n: profile(df).write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)
