"""Quality reports over entries, fields and templates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions.numbers import count_where, exact_avg, percent
from docfields.functions.percentiles import exact_percentiles
from docfields.operators import joins
from docfields.operators.filters import (
    LOW_CONFIDENCE,
    evaluable,
    entry_summary_columns,
    extracted_or_verified,
    low_confidence,
    verified_only,
    within_days,
)

# Upper cut of each confidence bin and the labels of the distribution report.
CUTS = [0.3, 0.7, 0.85, 0.95]
BIN_LABELS = [
    "0.0-0.3 (Very Low)",
    "0.3-0.7 (Low)",
    "0.7-0.85 (Medium)",
    "0.85-0.95 (High)",
    "0.95-1.0 (Very High)",
]


def _reported(entries: DataFrame, days: int, as_of: datetime | str) -> DataFrame:
    return within_days(extracted_or_verified(entries), days, as_of)


def _round(column: Column, digits: int = 4) -> Column:
    # Rounding to 12 digits first puts 0.49434999999999996 back on the tie it stands for.
    return F.round(F.round(column, 12), digits).cast("double")


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two one-row frames in one row: a union of both, reduced by max (which skips NULLs)."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def confidence_report(entries: DataFrame, days: int, as_of: datetime | str) -> DataFrame:
    """One row: average, exact quartiles, extremes and the five bin counts of the period."""
    score = F.col("confidence_score")
    base = _reported(entries, days, as_of).select("confidence_score")
    totals = base.agg(
        exact_avg(score).alias("system_confidence"),
        _round(F.min(score)).alias("min_confidence"),
        _round(F.max(score)).alias("max_confidence"),
        F.count(F.lit(1)).alias("total_entries"),
        count_where(score < 0.3).alias("very_low_count"),
        count_where((score >= 0.3) & (score < 0.7)).alias("low_count"),
        count_where((score >= 0.7) & (score < 0.85)).alias("medium_count"),
        count_where((score >= 0.85) & (score < 0.95)).alias("high_count"),
        count_where(score >= 0.95).alias("very_high_count"),
    )
    quartiles = exact_percentiles(base, [], score, {"p25": 0.25, "median_confidence": 0.5, "p75": 0.75})
    return _side_by_side(totals, quartiles).select(
        "system_confidence", *[_round(F.col(c)).alias(c) for c in ("median_confidence", "p25", "p75")],
        "min_confidence", "max_confidence", "total_entries", "very_low_count", "low_count",
        "medium_count", "high_count", "very_high_count",
    )


def template_analysis(entries: DataFrame, templates: DataFrame, days: int, as_of: datetime | str) -> DataFrame:
    """Confidence per template, weakest first. The standard deviation of a single entry is NULL."""
    score = F.col("confidence_score")
    base = joins.entries_with_templates(
        _reported(entries, days, as_of).select("template_id", "confidence_score"), templates)
    stats = base.groupBy("template_id", "template_name").agg(
        F.count(F.lit(1)).alias("total_entries"),
        exact_avg(score).alias("avg_confidence"),
        _round(F.stddev_samp(score)).alias("stddev_confidence"),
        _round(F.min(score)).alias("min_confidence"),
        _round(F.max(score)).alias("max_confidence"),
    )
    medians = exact_percentiles(base, ["template_id"], score, {"median_confidence": 0.5})
    return (
        stats.join(medians, "template_id", "left")
        .withColumn("median_confidence", _round(F.col("median_confidence")))
        .orderBy(F.col("avg_confidence").asc_nulls_last(), "template_id")
    )


def field_analysis(
    fields: DataFrame, days: int, as_of: datetime | str, sort_by: str = "correction_rate"
) -> DataFrame:
    """Confidence and correction rate per field name."""
    orders = {
        "correction_rate": F.col("correction_rate_pct").desc_nulls_first(),
        "avg_confidence": F.col("avg_field_confidence").asc_nulls_last(),
        "field_name": F.col("field_name").asc_nulls_last(),
    }
    if sort_by not in orders:
        raise ValueError(f"sort_by must be one of {sorted(orders)}")
    total, corrected = F.count(F.lit(1)), count_where(F.col("was_corrected"))
    return (
        within_days(fields, days, as_of)
        .groupBy("field_name")
        .agg(
            total.alias("total_instances"),
            exact_avg(F.col("confidence")).alias("avg_field_confidence"),
            corrected.alias("correction_count"),
            percent(corrected, total, 2).alias("correction_rate_pct"),
            percent(count_where(F.col("confidence") < LOW_CONFIDENCE), total, 2).alias("low_conf_pct"),
            _round(F.min("confidence")).alias("min_confidence"),
            _round(F.max("confidence")).alias("max_confidence"),
        )
        .orderBy(orders[sort_by], "field_name")
    )


def low_confidence_fields(
    fields: DataFrame, days: int, as_of: datetime | str, threshold: float = LOW_CONFIDENCE
) -> DataFrame:
    """Field names with values under the threshold, most corrected first."""
    total, corrected = F.count(F.lit(1)), count_where(F.col("was_corrected"))
    return (
        within_days(low_confidence(fields, threshold), days, as_of)
        .groupBy("field_name")
        .agg(
            exact_avg(F.col("confidence")).alias("avg_confidence"),
            total.alias("occurrences"),
            corrected.alias("corrections"),
            percent(corrected, total, 1).alias("correction_rate_pct"),
        )
        .orderBy(F.col("correction_rate_pct").desc(), F.col("avg_confidence"), "field_name")
    )


def image_quality_impact(entries: DataFrame, days: int, as_of: datetime | str) -> DataFrame:
    """Processing time by number of OCR lines and rounded confidence."""
    seconds = F.col("ocr_seconds")
    base = entry_summary_columns(
        _reported(entries, days, as_of).filter("raw_ocr_data is not null"))
    return (
        base.groupBy("line_count", F.round("confidence_score", 1).alias("confidence_bin"))
        .agg(
            F.count(F.lit(1)).alias("entry_count"),
            exact_avg(seconds, 2).alias("avg_processing_time_s"),
            _round(F.min(seconds), 2).alias("min_time_s"),
            _round(F.max(seconds), 2).alias("max_time_s"),
        )
        .orderBy(F.col("line_count").desc_nulls_first(), F.col("confidence_bin").asc_nulls_last())
    )


def confidence_bin(score: Column, null_policy: str = "as_reference") -> Column:
    """Label of the bin. A missing score counts as the top bin unless ``null_policy`` is "separate"."""
    labels = F.when(score < CUTS[0], BIN_LABELS[0])
    for cut, label in zip(CUTS[1:], BIN_LABELS[1:-1]):
        labels = labels.when(score < cut, label)
    if null_policy == "separate":
        labels = labels.when(score.isNull(), "missing")
    return labels.otherwise(BIN_LABELS[-1])


def confidence_distribution(
    entries: DataFrame, days: int, as_of: datetime | str, null_policy: str = "as_reference"
) -> DataFrame:
    """Count and share of each confidence bin, lowest first."""
    counts = (
        _reported(entries, days, as_of)
        .groupBy(confidence_bin(F.col("confidence_score"), null_policy).alias("confidence_bin"))
        .agg(F.count(F.lit(1)).alias("entry_count"))
    )
    # The window runs over the handful of bin rows, not over entries.
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn(
        "percentage", percent(F.col("entry_count"), F.sum("entry_count").over(everything), 1)
    ).orderBy("confidence_bin")


def training_stats(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """One row: verified entries, their fields, corrections and average confidence."""
    verified = verified_only(entries).select("entry_id")
    total, corrected = F.count(F.lit(1)), count_where(F.col("was_corrected"))
    field_stats = fields.join(verified, "entry_id").agg(
        total.alias("total_fields"),
        corrected.alias("total_corrected_fields"),
        F.coalesce(percent(corrected, total, 2), F.lit(0.0)).alias("correction_rate"),
        F.coalesce(exact_avg(F.col("confidence")), F.lit(0.0)).alias("avg_confidence"),
    )
    entry_stats = verified.agg(F.count(F.lit(1)).alias("total_verified_entries"))
    return _side_by_side(entry_stats, field_stats)


def training_templates(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """Verified entries per template, most first."""
    return (
        joins.entries_with_templates(verified_only(entries).select("entry_id", "template_id"), templates)
        .groupBy("template_id", "template_name")
        .agg(F.count(F.lit(1)).alias("verified_entries"))
        .orderBy(F.col("verified_entries").desc(), "template_id")
    )


def training_export(
    entries: DataFrame, fields: DataFrame, templates: DataFrame, *, template_id: int | None = None,
    limit: int | None = None, offset: int = 0, corrected_only: bool = False,
) -> DataFrame:
    """Verified entries with nested fields, last updated first.

    Paging comes before ``corrected_only`` drops fields and then emptied entries. Without ``limit``
    the whole set is exported and no global sort is made.
    """
    base = verified_only(entries)
    if template_id is not None:
        base = base.filter(F.col("template_id") == template_id)
    if limit is not None:
        base = base.orderBy(F.col("updated_at").desc_nulls_last(), "entry_id").offset(offset).limit(limit)
    values = fields.select(
        "entry_id", "field_name", F.coalesce("ocr_value", F.lit("")).alias("ocr_value"),
        F.coalesce("verified_value", F.lit("")).alias("verified_value"), "was_corrected", "confidence")
    if corrected_only:
        values = values.filter("was_corrected")
    # Only fields of the exported entries are computed and nested.
    values = values.join(base.select("entry_id"), "entry_id", "left_semi")
    nested = joins.entries_with_fields(
        base, values, "ocr_value", "verified_value", "was_corrected", "confidence")
    if corrected_only:
        nested = nested.filter(F.size("fields") > 0)
    return joins.entries_with_template_names(nested, templates).select(
        "entry_id", "template_id", "template_name", "image_url", "confidence_score", "processing_time",
        "fields")


def _evaluated(entries: DataFrame, fields: DataFrame) -> DataFrame:
    return joins.fields_with_entries(evaluable(fields), verified_only(entries), "template_id")


def _exact_match() -> Column:
    # A missing OCR value is no match (SQL '=').
    return F.col("ocr_value") == F.col("verified_value")


def evaluation_overall(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """Accuracy of the extraction against human-verified values."""
    total = F.count(F.lit(1))
    exact, corrected = count_where(_exact_match()), count_where(F.col("was_corrected"))
    # One pre-aggregated row per entry: the number of entries is then a plain count, not a distinct.
    per_entry = _evaluated(entries, fields).groupBy("entry_id").agg(
        total.alias("n"), exact.alias("exact"), corrected.alias("corrected"),
        F.sum(F.col("confidence").cast("decimal(18,8)")).alias("conf_sum"),
        F.count("confidence").alias("conf_n"),
    )
    n, e, c = F.sum("n"), F.sum("exact"), F.sum("corrected")
    return per_entry.agg(
        F.count(F.lit(1)).alias("total_entries_evaluated"),
        F.coalesce(n, F.lit(0)).alias("total_fields_evaluated"),
        F.coalesce(percent(e, n, 2), F.lit(0.0)).alias("field_accuracy"),
        F.coalesce(
            F.round(F.try_divide(F.sum("conf_sum"), F.sum("conf_n")), 4).cast("double"), F.lit(0.0)
        ).alias("avg_confidence"),
        F.coalesce(percent(c, n, 2), F.lit(0.0)).alias("correction_rate"),
    )


def _accuracy(keys: list[str], base: DataFrame, total_name: str) -> DataFrame:
    total = F.count(F.lit(1))
    exact, corrected = count_where(_exact_match()), count_where(F.col("was_corrected"))
    return base.groupBy(*keys).agg(
        total.alias(total_name),
        exact.alias("exact_matches"),
        corrected.alias("corrected"),
        percent(exact, total, 2).alias("field_accuracy"),
        F.coalesce(exact_avg(F.col("confidence")), F.lit(0.0)).alias("avg_confidence"),
    )


def evaluation_per_template(entries: DataFrame, fields: DataFrame, templates: DataFrame) -> DataFrame:
    """Accuracy per template name."""
    base = joins.entries_with_templates(_evaluated(entries, fields), templates)
    return _accuracy(["template_name"], base, "field_count").drop("corrected")


def evaluation_per_field(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """Accuracy per field name, most corrected first."""
    return _accuracy(["field_name"], _evaluated(entries, fields), "total").orderBy(
        F.col("corrected").desc(), "field_name")


def before_after(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Filled fields and average confidence before and after a rule pass (columns value, confidence)."""
    keys = keys or []

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            count_where(F.coalesce(F.col("value"), F.lit("")) != "").alias(f"filled_{suffix}"),
            F.coalesce(exact_avg(F.col("confidence")), F.lit(0.0)).alias(f"avg_confidence_{suffix}"),
        )

    left, right = side(before, "before"), side(after, "after")
    return left.join(right, keys, "full_outer") if keys else _side_by_side(left, right)


def source_mix(fields: DataFrame) -> DataFrame:
    """Count, average confidence and correction rate per extraction source."""
    total, corrected = F.count(F.lit(1)), count_where(F.col("was_corrected"))
    return fields.groupBy("source").agg(
        total.alias("field_count"),
        exact_avg(F.col("confidence")).alias("avg_confidence"),
        percent(corrected, total, 2).alias("correction_rate_pct"),
    )


def rollup_entry(entries: DataFrame, fields: DataFrame, line_counts: DataFrame | None = None) -> DataFrame:
    """Field counts, average confidence and the field-to-source map of each entry.

    ``line_counts`` (entry_id, raw_lines_count) adds the number of OCR lines. The map is bounded by the
    number of fields of a template; of a repeated name it has the source of the most confident row.
    """
    named = F.array_sort(F.collect_list(F.struct("field_name", "confidence", "source")))
    last_of_name = F.expr("filter(_named, (x, i) -> i = size(_named) - 1 OR _named[i + 1].field_name <> x.field_name)")
    summary = fields.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("field_count"),
        count_where(F.coalesce(F.col("ocr_value"), F.lit("")) != "").alias("filled_count"),
        exact_avg(F.col("confidence")).alias("confidence_score"),
        named.alias("_named"),
    ).withColumn("field_sources", F.map_from_entries(F.transform(last_of_name, lambda x: F.struct(x["field_name"], x["source"])))).drop("_named")
    rolled = entries.drop("confidence_score").join(summary, "entry_id", "left").withColumns({
        "field_count": F.coalesce("field_count", F.lit(0)),
        "filled_count": F.coalesce("filled_count", F.lit(0)),
        "confidence_score": F.coalesce("confidence_score", F.lit(0.0)),
    })
    if line_counts is not None:
        rolled = rolled.join(line_counts, "entry_id", "left").withColumn(
            "raw_lines_count", F.coalesce("raw_lines_count", F.lit(0)))
    return rolled
