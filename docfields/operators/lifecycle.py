"""Snapshot-in, snapshot-out jobs over the life of an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.operators import filters, reports

# Error vocabulary, delays in seconds, retries, lifetime of a stored result.
CONNECTION_TYPES = ["ConnectionError", "ConnectionResetError", "BrokenPipeError"]
BASE_DELAY, PARTIAL_DELAY, MAX_RETRIES, RESULT_TTL = 10, 2, 3, 3600


def latest_snapshot(rows: DataFrame, keys: list[str], ts: str = "updated_at") -> DataFrame:
    """Newest row per key of an append-only table, as a map-side combined aggregate."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(ts, *[
        c for c in others if c != ts and _sortable(rows, c)])).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def _sortable(rows: DataFrame, column: str) -> bool:
    return not rows.schema[column].dataType.typeName() in ("map", "variant")


def check_verifications(entries: DataFrame, verifications: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``reason`` (NULL = accepted): missing entry, foreign entry of an encoder, or wrong status."""
    roles = users.select(F.col("user_id").alias("verifier_id"), "role")
    state = entries.select("entry_id", "uploaded_by", "status")
    reason = (
        F.when(F.col("status").isNull(), "entry not found")
        .when((F.coalesce("role", F.lit("encoder")) == "encoder") & (F.col("uploaded_by") != F.col("verifier_id")),
              "not the uploader")
        .when(~F.lower("status").isin(filters.EXTRACTED), "wrong status")
    )
    return verifications.join(state, "entry_id", "left").join(roles, "verifier_id", "left").withColumn(
        "reason", reason).drop("uploaded_by", "status", "role")


def apply_verifications(
    entries: DataFrame, fields: DataFrame, verifications: DataFrame, users: DataFrame
) -> dict[str, DataFrame]:
    """Human values into fields and entries; returns entries, fields, rejects and audit rows.

    Several submissions of one entry apply in time order: per field the last value counts, per entry the
    last submission. A field is corrected when the new value differs from the OCR value (NULL differs).
    """
    checked = check_verifications(entries, verifications, users)
    accepted = checked.filter("reason is null").drop("reason")
    values = (
        accepted.select("entry_id", "verifier_id", "ts", F.explode("verified_fields").alias("field_name", "_v"))
        .groupBy("entry_id", "field_name")
        .agg(F.max_by(F.struct("_v"), F.struct("ts", "verifier_id", "_v")).alias("_new"))
    )
    hit = F.col("_new").isNotNull()
    new_fields = fields.join(values, ["entry_id", "field_name"], "left").withColumns({
        "verified_value": F.when(hit, F.col("_new._v")).otherwise(F.col("verified_value")),
        "was_corrected": F.when(hit, ~F.col("ocr_value").eqNullSafe(F.col("_new._v"))).otherwise(F.col("was_corrected")),
    }).drop("_new")
    last = accepted.groupBy("entry_id").agg(
        F.max_by(F.struct("verifier_id", "verified_fields"), F.struct("ts", "verifier_id")).alias("_last"))
    done = F.col("_last").isNotNull()
    before = F.col("verified_data") if "verified_data" in entries.columns else F.lit(None)
    new_entries = entries.join(last, "entry_id", "left").withColumns({
        "status": F.when(done, "verified").otherwise(F.col("status")),
        "verified_by": F.when(done, F.col("_last.verifier_id")).otherwise(F.col("verified_by")),
        "verified_data": F.when(done, F.col("_last.verified_fields")).otherwise(before),
    }).drop("_last")
    audit = accepted.select(
        F.col("verifier_id").alias("user_id"), F.lit("verify").alias("action"), F.lit("form_entry").alias("entity_type"),
        F.col("entry_id").alias("entity_id"), F.col("verified_fields").alias("changes"),
        F.lit("verified values submitted").alias("description"), F.col("ts").alias("created_at"))
    return {"entries": new_entries, "fields": new_fields, "rejects": checked.filter("reason is not null"),
            "audit_log": audit}


def reset_for_retry(entries: DataFrame, fields: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested entries that wait or are being processed start over: fields gone, results cleared."""
    reset = filters.retryable(entries).join(ids.select("entry_id").distinct(), "entry_id", "left_semi").select(
        "entry_id", F.lit(True).alias("_reset"))
    joined = entries.join(reset, "entry_id", "left")
    cleared = {
        c: F.when(F.col("_reset"), F.lit(None)).otherwise(F.col(c))
        for c in ("raw_ocr_data", "verified_data", "confidence_score", "processing_time") if c in entries.columns
    }
    status = F.when(F.col("_reset"), "uploaded").otherwise(F.col("status"))
    return (joined.withColumns({**cleared, "status": status}).drop("_reset"),
            fields.join(reset, "entry_id", "left_anti"))


def check_retries(entries: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``reason`` to requests (entry_id, user_id); NULL = accepted.

    Reasons in the order of the checks: a missing entry, a foreign entry of an encoder, a status that is not waiting or
    being processed. A user who is not known has the rights of an encoder.
    """
    roles = users.select("user_id", "role")
    state = entries.select("entry_id", "uploaded_by", "status")
    reason = (
        F.when(F.col("status").isNull(), "entry not found")
        .when((F.lower(F.coalesce("role", F.lit("encoder"))) == "encoder") & ~F.col("uploaded_by").eqNullSafe(F.col("user_id")),
              "not the uploader")
        .when(~F.lower("status").isin(filters.RETRYABLE), F.concat(F.lit("cannot retry in status "), F.lower("status")))
    )
    return requests.join(state, "entry_id", "left").join(roles, "user_id", "left").withColumn("reason", reason).drop(
        "uploaded_by", "status", "role")


def retry_requests(entries: DataFrame, fields: DataFrame, requests: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Retries asked for by users: returns entries, fields and rejects (the refused requests with their reason)."""
    checked = check_retries(entries, requests, users)
    new_entries, new_fields = reset_for_retry(entries, fields, checked.filter("reason is null"))
    return {"entries": new_entries, "fields": new_fields, "rejects": checked.filter("reason is not null")}


def delete_entries(entries: DataFrame, fields: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove entries and, with them, their fields."""
    return entries.join(ids, "entry_id", "left_anti"), fields.join(ids, "entry_id", "left_anti")


def create_entries(uploads: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads of a known template become entries with status 'uploaded'; returns (entries, rejects)."""
    known = templates.select("template_id")
    created = uploads.join(known, "template_id", "left_semi").withColumn("status", F.lit("uploaded"))
    rejects = uploads.join(known, "template_id", "left_anti").withColumn("reason", F.lit("template not found"))
    return created, rejects


def replace_extraction(
    entries: DataFrame, old_fields: DataFrame, new_fields: DataFrame, line_counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fields of re-processed entries are swapped whole; those entries become 'extracted' with a new roll-up."""
    touched = new_fields.select("entry_id").distinct()
    fields = old_fields.join(touched, "entry_id", "left_anti").unionByName(new_fields, allowMissingColumns=True)
    rolled = reports.rollup_entry(entries.join(touched, "entry_id", "left_semi"), new_fields, line_counts).withColumn(
        "status", F.lit("extracted"))
    untouched = entries.join(touched, "entry_id", "left_anti")
    return untouched.unionByName(rolled, allowMissingColumns=True), fields


def classify_errors(errors: DataFrame) -> DataFrame:
    """Add category, reason and retry_safe; the first rule that fits decides."""
    kind, message, stage = F.col("error_type"), F.lower(F.coalesce("message", F.lit(""))), F.col("stage")

    def any_of(*pieces: str) -> Column:
        found = message.contains(pieces[0])
        for piece in pieces[1:]:
            found = found | message.contains(piece)
        return found

    def during(before: str, after: str = "") -> Column:
        return F.concat(F.lit(f"{before} during "), stage, F.lit(after))

    # Order, words and reasons of the rules.
    rules = [
        ((kind == "TimeoutError") | any_of("timeout"), "transient", during("Request timeout")),
        (kind.isin(CONNECTION_TYPES), "transient", during("Connection error")),
        (any_of("rate_limit", "429", "ratelimit"), "transient", during("API rate limited")),
        (any_of("temporarily unavailable", "service unavailable"), "transient", during("Service temporarily unavailable")),
        ((kind == "FileNotFoundError") | any_of("not found"), "permanent",
         during("Required resource not found", " (image/template missing)")),
        (kind.isin("ValueError", "KeyError"), "permanent",
         during("Invalid input/config", " (bad field schema or image format)")),
        (any_of("authentication", "unauthorized", "forbidden"), "permanent",
         during("Authentication failure", " (bad API key or perms)")),
        (any_of("invalid_request", "bad request"), "permanent", during("Invalid request", " (malformed API call)")),
        (any_of("json") & any_of("decode"), "partial",
         during("Failed to parse API response", " (some fields may have been extracted)")),
    ]
    category, reason = F.lit("unknown"), F.concat(F.lit("Unclassified error during "), stage, F.lit(": "), kind)
    for condition, name, why in reversed(rules):
        category = F.when(condition, name).otherwise(category)
        reason = F.when(condition, why).otherwise(reason)
    return errors.withColumns({"category": category, "reason": reason}).withColumn(
        "retry_safe", F.col("category").isin("transient", "unknown"))


def plan_retries(errors: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Add retry, delay_seconds and next_status to classified errors."""
    category = F.col("category")
    return errors.withColumns({
        "retry": F.col("retry_safe") & (F.col("attempt") < max_retries),
        "delay_seconds": F.when(category == "permanent", 0).when(category == "partial", PARTIAL_DELAY)
        .otherwise(F.lit(BASE_DELAY) * F.pow(F.lit(2.0), F.col("attempt"))).cast("bigint"),
        "next_status": F.when(category == "partial", "extracted").otherwise("uploaded"),
    })


def reuse_results(images: DataFrame, store: DataFrame, ttl_seconds: int = RESULT_TTL) -> tuple[DataFrame, DataFrame]:
    """Stored results for images of the same (template, md5) within ``ttl_seconds``; returns (hits, misses).

    A hit is the newest stored row that is not after the image. Time is cut into slices of one lifetime: such a row
    lies in the image's own slice, where one ordered scan finds it, or is the last one of the slice before. So an
    image with very many copies is scanned slice by slice, and images are never paired with all stored rows.
    """
    keys = ["template_id", "md5"]
    others = [c for c in store.columns if c not in [*keys, "stored_at"]]
    slice_of = lambda ts: F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(ttl_seconds * 1_000_000))
    row, result = F.struct(*images.columns), F.struct("stored_at", *others)
    timeline = images.select(*keys, F.col("created_at").alias("_at"), row.alias("_i"), F.lit(None).alias("_s")).unionByName(
        store.select(*keys, F.col("stored_at").alias("_at"), F.lit(None).alias("_i"), result.alias("_s"))
    ).withColumn("_slice", slice_of(F.col("_at")))
    so_far = Window.partitionBy(*keys, "_slice").orderBy("_at", F.col("_i").isNotNull(), "_s").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    asked = timeline.withColumn("_own", F.last("_s", ignorenulls=True).over(so_far)).filter("_i is not null")
    closing = store.groupBy(*keys, (slice_of(F.col("stored_at")) + 1).alias("_slice")).agg(
        F.max_by(result, result).alias("_before"))
    found = F.when(F.col("template_id").isNotNull() & F.col("md5").isNotNull(), F.coalesce("_own", "_before"))
    joined = asked.join(closing, [*keys, "_slice"], "left").select("_i", found.alias("_s"))
    end = F.col("_s.stored_at") + F.make_interval(secs=F.lit(ttl_seconds))
    joined = joined.withColumn("_fresh", F.coalesce(F.col("_i.created_at") < end, F.lit(False)))
    hits = joined.filter("_fresh").select("_i.*", "_s.stored_at", *[F.col(f"_s.{c}").alias(c) for c in others])
    return hits, joined.filter("not _fresh").select("_i.*")


def invalidate(store: DataFrame, template_id: int) -> DataFrame:
    """Drop the stored results of one template."""
    return store.filter(F.col("template_id") != template_id)


def duplicate_images(images: DataFrame) -> DataFrame:
    """Contents uploaded more than once for a template: number of copies and the first entry."""
    return images.groupBy("template_id", "md5").agg(
        F.count(F.lit(1)).alias("copies"), F.min("entry_id").alias("first_entry")).filter("copies > 1")


def duplicate_members(images: DataFrame) -> DataFrame:
    """Each image that has an earlier twin, with that twin: one row per copy, never a pair of copies."""
    first = duplicate_images(images).select("template_id", "md5", "first_entry")
    return images.join(first, ["template_id", "md5"]).filter("entry_id <> first_entry").select(
        "entry_id", "first_entry", "template_id", "md5")


def progress_changes(events: DataFrame) -> DataFrame:
    """Events whose (status, confidence) differs from the previous one of the form (batch form).

    The window is per form and minute; the last state of each earlier minute is carried over, so that a form
    with very many events is not one task.
    """
    day = F.date_trunc("minute", "ts")
    state = F.struct("status", "confidence_score")
    dated = events.withColumns({"_day": day, "_state": state}).repartition("form_id", "_day")
    closing = dated.groupBy("form_id", "_day").agg(
        F.max_by(F.struct("_state"), F.struct("ts", "event_id")).alias("_close"))
    carried = closing.withColumn(
        "_carry", F.lag("_close").over(Window.partitionBy("form_id").orderBy("_day"))).drop("_close")
    order = Window.partitionBy("form_id", "_day").orderBy("ts", "event_id")
    previous = F.coalesce(F.lag(F.struct("_state")).over(order), F.col("_carry"))
    joined = dated.join(carried, ["form_id", "_day"]).withColumn("_previous", previous)
    changed = F.col("_previous").isNull() | ~F.col("_previous._state").eqNullSafe(F.col("_state"))
    return joined.filter(changed).drop("_day", "_state", "_carry", "_previous")


def latest_status(events: DataFrame) -> DataFrame:
    """Last event per form."""
    return events.groupBy("form_id").agg(
        F.max_by(F.struct("status", "confidence_score", "message", "ts"), F.struct("ts", "event_id")).alias("e")
    ).select("form_id", "e.*")


def stuck_entries(events: DataFrame, as_of: str, minutes: int = 6) -> DataFrame:
    """Forms whose last event is 'processing' and older than the processing limit."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(minutes))
    return latest_status(events).filter((F.col("status") == "processing") & (F.col("ts") < limit))
