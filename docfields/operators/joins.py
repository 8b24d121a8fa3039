"""The relational joins between entries, fields, templates, users and verifications.

No join is hinted: statistics and AQE choose broadcast for a small side at run time and sort-merge
(with skew splitting) beyond the threshold, so nothing grows past what was checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.operators.filters import visible_to


SALTS = 1024


def fields_with_entries(fields: DataFrame, entries: DataFrame, *columns: str) -> DataFrame:
    """Inner join on the entry; ``columns`` are the entry columns to add."""
    return fields.join(entries.select("entry_id", *columns), "entry_id")


def entries_with_templates(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """Inner join that adds the template's name."""
    names = templates.select("template_id", F.col("name").alias("template_name"))
    return entries.join(names, "template_id")


def entries_with_template_names(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """Left join; an entry of an unknown template is named 'Unknown'."""
    names = templates.select("template_id", F.col("name").alias("_name"))
    return entries.join(names, "template_id", "left").withColumn(
        "template_name", F.coalesce("_name", F.lit("Unknown"))).drop("_name")


def nest_fields(fields: DataFrame, *columns: str) -> DataFrame:
    """One row per entry with its fields as an array of structs ordered by name.

    An entry has as many fields as its template declares, so the array is bounded by the schema.
    """
    items = F.array_sort(F.collect_list(F.struct("field_name", *columns)))
    return fields.groupBy("entry_id").agg(items.alias("fields"))


def entries_with_fields(entries: DataFrame, fields: DataFrame, *columns: str) -> DataFrame:
    """Left join of entries with their nested fields; an entry without fields gets an empty array."""
    nested = nest_fields(fields, *columns)
    empty = F.array().cast(nested.schema["fields"].dataType)
    return entries.join(nested, "entry_id", "left").withColumn("fields", F.coalesce("fields", empty))


def entries_with_users(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Uploader and verifier of each entry: one user table in two roles.

    Most entries have no verifier yet. A salt in the key deals these out, else all would meet in one task.
    """
    uploader = users.select(F.col("user_id").alias("uploaded_by"), F.col("full_name").alias("uploader_name"))
    verifier = users.select(F.col("user_id").alias("verified_by"), F.col("full_name").alias("verifier_name"))
    salt = F.when(F.col("verified_by").isNull(), F.pmod(F.xxhash64("entry_id"), F.lit(SALTS))).otherwise(0)
    salted = entries.join(uploader, "uploaded_by", "left").withColumn("_salt", salt)
    return salted.join(verifier.withColumn("_salt", F.lit(0).cast("bigint")), ["verified_by", "_salt"], "left").drop("_salt")


def fields_with_verified_values(fields: DataFrame, verifications: DataFrame) -> DataFrame:
    """Left join of fields with the exploded verification map on (entry, field name).

    Of several submissions for a field the last one (by ``ts``, if there is one) counts, then the largest value.
    """
    stamp = ["ts"] if "ts" in verifications.columns else []
    submitted = verifications.select("entry_id", *stamp, F.explode("verified_fields").alias("field_name", "new_value"))
    new_values = submitted.groupBy("entry_id", "field_name").agg(
        F.max_by("new_value", F.struct(*stamp, "new_value")).alias("new_value"))
    return fields.join(new_values, ["entry_id", "field_name"], "left")


def with_field_schema(fields: DataFrame, template_fields: DataFrame, *columns: str) -> DataFrame:
    """Left join on (template, name): fields the template does not know pass with NULLs."""
    schema = template_fields.select("template_id", F.col("name").alias("field_name"), *columns)
    return fields.join(schema, ["template_id", "field_name"], "left")


def unresolved_fields(expected: DataFrame, resolved: DataFrame) -> DataFrame:
    """Expected (entry, field) pairs without a resolved row."""
    return expected.join(resolved.select("entry_id", "field_name"), ["entry_id", "field_name"], "left_anti")


def requested_fields(template_fields: DataFrame, names: DataFrame | None) -> DataFrame:
    """Schema rows whose name is asked for; no list means all of them."""
    return template_fields if names is None else template_fields.join(names, "name", "left_semi")


def entry_detail(
    entries: DataFrame, fields: DataFrame, ids: DataFrame, user_id: int, role: str, *columns: str
) -> DataFrame:
    """Entries of an id list with nested fields, as far as the user may see them."""
    wanted = visible_to(entries, user_id, role).join(ids, "entry_id", "left_semi")
    return entries_with_fields(wanted, fields.join(ids, "entry_id", "left_semi"), *columns)


def uploads_with_creations(
    uploads: DataFrame, creations: DataFrame, minutes: int = 15, upload_ts: str = "uploaded_at",
    created_ts: str = "created_at",
) -> DataFrame:
    """Upload metadata joined with the entry creation that follows within ``minutes``."""
    created: Column = F.col(created_ts)
    window = (created >= F.col(upload_ts)) & (
        created <= F.col(upload_ts) + F.make_interval(mins=F.lit(minutes)))
    return uploads.join(creations, "form_entry_id").filter(window)
