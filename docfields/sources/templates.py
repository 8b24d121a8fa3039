"""Form templates: JSON schema to one row per field, section flattening, upsert by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.schemas import SECTIONS_JSON, TEMPLATE_JSON

# The extraction strategies a template may name.
STRATEGIES = ["label_nearby", "line_match", "checkbox_mark"]


def _bound_ok(value: Column) -> Column:
    return value.isNull() | value.between(0.0, 1.0)


def explode_template_fields(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``templates.field_schema`` into (fields, rejects).

    A template is rejected as a whole when its JSON is unreadable, has no field, or holds a field
    without a name, with an unknown strategy or with a region bound outside [0, 1].
    """
    parsed = templates.withColumn("_fields", F.from_json("field_schema", TEMPLATE_JSON)["fields"])
    region = lambda f: f["extraction"]["search_region"]
    bad_field = F.exists(
        "_fields",
        lambda f: f["name"].isNull()
        | ~F.coalesce(f["extraction"]["strategy"], F.lit(STRATEGIES[0])).isin(STRATEGIES)
        | ~(_bound_ok(region(f)["x_min"]) & _bound_ok(region(f)["y_min"])
            & _bound_ok(region(f)["x_max"]) & _bound_ok(region(f)["y_max"])),
    )
    reason = (
        F.when(F.col("_fields").isNull(), F.lit("unreadable schema"))
        .when(F.size("_fields") == 0, F.lit("no fields"))
        .when(F.coalesce(bad_field, F.lit(False)), F.lit("invalid field"))
    )
    checked = parsed.withColumn("reason", reason)
    rejects = checked.filter("reason is not null").select("template_id", "name", "reason")
    fields = (
        checked.filter("reason is null")
        .select("template_id", F.posexplode("_fields").alias("field_pos", "f"))
        .select(
            "template_id",
            "field_pos",
            F.col("f.name").alias("name"),
            F.coalesce("f.label", F.initcap(F.replace("f.name", F.lit("_"), F.lit(" ")))).alias("label"),
            F.coalesce("f.type", F.lit("text")).alias("type"),
            F.coalesce("f.required", F.lit(False)).alias("required"),
            F.coalesce("f.options", F.array().cast("array<string>")).alias("options"),
            F.col("f.hint").alias("hint"),
            F.col("f.section").alias("section"),
            F.col("f.number").alias("number"),
            F.coalesce("f.extraction.strategy", F.lit(STRATEGIES[0])).alias("strategy"),
            F.coalesce("f.extraction.anchor_labels", F.array().cast("array<string>")).alias("anchor_labels"),
            F.struct(
                F.coalesce("f.extraction.search_region.x_min", F.lit(0.0)).alias("x_min"),
                F.coalesce("f.extraction.search_region.y_min", F.lit(0.0)).alias("y_min"),
                F.coalesce("f.extraction.search_region.x_max", F.lit(1.0)).alias("x_max"),
                F.coalesce("f.extraction.search_region.y_max", F.lit(1.0)).alias("y_max"),
            ).alias("region"),
            F.col("f.extraction.ai_prompt_hint").alias("ai_prompt_hint"),
            F.col("f.extraction.value_postprocess").alias("value_postprocess"),
        )
    )
    return fields, rejects


def flatten_sections(templates: DataFrame) -> DataFrame:
    """``sections[].fields[]`` of each schema as rows in reading order, numbered from 0 per template."""
    parsed = templates.withColumn("_sections", F.from_json("field_schema", SECTIONS_JSON)["sections"])
    flat = F.flatten(F.transform(
        "_sections",
        lambda s: F.transform(
            F.coalesce(s["fields"], F.array()),
            lambda f: F.struct(
                f["name"].alias("name"), f["label"].alias("label"), f["type"].alias("type"),
                s["title"].alias("section"),
            ),
        ),
    ))
    return (
        parsed.select("template_id", F.posexplode(flat).alias("field_pos", "f"))
        .select("template_id", "field_pos", "f.name", "f.label", "f.type", "f.section")
    )


def needs_image(template_fields: DataFrame) -> DataFrame:
    """Per template: does it hold a checkbox, checkbox group or radio field?"""
    marked = F.lower(F.col("type")).isin("checkbox", "checkbox-group", "radio")
    return template_fields.groupBy("template_id").agg(F.bool_or(marked).alias("needs_image"))


def seed_upsert_templates(new: DataFrame, current: DataFrame) -> DataFrame:
    """Insert templates by unique name; for a known name replace schema and description only."""
    n, c = new.alias("n"), current.alias("c")
    kept = [col for col in current.columns if col not in ("name", "field_schema", "description")]
    return n.join(c, F.col("n.name") == F.col("c.name"), "full_outer").select(
        F.coalesce("c.name", "n.name").alias("name"),
        F.coalesce("n.field_schema", "c.field_schema").alias("field_schema"),
        F.coalesce("n.description", "c.description").alias("description"),
        *[F.when(F.col("c.name").isNotNull(), F.col(f"c.{col}")).otherwise(F.col(f"n.{col}")).alias(col)
          for col in kept],
        F.when(F.col("c.name").isNull(), F.lit("inserted"))
        .when(F.col("n.name").isNull(), F.lit("kept"))
        .otherwise(F.lit("updated")).alias("change"),
    )


