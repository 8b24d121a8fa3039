"""Profile ``model``: values returned by an extraction model, by canonical name or declared type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions import text

# Canonical fields with a special treatment.
CHECKBOX_FIELDS = [
    "is_new_registration", "is_renewal", "with_tin", "without_tin", "barangay_registration",
    "city_municipality_registration", "regional_registration", "national_registration",
    "owner_same_as_business", "philhealth_registration", "sss_registration", "pagibig_registration",
]
NUMERIC_FIELDS = ["asset_value", "capitalization", "male_employees", "female_employees", "total_employees"]
TRUE_WORDS = ["true", "checked", "✓", "x", "yes", "1"]
SELECTED_WORDS = ["yes", "true", "checked", "1", "x", "✓", "✔", "on", "selected", "filled"]
DEFAULT_CONFIDENCE, FILLED_CONFIDENCE = 0.85, 0.92


def adapt_model_fields(fields: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Canonical name (identity unless ``names`` says otherwise) and a normalised value per field."""
    name = F.col("field_name")
    if names:
        renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        name = F.coalesce(F.element_at(renamed, name), name)
    value = text.strip(F.col("value_in"))
    adapted = (
        F.when(F.coalesce("value_in", F.lit("")) == "", "")
        .when(F.col("field_name").isin(CHECKBOX_FIELDS),
              F.when(F.lower(value).isin(TRUE_WORDS), "true").otherwise("false"))
        .when(F.col("field_name").isin(NUMERIC_FIELDS), F.regexp_replace(value, r"[^0-9.,]", ""))
        .otherwise(value)
    )
    return fields.withColumn("field_name", name).withColumns({
        "value_out": adapted,
        "conf_out": F.coalesce("conf_in", F.lit(DEFAULT_CONFIDENCE)),
        "source": F.lit("model"),
        "was_corrected": F.lit(False),
        "unresolved": F.lit(False),
    })


def normalise_by_type(fields: DataFrame) -> DataFrame:
    """Value in the form the declared ``type`` (with ``options``) expects; 0.92 confidence when filled."""
    value = text.strip(F.coalesce("value_in", F.lit("")))
    low = F.lower(value)
    joined = F.regexp_replace(low, "[-/ ]", "_")
    words = F.split(F.regexp_replace(low, "[_/]", " "), r"\s+")

    def option_words(option):
        return F.filter(F.split(F.replace(F.lower(option), F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")

    options = F.col("options")
    choice = F.coalesce(
        F.get(F.filter(options, lambda o: F.lower(o) == low), 0),
        F.get(F.filter(options, lambda o: F.lower(o) == joined), 0),
        F.get(F.filter(options, lambda o: (F.size(option_words(o)) > 0)
                       & (F.size(F.array_except(option_words(o), words)) == 0)), 0),
        F.lit(""),
    )
    kind = F.coalesce("type", F.lit("text"))
    shown = (
        F.when(kind == "checkbox", F.when(low.isin(SELECTED_WORDS), "true").otherwise(""))
        .when((kind == "radio") & (F.coalesce(F.size("options"), F.lit(0)) > 0), choice)
        .when(kind == "number", text.digits(value))
        .otherwise(value)
    )
    return fields.withColumn("value_out", shown).withColumn(
        "conf_out", F.when(F.col("value_out") != "", FILLED_CONFIDENCE).otherwise(0.0))
