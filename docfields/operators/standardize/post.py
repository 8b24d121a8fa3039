"""Profile ``post``: clean-up by field name after extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import text

# Letters misread for digits.
MISREAD = {"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "s": "5", "B": "8", "G": "6"}

# Correction by field name.
FIELD_TYPES = {
    "name": ["first_name", "middle_name", "last_name", "suffix"],
    "year": ["birth_year"],
    "month": ["birth_month"],
    "day": ["birth_day"],
    "phone": ["biz_phone", "biz_mobile", "owner_phone", "owner_mobile"],
    "tin": ["owners_tin"],
    "address": [
        "biz_house_building", "biz_street", "biz_barangay", "biz_city_municipality", "biz_province",
        "biz_region", "owner_house_building", "owner_street", "owner_barangay", "owner_city_municipality",
        "owner_province", "owner_region",
    ],
    "currency": ["asset", "capitalization", "gross_sale_receipt"],
    "integer": ["employees_male", "employees_female", "employees_total"],
    "email": ["owner_email"],
}

# Address abbreviations in the order of replacement.
ABBREVIATIONS = {
    r"\bbrgy\.?(?!\w)": "Brgy.", r"\bbarangay(?!\w)": "Barangay", r"\bmun\.?(?!\w)": "Mun.",
    r"\bprov\.?(?!\w)": "Prov.", r"\bst\.?(?!\w)": "St.", r"\bave\.?(?!\w)": "Ave.", r"\bblvd\.?(?!\w)": "Blvd.",
}
BOOST, CEILING, DEFAULT_CONFIDENCE = 0.02, 0.98, 0.9


def field_type(name: Column) -> Column:
    branches = [(name.isin(names), F.lit(kind)) for kind, names in FIELD_TYPES.items()]
    return text.first_of(branches, F.lit("text"))


def _clean(value: Column) -> Column:
    return F.regexp_replace(text.collapse(value), r"\s+([.,;:])", "$1")


def _name(value: Column) -> Column:
    """Title-case words made of letters only (two or more)."""
    words = F.transform(F.split(value, " "),
                        lambda w: F.when(w.rlike(r"^\p{L}{2,}$"), F.initcap(w)).otherwise(w))
    return F.array_join(words, " ")


def _clamped(digits: Column, low: int, high: int) -> Column:
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 9, high).otherwise(digits.try_cast("int"))
    return F.lpad(F.greatest(F.lit(low), F.least(F.lit(high), number)).cast("string"), 2, "0")


def standardize_post(fields: DataFrame) -> DataFrame:
    """Clean ``value_in`` by ``field_name``; a changed value gains 0.02 confidence up to 0.98."""
    raw = F.col("value_in")
    value, digits = F.col("_clean"), F.col("_digits")
    fixed = text.replace_each(value, MISREAD)
    tin = F.concat_ws("-", *[F.substring(digits, start, 3) for start in (1, 4, 7)])
    corrected = (
        F.when(text.is_blank(raw), raw)
        .when(F.col("rule") == "name", _name(value))
        .when((F.col("rule") == "year") & (F.length(digits) == 4), digits)
        .when((F.col("rule") == "year") & (F.length(digits) == 2),
              F.concat(F.when(digits < "50", "20").otherwise("19"), digits))
        .when((F.col("rule") == "month") & (digits != ""), _clamped(digits, 1, 12))
        .when((F.col("rule") == "day") & (digits != ""), _clamped(digits, 1, 31))
        .when(F.col("rule") == "phone", text.strip(F.regexp_replace(fixed, r"[^0-9+\-()\s]", "")))
        .when((F.col("rule") == "tin") & (F.length(digits) == 12),
              F.concat_ws("-", tin, F.substring(digits, 10, 3)))
        .when((F.col("rule") == "tin") & (F.length(digits) == 9), tin)
        .when(F.col("rule") == "address",
              reduce(lambda acc, item: F.regexp_replace(acc, f"(?iU){item[0]}", item[1]),
                     ABBREVIATIONS.items(), value))
        .when(F.col("rule") == "currency", F.regexp_replace(fixed, r"[^0-9,.]", ""))
        .when((F.col("rule") == "integer") & (digits != ""), digits)
        .otherwise(value)
    )
    staged = (
        fields.withColumns({"rule": field_type(F.col("field_name")), "_clean": _clean(raw)})
        .withColumn("_digits", text.digits(fixed))
        .withColumn("value_out", corrected)
        .withColumn("changed", (F.coalesce(raw, F.lit("")) != "") & ~F.col("value_out").eqNullSafe(raw))
    )
    boosted = F.least(F.round(F.coalesce("conf_in", F.lit(DEFAULT_CONFIDENCE)) + BOOST, 9), F.lit(CEILING))
    conf_out = F.when(F.col("changed"), boosted).otherwise(F.col("conf_in"))
    return staged.withColumn("conf_out", conf_out).withColumn(
        "conf_delta", F.round(F.col("conf_out") - F.col("conf_in"), 9)).drop("_clean", "_digits")
