"""Field values found by pattern in the whole text of an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import text
from docfields.operators.standardize import schema

# Basic patterns, tried in order.
BASIC_DATE = [
    r"(?i)(\d{1,2})[/-](\d{1,2})[/-](\d{4})",
    r"(?i)(\d{4})[/-](\d{1,2})[/-](\d{1,2})",
    r"(?iU)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+(\d{1,2}),?\s+(\d{4})",
]
BASIC_PHONE = [
    r"(\+63|63)?9[0-2]\d[\s-]?\d{3}[\s-]?\d{4}",
    r"(\+63|63)?9[0-2]\d{8}",
    r"0(9[0-2]\d{8})",
]
BASIC_YES = r"(?iU)✓|✔|\byes\b|\bchecked\b|\b[Xx][\s•·*]"
BASIC_NO = r"(?imU)☐|☒|\bno\b\s|\bno\b$|\bunchecked\b"
BASIC_AMOUNT = [
    r"[₱P$€£¥]\s*(\d+(?:,\d{3})*(?:\.\d{1,2})?)",
    r"(\d+(?:,\d{3})*(?:\.\d{1,2})?)",
]
BASIC_CONFIDENCE = {"date": 0.50, "phone": 0.55, "checkbox": 0.45, "amount": 0.40}

# Patterns of the validated search, tried in order.
_MONTH = ("January|February|March|April|May|June|July|August|September|October|November|December|"
          "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec")
VALIDATED = {
    "date": [
        r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b",
        r"\b(19|20)\d{2}[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])\b",
        rf"\b({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})\b",
    ],
    "phone": [
        r"\+?63\d{2}\s*[-.\s]?\d{3,4}\s*[-.\s]?\d{3,4}",
        r"\b09\d{2}\s*[-.\s]?\d{3,4}\s*[-.\s]?\d{3,4}\b",
        r"\b[9]\d{9}\b",
    ],
    "amount": [
        r"₱?\s*(\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?)",
        r"P\s*(\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?)",
        r"\$\s*(\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?)",
    ],
    "checkbox": [r"[✓✔☑☒✅]\s*(?=\s|$)", r"\byes\b|\bno\b|\btrue\b|\bfalse\b"],
}
BASE_CONFIDENCE, MIN_CONFIDENCE = 0.5, 0.45


def _first(value: Column, patterns: list[str], group: int = 0) -> Column:
    return F.coalesce(*[text.capture(value, p, group) for p in patterns])


def basic_values(texts: DataFrame) -> DataFrame:
    """Per entry one date, phone, check mark and amount: the first match of the first pattern that hits.

    The whole text is searched, once per entry and not once per field.
    """
    value = F.col("full_text")
    phone = F.regexp_replace(F.col("_phone"), r"[^0-9+]", "")
    international = (
        F.when(phone.startswith("+63"), phone)
        .when(phone.startswith("63"), F.concat(F.lit("+"), phone))
        .when(phone.startswith("9"), F.concat(F.lit("+63"), phone))
        .otherwise(F.concat(F.lit("+639"), F.right(phone, F.lit(10))))
    )
    return (
        texts.withColumns({
            "_phone": _first(value, BASIC_PHONE),
            "_amount": _first(value, BASIC_AMOUNT, 1),
        })
        .select(
            "entry_id",
            _first(value, BASIC_DATE).alias("date"),
            F.when(F.col("_phone").isNotNull(), international).alias("phone"),
            F.when(value.rlike(BASIC_YES), "Yes").when(value.rlike(BASIC_NO), "No").alias("checkbox"),
            text.money(F.translate("_amount", ",", "").try_cast("double")).alias("amount"),
        )
    )


def _fill(wanted: DataFrame, found: DataFrame, confidences: dict[str, float]) -> DataFrame:
    """Give each empty wanted field the entry's value of its type."""
    kind = F.col("type")
    value, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, conf in confidences.items():
        value = F.when(kind == name, F.col(name)).otherwise(value)
        confidence = F.when(kind == name, F.lit(conf)).otherwise(confidence)
    empty = wanted.filter(text.is_blank(F.col("ocr_value")) & kind.isin(list(confidences)))
    return (
        empty.join(found, "entry_id")
        .select("entry_id", "field_name", value.alias("ocr_value"), confidence.alias("confidence"))
        .filter("ocr_value is not null")
    )


def extract_patterns_basic(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fill empty fields from the entry's text.

    ``texts`` is (entry_id, full_text); ``wanted`` is (entry_id, field_name, type, ocr_value) with the
    fields of the schema, NULL value where nothing was extracted.
    """
    return _fill(wanted, basic_values(texts), BASIC_CONFIDENCE)


def validated_values(texts: DataFrame) -> DataFrame:
    """Per entry the first date, phone, amount and check mark, normalised by the ``schema`` rules.

    Only the first match of a type is tried; an invalid one leaves NULL.
    """
    found = texts.select("entry_id", *[
        _first(F.col("full_text"), [f"(?imU){p}" for p in patterns]).alias(f"_{kind}")
        for kind, patterns in VALIDATED.items()
    ])
    staged = schema.parse_dates(found, "_date", "date", "dmy")
    staged = schema.parse_amounts(schema.parse_phones(staged, "_phone", "phone"), "_amount", "amount")
    checkbox = F.nullif(schema.checkbox_value(F.col("_checkbox")), F.lit(""))
    return staged.select("entry_id", "date", "phone", "amount", checkbox.alias("checkbox"))


def extract_patterns_validated(
    texts: DataFrame, wanted: DataFrame, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """As ``extract_patterns_basic`` with validated values; rows carry ``pattern_extracted``."""
    gains = {"date": schema.VALID, "phone": schema.NORMALIZED, "amount": schema.CORRECTED,
             "checkbox": schema.NORMALIZED}
    confidences = {kind: round(min(1.0, max(0.0, BASE_CONFIDENCE + gain)), 9) for kind, gain in gains.items()}
    found = _fill(wanted, validated_values(texts), confidences)
    return found.filter(F.col("confidence") >= min_confidence).withColumn("pattern_extracted", F.lit(True))
