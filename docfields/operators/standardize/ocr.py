"""Profile ``ocr``: corrections of typical misreadings by field type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import text
from docfields.operators.standardize.results import emit

# Field types, letters misread for digits.
TYPES = ["name", "address", "amount", "date", "phone", "id_number", "checkbox"]
MISREAD = {"O": "0", "I": "1", "l": "1", "S": "5", "Z": "2", "B": "8"}

# Texts with one of these pieces keep their letters.
SAFE_PIECES = ["bgc", "no"]

# A name holding one of these words keeps its letters.
COMMON_WORDS = [
    "smith", "john", "james", "robert", "michael", "william", "david", "richard", "joseph", "thomas",
    "charles", "christopher", "daniel", "matthew", "other", "time", "some", "side", "is", "as", "so", "no",
    "do", "be", "see", "use", "very", "only", "also", "just", "over", "such", "these", "those", "his", "her",
    "yes", "boss", "lose", "case", "base", "rose", "dose",
]

# Place names in the order of correction. "cavit" also fires inside "Cavite" (giving
# "Cavitee"), and a right spelling counts as a correction; both are kept as documented behaviour.
PLACES = {
    "qurzon": "Quezon", "quorzon": "Quezon", "quezón": "Quezon", "qezon": "Quezon", "cavitee": "Cavite",
    "cavit": "Cavite", "laguna": "Laguna", "makati": "Makati", "bgc": "BGC",
}

# Abbreviations in the order of replacement.
ABBREVIATIONS = {
    r"\bst\.?\b": "Street", r"\bave\.?\b": "Avenue", r"\bav\.?\b": "Avenue", r"\bblvd\.?\b": "Boulevard",
    r"\bno\.?\b": "No.",
}
CURRENCY = "$€£¥₱¢"

# Words and marks of a checked and of an empty box; all else counts as checked.
YES_WORDS = ["yes", "y", "yeah", "true", "1", "✓", "☑", "checked", "ok", "yes."]
NO_WORDS = ["no", "n", "nope", "false", "0", "✗", "☐", "unchecked", "x"]

SUBSTITUTED, LOCATION, ABBREVIATED, TITLED = 0.05, 0.08, 0.03, 0.05
PHONE_OK, AMOUNT_OK, DATE_OK, ID_OK, ID_BAD, BAD = 0.10, 0.08, 0.10, 0.05, -0.05, -0.20


def _count(value: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(value.rlike(p), 1).otherwise(0) for p in patterns])


def _replace(value: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda acc, item: F.regexp_replace(acc, *item), pairs.items(), value)


_PLACES = {f"(?iu){wrong}": right for wrong, right in PLACES.items()}
_SHORT = {f"(?iU){pattern}": word for pattern, word in ABBREVIATIONS.items()}
_DATE = r"^\s*\+?([0-9]+)\s*([/.-])\s*\+?([0-9]+)\s*\2\s*\+?([0-9]+)\s*$"
_YEARS = r"^([0-9]{2}/[0-9]{2}/(?:19[5-9][0-9]|20[0-2][0-9]|2030))$"
_AMOUNT = r"^(-?[0-9]+)(?:\.([0-9]+))?$"


def _phone(number: Column) -> Column:
    local = (
        F.when(number.startswith("63"), F.when(F.length(number) == 12, F.substr(number, F.lit(3))))
        .when(number.rlike("^0[0-9]{10}$"), F.substr(number, F.lit(2)))
        .when(F.length(number) == 10, number)
    )
    return F.concat(F.lit("+63"), local)


def _amount(bare: Column) -> Column:
    cents = F.substring(F.rpad(F.regexp_extract(bare, _AMOUNT, 2), 2, "0"), 1, 2)
    cents = F.when(F.length(F.regexp_extract(bare, _AMOUNT, 2)) > 2,
                   F.substring(F.regexp_extract(bare, _AMOUNT, 2), 1, 2)).otherwise(cents)
    return F.when(bare.rlike(_AMOUNT), F.concat(F.regexp_extract(bare, _AMOUNT, 1), F.lit("."), cents))


def _date(value: Column) -> Column:
    day, month, year = (F.regexp_extract(value, _DATE, g).try_cast("int") for g in (1, 3, 4))
    shown = F.date_format(F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d"), "dd/MM/yyyy")
    return F.nullif(F.regexp_extract(shown, _YEARS, 1), F.lit(""))


def standardize_ocr(fields: DataFrame, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Correct ``value_in`` by ``type``; returns (fields, rejects).

    Rejected are NULL texts, those longer than ``max_length`` (if it is given), unknown types and confidences
    outside [0, 1].
    """
    reason = (
        F.when(F.col("value_in").isNull(), "no text")
        .when(F.length("value_in") > F.lit(max_length), "text too long")
        .when(~F.coalesce(F.col("type"), F.lit("")).isin(TYPES), "unknown type")
        .when(~F.coalesce(F.col("conf_in").between(0.0, 1.0), F.lit(False)), "confidence out of range")
    )
    checked = fields.withColumn("reason", reason)
    rejects = checked.filter("reason is not null")
    kind, value, fixed = F.col("type"), F.col("_text"), F.col("_fixed")
    is_address = kind == "address"
    common = F.arrays_overlap(F.split(F.lower(value), " "), F.array(*[F.lit(w) for w in COMMON_WORDS]))
    hit = (
        value.rlike(f"[{''.join(MISREAD)}]") & ~F.lower(value).rlike("|".join(SAFE_PIECES))
        & ~((kind == "name") & common)
    )
    id_number = F.upper(F.regexp_replace(fixed, r"[^\p{L}\p{N}]", ""))
    staged = (
        checked.filter("reason is null").drop("reason")
        .withColumn("_text", text.collapse(F.col("value_in")))
        # No place correction creates or removes a match of another one, so they are counted on the input.
        .withColumns({"_hit": hit, "_places": F.when(is_address, _count(value, list(_PLACES)))})
        .withColumn("_fixed", F.when(F.col("_hit"), text.replace_each(value, MISREAD)).otherwise(value))
        .withColumns({
            "_placed": F.when(F.col("_places") > 0, _replace(value, _PLACES)).otherwise(fixed),
            "_digits": F.when(kind == "phone", text.digits(fixed)),
            "_bare": F.when(kind == "amount", F.trim(F.translate(fixed, CURRENCY + ",", ""))),
        })
        # The standard form, NULL where the text is no phone, amount, date or number.
        .withColumn("_standard", F.when(kind == "phone", _phone(F.col("_digits")))
                    .when(kind == "amount", _amount(F.col("_bare")))
                    .when(kind == "date", _date(fixed))
                    .when(kind == "id_number", F.nullif(F.regexp_extract(id_number, "^(.{8,12})$", 1), F.lit(""))))
    )
    word = F.lower(value)
    shown = (
        F.when(value == "", "")
        .when(kind == "name", F.initcap(fixed))
        .when(is_address, _replace(F.col("_placed"), _SHORT))
        .when(kind == "checkbox", F.when(word.isin(NO_WORDS), "No").otherwise("Yes"))
        .otherwise(F.coalesce("_standard", "_fixed"))
    )
    substituted = F.when(F.col("_hit"), SUBSTITUTED).otherwise(0.0)
    valid = F.col("_standard").isNotNull()
    delta = (
        F.when(value == "", 0.0)
        .when(kind == "name", substituted + F.when(F.col("value_out") != fixed, TITLED).otherwise(0.0))
        .when(is_address, F.col("_places") * F.lit(LOCATION) + F.when(F.col("_places") == 0, substituted).otherwise(0.0)
              + _count(F.col("_placed"), list(_SHORT)) * F.lit(ABBREVIATED))
        .when(kind == "phone", F.when(valid, substituted + PHONE_OK).otherwise(BAD))
        .when(kind == "amount", F.when(valid, substituted + AMOUNT_OK).otherwise(BAD))
        .when(kind == "date", F.when(valid, substituted + DATE_OK).otherwise(BAD))
        .when(kind == "id_number", substituted + F.when(valid, ID_OK).otherwise(ID_BAD))
        .when(word.isin(YES_WORDS + NO_WORDS), 0.05)
        .otherwise(0.0)
    )
    done = staged.withColumn("value_out", shown).withColumn("conf_delta", F.round(delta, 9))
    return emit(done).withColumn("rule", kind).drop(
        "_text", "_hit", "_places", "_fixed", "_placed", "_digits", "_bare", "_standard"), rejects
