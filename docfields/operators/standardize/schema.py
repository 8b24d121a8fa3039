"""Profile ``schema``: dates, phones, check marks, amounts and required fields by declared type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import text
from docfields.operators.standardize.results import emit

# Confidence changes, year range.
VALID, CORRECTED, NORMALIZED, EMPTY = 0.10, 0.08, 0.05, 0.0
AMBIGUOUS, INVALID, REQUIRED_MISSING, INVALID_AUTO = -0.05, -0.20, -0.25, -0.25
MIN_YEAR, MAX_YEAR = 1950, 2030

# Month names in the order in which they are looked for.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}

# Words and marks of a checked and of an empty box.
YES_WORDS = ["yes", "y", "true", "1", "✓", "✔", "checked", "x"]
NO_WORDS = ["no", "n", "false", "0", "☐", "unchecked", "empty"]

# Currency signs; P counts only before a digit or a blank.
CURRENCY = "₱$€£¥"

_ISO = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"
_NUMERIC = r"^([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})$"
_YEARS = r"^([0-9]{2}/[0-9]{2}/(?:19[5-9][0-9]|20[0-2][0-9]|2030))$"
# Any month name at all; guards the search for the first one in list order.
_ANY_MONTH = "(?i)" + "|".join(name for name in MONTHS if len(name) == 3)


def _int(value: Column, pattern: Column | str, group: int) -> Column:
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.call_function("regexp_extract", value, pattern, F.lit(group)).try_cast("int")


def _limited(value: Column, only: Column | None) -> Column:
    """NULL on the rows a rule is not meant for, so that its later steps cost nothing there."""
    return value if only is None else F.when(only, value)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day)


def _month_number(name: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.element_at(numbers, name)


def parse_dates(
    df: DataFrame, source: str, target: str, date_order: str = "dmy", only: Column | None = None
) -> DataFrame:
    """Add ``target``: the date in ``source`` as DD/MM/YYYY, NULL where there is none.

    ``dmy`` reads 03/04/2020 as 3 April and looks for a spelled month anywhere in the text;
    ``auto_mdy`` reads it as March 4 unless impossible and wants a spelled date to be the whole text.
    ``only`` limits the work to some rows.
    """
    staged = df.withColumn("_d", _limited(text.strip(F.col(source)), only))
    value = F.col("_d")
    first, second, year = (_int(value, _NUMERIC, g) for g in (1, 2, 3))
    iso = _ymd(*[_int(value, _ISO, g) for g in (1, 2, 3)])
    if date_order == "dmy":
        before, after = r"(?i)(?:([0-9]{1,2})\s+)?", r"(?:\s+([0-9]{1,2}),?)?\s+([0-9]{4})"
        numeric = _ymd(year, second, first)
        name = text.first_of([(value.rlike(before + m + after), F.lit(m)) for m in MONTHS], F.lit(None).cast("string"))
        day = F.coalesce(_int(value, F.col("_p"), 1), _int(value, F.col("_p"), 2))
        pattern = F.concat(F.lit(before), F.col("_m"), F.lit(after))
    elif date_order == "auto_mdy":
        numeric = F.when(first > 12, _ymd(year, second, first)).otherwise(_ymd(year, first, second))
        names = "|".join(MONTHS)
        whole = rf"(?i)^(?:([0-9]{{1,2}})\s+)?({names})(?:\s+([0-9]{{1,2}}))?[,\s]+([0-9]{{4}})$"
        name = F.lower(F.regexp_extract(value, whole, 2))
        # Exactly one of the two day positions must be filled.
        before_day, after_day = _int(value, F.col("_p"), 1), _int(value, F.col("_p"), 3)
        day = F.when(before_day.isNull() | after_day.isNull(), F.coalesce(before_day, after_day))
        pattern = F.lit(whole)
    else:
        raise ValueError("date_order must be 'dmy' or 'auto_mdy'")
    year_group = 3 if date_order == "dmy" else 4
    staged = staged.withColumn("_m", F.when(value.rlike(_ANY_MONTH), name)).withColumn("_p", pattern)
    parts = (
        F.when(value.rlike(_ISO), iso)
        .when(value.rlike(_NUMERIC), numeric)
        .when(F.col("_m") != "", _ymd(_int(value, F.col("_p"), year_group), _month_number(F.col("_m")), day))
    )
    # The parser accepts calendar days only; the pattern keeps the years in range.
    shown = F.date_format(F.try_to_date(parts, "yyyy-M-d"), "dd/MM/yyyy")
    return staged.withColumn(target, F.nullif(F.regexp_extract(shown, _YEARS, 1), F.lit(""))).drop("_d", "_m", "_p")


def parse_phones(df: DataFrame, source: str, target: str, only: Column | None = None) -> DataFrame:
    """Add ``target``: a Philippine mobile number as +639XXXXXXXXX, NULL where there is none."""
    kept = F.col("_k")
    number = (
        F.when(kept.startswith("+63"), F.substr(kept, F.lit(2)))
        .when(kept.startswith("63"), kept)
        .when(kept.startswith("09"), F.concat(F.lit("63"), F.substr(kept, F.lit(2))))
        .when(kept.startswith("9") & (F.length(kept) >= 10), F.concat(F.lit("63"), kept))
    )
    # 12 characters, country code 63, mobile prefix 90, 91 or 92.
    shown = F.regexp_extract(F.concat(F.lit("+"), number), r"^(\+639[012].{8})$", 1)
    return (
        df.withColumn("_k", _limited(F.regexp_replace(F.col(source), r"[^0-9+]", ""), only))
        .withColumn(target, F.nullif(shown, F.lit(""))).drop("_k")
    )


def checkbox_value(raw: Column) -> Column:
    """Yes, No or '' for a check mark."""
    word = F.lower(text.strip(F.coalesce(raw, F.lit(""))))
    known = F.create_map(*[F.lit(x) for w in YES_WORDS for x in (w, "Yes")],
                         *[F.lit(x) for w in NO_WORDS for x in (w, "No")])
    return F.coalesce(F.element_at(known, word), F.lit(""))


def parse_amounts(df: DataFrame, source: str, target: str, only: Column | None = None) -> DataFrame:
    """Add ``target``: the amount as X,XXX.XX (at most one currency sign), NULL where there is none."""
    value = F.col("_a")
    signs = F.regexp_count(value, F.lit(f"[{CURRENCY}]")) + F.regexp_count(value, F.lit(r"P(?=[0-9\s])"))
    bare = F.when(signs <= 1, F.translate(value, CURRENCY + "P ", ""))
    pattern = r"^(-?)([0-9]{1,3}(?:,?[0-9]{3})*\.?[0-9]{0,2})$"
    number = F.translate(F.regexp_extract(F.col("_b"), pattern, 2), ",", "").try_cast("double")
    sign = F.when(F.col("_b").startswith("-"), "-").otherwise("")
    return (
        df.withColumn("_a", _limited(text.strip(F.col(source)), only)).withColumn("_b", bare)
        .withColumn(target, F.concat(sign, text.money(number))).drop("_a", "_b")
    )


def conf_delta(kind: Column, raw: Column, value: Column, date_order: str = "dmy") -> Column:
    """Confidence change of the type rule, from the value it produced ('' = failed)."""
    filled = value != ""
    bad_date = INVALID if date_order == "dmy" else INVALID_AUTO
    return (
        F.when(kind == "date", F.when(filled, VALID).otherwise(bad_date))
        .when(kind == "phone", F.when(filled, NORMALIZED).otherwise(INVALID))
        .when(kind == "checkbox",
              F.when(filled, NORMALIZED).when(text.is_blank(raw), EMPTY).otherwise(AMBIGUOUS))
        .when(kind == "amount", F.when(filled, CORRECTED).otherwise(INVALID))
        .otherwise(EMPTY)
    )


def standardize_schema(fields: DataFrame, date_order: str = "dmy") -> DataFrame:
    """Apply the rule of the declared ``type`` and then the ``required`` check.

    ``fields`` carries entry_id, field_name, ocr_value, confidence plus the schema columns ``type`` and
    ``required`` (see ``joins.with_field_schema``); NULL there means the template does not know the field,
    which then passes unchanged. ``value_date`` and ``value_amount`` are typed companions of value_out.
    """
    raw, kind = F.col("ocr_value"), F.col("type")
    staged = parse_dates(fields, "ocr_value", "_date", date_order, only=kind == "date")
    staged = parse_phones(staged, "ocr_value", "_phone", only=kind == "phone")
    staged = parse_amounts(staged, "ocr_value", "_amount", only=kind == "amount")
    empty = F.lit("")
    value = (
        F.when(kind == "date", F.coalesce("_date", empty))
        .when(kind == "phone", F.coalesce("_phone", empty))
        .when(kind == "checkbox", checkbox_value(raw))
        .when(kind == "amount", F.coalesce("_amount", empty))
        .otherwise(raw)
    )
    staged = staged.withColumns({"value_in": raw, "conf_in": F.col("confidence"), "value_out": value})
    needed = F.coalesce("required", F.lit(False)) & kind.isNotNull()
    required = F.when(~needed, EMPTY).when(text.is_blank(F.col("value_out")), REQUIRED_MISSING).otherwise(NORMALIZED)
    delta = conf_delta(kind, raw, F.col("value_out"), date_order)
    return emit(staged.withColumn("conf_delta", F.round(delta + required, 9))).withColumns({
        "rule": F.when(kind.isin("date", "phone", "checkbox", "amount"), kind).otherwise("none"),
        "value_date": F.to_date("_date", "dd/MM/yyyy"),
        "value_amount": F.when(kind == "amount", F.translate("_amount", ",", "").try_cast("decimal(18,2)")),
    }).drop("_date", "_phone", "_amount")
