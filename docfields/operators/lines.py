"""Per-entry summaries of OCR lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.numbers import count_where, exact_avg
from docfields.functions.scans import BLOCK, ordered_rank

# Weighted keywords of the known form types; on equal scores the earlier type wins.
FORM_KEYWORDS = {
    "dti_bnr": {"business name": 1.0, "dti": 1.0, "registration": 0.8, "new renewal": 0.7,
                "barangay": 0.6, "tin": 0.6},
    "barangay_clearance": {"barangay clearance": 1.0, "barangay": 0.8, "clearance": 0.9},
    "community_tax": {"community tax": 1.0, "cedula": 1.0, "tax certificate": 0.9},
}
MEDIUM_SCORE = 0.8
HIGH_SCORE = 1.5

# Characters that look like a box mark, and the activity words of the form.
BOX_MARKS = "[✓✔☑☐○●■█\\[\\]()xX]"
ACTIVITY_WORDS = "manufacturer|producer|service|retailer|wholesaler|importer|exporter"

# What the pattern inventory looks for.
INVENTORY = {
    "phone": r"(?:\+63|0)9\d{2}[ -]?\d{3}[ -]?\d{4}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b\d{4}-\d{1,2}-\d{1,2}\b",
    "tin": r"\b\d{9}\b|\b\d{3}-\d{3}-\d{3}\b",
    "amount": r"(?:₱|PHP|P)\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?",
}


def ordered_text(
    rows: DataFrame, keys: list[str], position: str, value: Column, separator: str, name: str
) -> DataFrame:
    """``value`` of each group joined in the order of the integer ``position``.

    Blocks of positions are joined first, so that no task ever sorts the single rows of a large group;
    the last step only concatenates a few block texts.
    """
    piece = F.struct(position, F.coalesce(value, F.lit("")).alias("text"))
    blocks = (
        rows.groupBy(*keys, F.floor(F.col(position) / BLOCK).alias("_block"))
        .agg(F.array_sort(F.collect_list(piece)).alias("_l"))
        .select(*keys, "_block", F.array_join(F.col("_l.text"), separator).alias("_text"))
    )
    joined = F.array_sort(F.collect_list(F.struct("_block", "_text")))["_text"]
    return blocks.groupBy(*keys).agg(F.array_join(joined, separator).alias(name))


def full_text(lines: DataFrame) -> DataFrame:
    """Lines of each entry joined by newline in line order."""
    return ordered_text(lines, ["entry_id"], "line_no", F.col("text"), "\n", "full_text")


def summarize_lines(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Line count, full text and average confidence per entry (0.0 and '' without lines)."""
    stats = lines.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("line_count"), exact_avg(F.col("confidence")).alias("avg_confidence"))
    joined = entries.select("entry_id").join(stats, "entry_id", "left").join(full_text(lines), "entry_id", "left")
    return joined.select(
        "entry_id",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
    )


def line_mark_statistics(lines: DataFrame) -> DataFrame:
    """Per entry: lines in all, with box marks, with activity words, with square brackets."""
    line = F.col("text")
    return lines.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        count_where(line.rlike(BOX_MARKS)).alias("lines_with_marks"),
        count_where(F.lower(line).rlike(ACTIVITY_WORDS)).alias("lines_with_activity_words"),
        count_where(line.contains("[") | line.contains("]")).alias("lines_with_brackets"),
    )


def form_type_score(lines: DataFrame) -> DataFrame:
    """Most likely form type per entry from the keywords its lines contain.

    A keyword counts once per entry, so its hits are reduced with a boolean aggregate: nothing but one
    flag per keyword is shuffled.
    """
    line = F.lower("text")
    flags = {
        (form, word): F.coalesce(F.bool_or(line.contains(word)), F.lit(False)).alias(f"{form}|{word}")
        for form, words in FORM_KEYWORDS.items() for word in words
    }
    hits = lines.groupBy("entry_id").agg(*flags.values())

    def score(form: str) -> Column:
        terms = [F.when(F.col(f"`{form}|{w}`"), F.lit(weight)).otherwise(0.0).cast("decimal(6,2)")
                 for w, weight in FORM_KEYWORDS[form].items()]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total.cast("double")

    scored = hits.select("entry_id", *[score(form).alias(form) for form in FORM_KEYWORDS])
    best = F.greatest(*FORM_KEYWORDS)
    winner = F.coalesce(*[F.when(F.col(form) == best, F.lit(form)) for form in FORM_KEYWORDS])
    return scored.select(
        "entry_id", *FORM_KEYWORDS, best.alias("best_score"),
        F.when(best >= MEDIUM_SCORE, winner).otherwise("unknown").alias("form_type"),
        F.when(best >= HIGH_SCORE, "high").when(best >= MEDIUM_SCORE, "medium").otherwise("low").alias("certainty"),
    )


def pattern_matches(lines: DataFrame) -> DataFrame:
    """Distinct (entry, kind, value) strings that look like phones, e-mails, dates, TINs or amounts."""
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"),
                 F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"))
        for kind, pattern in INVENTORY.items()
    ])
    return (
        lines.select("entry_id", F.explode(kinds).alias("k"))
        .select("entry_id", "k.kind", F.explode("k.hits").alias("value"))
        .distinct()
    )


def pattern_inventory(lines: DataFrame) -> DataFrame:
    """One row per entry with a sorted array per kind of pattern (entries without any are absent)."""
    found = pattern_matches(lines)
    return found.groupBy("entry_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind)
        for kind in INVENTORY
    ])


def reading_order(lines: DataFrame) -> DataFrame:
    """Number the lines of an entry by (top, left), ties by line number."""
    placed = lines.withColumns({"_top": F.col("box.top"), "_left": F.col("box.left")})
    return ordered_rank(placed, ["entry_id"], ["_top", "_left", "line_no"], "reading_no").drop("_top", "_left")


def next_lines(lines: DataFrame) -> DataFrame:
    """Text and confidence of the following line, by an equi-join on the dense line number.

    A join key of (entry, line number) spreads a long entry over all tasks; lead() would not.
    """
    following = lines.select(
        "entry_id", (F.col("line_no") - 1).alias("line_no"), F.col("text").alias("next_text"),
        F.col("confidence").alias("next_confidence"))
    return lines.join(following, ["entry_id", "line_no"], "left")


def page_extent(lines: DataFrame) -> DataFrame:
    """Largest right and bottom coordinate per entry (0 without boxes)."""
    return lines.groupBy("entry_id").agg(
        F.greatest(F.lit(0.0), F.coalesce(F.max("box.right"), F.lit(0.0))).alias("page_width"),
        F.greatest(F.lit(0.0), F.coalesce(F.max("box.bottom"), F.lit(0.0))).alias("page_height"),
    )
