"""Text expressions shared by several jobs (rules of one profile stay in that profile)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.strip() sees it; Spark's trim() removes blanks only.
_WS = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(column: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(column, f"^{_WS}+|{_WS}+$", "")


def collapse(column: Column) -> Column:
    """Each run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(column, f"{_WS}+", " "))


def is_blank(column: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(column) == "", F.lit(True))


def replace_each(column: Column, pairs: dict[str, str]) -> Column:
    """Single-character replacements. The targets are never sources, so one pass is enough."""
    return F.translate(column, "".join(pairs), "".join(pairs.values()))


def digits(column: Column) -> Column:
    """Digits only."""
    return F.regexp_replace(column, r"[^0-9]", "")


def capture(column: Column, pattern: str, group: int = 0) -> Column:
    """Capture group of the first match, NULL (not '') when the pattern is absent or the group empty."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def python_title(column: Column) -> Column:
    """Python's str.title(): every run of letters starts upper case, the rest is lower case."""
    pieces = F.regexp_extract_all(column, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def first_of(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """CASE over (condition, value) pairs in order."""
    head, *tail = branches
    chain = reduce(lambda acc, b: acc.when(b[0], b[1]), tail, F.when(head[0], head[1]))
    return chain.otherwise(otherwise)


def money(column: Column) -> Column:
    """1234.5 as '1,234.50'."""
    return F.format_number(column, 2)


def text_after_colon(column: Column) -> Column:
    """Stripped text after the first ':', NULL when there is no colon or nothing follows."""
    position = F.instr(column, ":")
    rest = strip(F.substr(column, position + F.lit(1)))
    return F.when((position > 0) & (rest != ""), rest)
