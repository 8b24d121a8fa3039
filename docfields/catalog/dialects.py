"""The few spellings in which Spark SQL and DuckDB SQL differ, for the shared view definitions."""

from __future__ import annotations


class SparkDialect:
    name = "spark"
    lb, rb = "{{", "}}"  # spark.sql() formats its text, so literal braces are doubled

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def date(self, column: str, style: str) -> str:
        pattern = {"dmy": "dd/MM/yyyy", "ymd": "yyyy-MM-dd", "long": "MMMM d, yyyy", "short": "d MMM yyyy",
                   "y": "yyyy", "m": "MM", "d": "dd", "path": "yyyy/MM"}[style]
        return f"date_format({column}, '{pattern}')"

    def money(self, column: str) -> str:
        return f"format_number({column}, 2)"

    def colon_after_first_word(self, column: str) -> str:
        return f"regexp_replace({column}, '^([^ ]*) ', '$1: ')"

    def days(self, column: str, n: str) -> str:
        return f"({column} + make_interval(0, 0, 0, {n}))"

    def instant(self, value: str) -> str:
        return f"TIMESTAMP_NTZ '{value}'"

    def minutes(self, column: str, n: str) -> str:
        return f"({column} + make_interval(0, 0, 0, 0, 0, {n}))"

    def split_lines(self, key: str, column: str, source: str, extra: str = "") -> str:
        return (f"SELECT {key}{extra}, CAST(line_no AS BIGINT) AS line_no, line FROM {source} "
                f"LATERAL VIEW posexplode(split({column}, '\\n')) l AS line_no, line")


class DuckDialect:
    name = "duckdb"
    lb, rb = "{", "}"

    def table(self, name: str) -> str:
        return name

    def date(self, column: str, style: str) -> str:
        pattern = {"dmy": "%d/%m/%Y", "ymd": "%Y-%m-%d", "long": "%B %-d, %Y", "short": "%-d %b %Y",
                   "y": "%Y", "m": "%m", "d": "%d", "path": "%Y/%m"}[style]
        return f"strftime({column}, '{pattern}')"

    def money(self, column: str) -> str:
        return "format('{:,.2f}', " + column + ")"

    def colon_after_first_word(self, column: str) -> str:
        return f"regexp_replace({column}, '^([^ ]*) ', '\\1: ')"

    def days(self, column: str, n: str) -> str:
        return f"({column} + to_days(CAST({n} AS INTEGER)))"

    def instant(self, value: str) -> str:
        return f"TIMESTAMP '{value}'"

    def minutes(self, column: str, n: str) -> str:
        return f"({column} + to_minutes({n}))"

    def split_lines(self, key: str, column: str, source: str, extra: str = "") -> str:
        return (f"SELECT {key}{extra}, unnest(range(len(string_split({column}, chr(10))))) AS line_no, "
                f"unnest(string_split({column}, chr(10))) AS line FROM {source}")


SPARK, DUCK = SparkDialect(), DuckDialect()
