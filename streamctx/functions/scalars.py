"""Column functions whose results differ from the nearest Spark built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_index(col: Column, delimiter: str, i: int, base: int = 0) -> Column:
    """The i-th part between delimiters, counted from `base`; NULL where there is none."""
    return F.get(F.split(col, f"\\Q{delimiter}\\E"), F.lit(i - base))


def first_item(array: Column) -> Column:
    """The first element; NULL for an empty or NULL array."""
    return F.try_element_at(array, F.lit(1))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp; one without zone counts as UTC (run sessions in UTC)."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def epoch_us(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def match_text(col: Column, pattern: str) -> Column:
    """The whole first match of a regular expression; NULL without one."""
    return F.regexp_substr(col, F.lit(pattern))


def json_value(col: Column, path: str) -> Column:
    """The scalar at a JSON path as a string; NULL if the text isn't JSON or has no such path."""
    return F.get_json_object(col, path)


def strip_fence(col: Column) -> Column:
    """A model's reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(col, r"^\s*```(json)?\s*", ""), r"\s*```\s*$", "")


def iso_timestamp(col: Column) -> Column:
    """An ISO-8601 UTC time with milliseconds and Z; NULL if it isn't one."""
    return F.try_to_timestamp(col, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def prompt(*parts: str | Column) -> Column:
    """The parts as one text. Strings are literal; a NULL column shows as `unknown` and doesn't void the prompt."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


def stable_id(*cols: Column) -> Column:
    """A surrogate key that is the same in every run."""
    return F.md5(F.concat_ws("\x1f", *[c.cast("string") for c in cols]))
