"""Column expressions on ids and labels. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing label.
NULL_WORDS = ("none", "null", "na", "n/a", "empty", "unknown")


def strip_quotes(col: Column) -> Column:
    """The id without any ' and " (their place doesn't matter)."""
    return F.translate(col, "'\"", "")


def clean_id(col: Column) -> Column:
    """The id without quote characters and outer spaces; null when nothing is left."""
    cleaned = F.trim(strip_quotes(col))
    return F.when(cleaned != "", cleaned)


def normalise_label(col: Column, default: str = "unclassified") -> Column:
    """A species label, trimmed; `default` for null, blank and the words that mean missing."""
    trimmed = F.trim(col)
    return F.when(
        trimmed.isNull() | (trimmed == "") | F.lower(trimmed).isin(*NULL_WORDS), F.lit(default)
    ).otherwise(trimmed)


def first_token(col: Column) -> Column:
    """The first white-space separated word; null for null and blank input."""
    token = F.split(F.trim(col), r"\s+").getItem(0)
    return F.when(token != "", token)


def is_digits(col: Column) -> Column:
    """True for a non-empty run of 0-9; null input gives false."""
    return F.coalesce(col.rlike("^[0-9]+$"), F.lit(False))


def strip_space(col: Column) -> Column:
    """The text without white space (tabs and line ends too) at either end."""
    return F.regexp_replace(col, r"^\s+|\s+\z", "")
