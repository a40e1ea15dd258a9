"""Tolerant parsing of texts, numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Without control characters (tab, newline and carriage return stay inside), and trimmed."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def number(text: Column) -> Column:
    """A number with a decimal comma or point; anything else is null."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def number_within(text: Column) -> Column:
    """The first number inside a text, with its sign."""
    return F.replace(F.nullif(F.regexp_extract(text, r"-?\d+([.,]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def date_of(text: Column, today: Column) -> Column:
    """A date from epoch seconds or milliseconds (above 1e11), day/month/year or ISO text; null before 1900 or after ``today``."""
    n = text.try_cast("double")
    seconds = F.when(F.abs(n) > 1e11, n / 1000).otherwise(n)
    epoch = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    parsed = F.when(n.isNotNull(), epoch).otherwise(F.coalesce(F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(text, "yyyy-MM-dd")))
    return F.when((parsed >= F.lit("1900-01-01").cast("date")) & (parsed <= today), parsed)


def first_class(text: Column, classes: list[tuple[str, list[str]]], fold: bool = False, missing: str | None = None, other: str | None = None) -> Column:
    """The first class, in order, one of whose terms ``text`` contains; ``fold`` also ignores accents."""
    held = F.collate(text, "UNICODE_CI_AI") if fold else F.lower(text)
    out = F.lit(other)
    for name, terms in reversed(classes):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(held, F.collate(F.lit(t), "UNICODE_CI_AI") if fold else F.lit(t))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(text.isNull(), F.lit(missing)).otherwise(out)


def zero_is_missing(first: Column, second: Column) -> Column:
    """The first value unless it is missing or zero, else the second."""
    return F.coalesce(F.nullif(first, F.lit(0.0)), second)
