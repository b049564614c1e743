"""Null, finite and tolerant-cast helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.dims import API_KEY, SLUG_REST


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null, so a JSON document stays valid."""
    return F.when(is_finite(c.cast("double")), c)


def to_long(c: Column) -> Column:
    """Number or numeric text -> integer through double, truncating; anything else null."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(is_finite(d), d.try_cast("bigint"))


def to_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def one_decimal(c: Column) -> Column:
    """Context rounding: one decimal, half-even; non-numeric -> null."""
    return F.bround(to_double(c), 1)


def redact(c: Column) -> Column:
    """Hide the value of an ``api_key=`` parameter."""
    return F.regexp_replace(c, API_KEY, "$1***")


def path_slug(c: Column) -> Column:
    """A server name as one safe path segment."""
    cleaned = F.regexp_replace(F.trim(F.coalesce(F.when(c != "", c), F.lit("unknown"))), SLUG_REST, "_")
    dotted = F.replace(cleaned, F.lit(".."), F.lit("_"))
    return F.when(dotted == "", F.lit("unknown")).otherwise(dotted)


def compact_number(c: Column) -> Column:
    """Value field as display text: null and NaN are empty, whole numbers carry no fraction (six significant digits)."""
    text = F.format_string("%.6g", c)
    exact = F.format_number(c, 0)
    whole = (c == F.floor(c)) & (F.abs(c) < 1_000_000)
    trimmed = F.regexp_replace(F.regexp_replace(text, "(\\.\\d*?)0+($|e)", "$1$2"), "\\.($|e)", "$1")
    return F.when(c.isNull() | F.isnan(c), F.lit("")).when(whole, F.replace(exact, F.lit(","), F.lit(""))).otherwise(trimmed)
