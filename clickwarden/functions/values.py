"""Cleaning of single values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\r\n\f\u000b"


def stripped(value: Column) -> Column:
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def text_or_null(value: Column) -> Column:
    """The text itself; NULL when empty."""
    return F.nullif(value.cast("string"), F.lit(""))


def blank_to_null(value: Column) -> Column:
    """The trimmed text; NULL when nothing is left."""
    return F.nullif(stripped(value), F.lit(""))


def int_or_null(value: Column) -> Column:
    return value.try_cast("double").try_cast("int")


def double_or_zero(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a double, 0 when the denominator is not positive."""
    bottom = denominator.cast("double")
    return F.when(bottom > 0, numerator.cast("double") / bottom).otherwise(F.lit(0.0))


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
