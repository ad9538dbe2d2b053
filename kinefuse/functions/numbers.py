"""Number casts, divisions and roundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's own cast also takes padded text and suffixes such as "1d", so the text is checked first.
NUMBER_TEXT = (
    r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
    r"|\A[+-]?(?i:inf|infinity)\z"
)


def text_to_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def nan_to_null(value: Column) -> Column:
    """Double with NaN turned into null, so that comparisons behave."""
    return F.when(~F.isnan(value), value)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient, null when the divisor is zero."""
    return F.try_divide(numerator, denominator)


def finite(value: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def round_whole(value: Column) -> Column:
    """Half-even rounding to a whole number."""
    return F.rint(finite(value)).cast("long")


def round_hundredths(value: Column) -> Column:
    """Two digits by scaling, rounding half-even and scaling back.

    `bround(x, 2)` works on the decimal text of the number and differs on values such as 1.015.
    """
    return F.rint(finite(value) * 100) / 100
