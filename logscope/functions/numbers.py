"""Percentages, scaling and number texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def numeric_gap(low: Column, high: Column, bars: int = 100) -> Column:
    """Bucket width for a numeric range: half-up rounded share plus one."""
    return F.floor((high - low) / F.lit(bars) + F.lit(0.5)) + 1


def percent_of(part: Column, whole: Column) -> Column:
    """Percent, floored to two digits; null when the whole is zero."""
    return F.floor(F.try_divide(part, whole) * 10000) / 100


def percent_change(old: Column, new: Column) -> Column:
    """Change in percent, two digits, half-up; null when ``old`` is zero."""
    change = F.try_divide((new - old) * F.lit(100.0), old)
    return F.floor(change * 100 + F.lit(0.5)) / 100


def thousands(number: Column) -> Column:
    """Number text with a comma between each group of three digits of the whole part.

    Up to ten digits after the point are shown, without zeros at the end.
    """
    text = number.cast("decimal(38,10)").cast("string")
    whole = F.format_number(F.split_part(text, F.lit("."), F.lit(1)).cast("decimal(38,0)"), 0)
    sign = F.when(F.startswith(text, F.lit("-0.")), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.regexp_extract(text, r"(\.\d*[1-9])?0*$", 1))


def to_number(text: Column) -> Column:
    """Text as double; null where it is no number.

    The pattern comes first since a failed cast costs far more than a failed match.
    """
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))


def rescale(
    value: Column, low: Column, high: Column, out_low: float = 0.0, out_high: float = 10.0
) -> Column:
    """Linear map of ``[low, high]`` onto ``[out_low, out_high]``; null on a zero range."""
    share = F.try_divide((value - low).cast("double"), (high - low).cast("double"))
    return F.lit(float(out_low)) + share * F.lit(float(out_high - out_low))


def latitude(point: Column) -> Column:
    """First part of ``"lat,lon"`` as double; null where it is no number."""
    return to_number(F.split_part(point, F.lit(","), F.lit(1)))


def longitude(point: Column) -> Column:
    """Second part of ``"lat,lon"`` as double; null where it is no number."""
    return to_number(F.split_part(point, F.lit(","), F.lit(2)))
