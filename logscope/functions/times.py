"""Time arithmetic on TIMESTAMP_NTZ columns, independent of the session time zone."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# Accepted spellings of each calendar unit.
UNIT_NAMES = {
    "YEAR": "YEAR", "YEARS": "YEAR",
    "MONTH": "MONTH", "MONTHS": "MONTH",
    "DAY": "DAY", "DAYS": "DAY", "DATE": "DAY",
    "HOUR": "HOUR", "HOURS": "HOUR",
    "MINUTE": "MINUTE", "MINUTES": "MINUTE",
    "SECOND": "SECOND", "SECONDS": "SECOND",
    "MILLI": "MILLISECOND", "MILLIS": "MILLISECOND",
    "MILLISECOND": "MILLISECOND", "MILLISECONDS": "MILLISECOND",
}

_UNIT_MICROS = {"MILLISECOND": 1_000, "SECOND": 1_000_000, "MINUTE": 60_000_000}


def canonical_unit(unit: str) -> str:
    """The Spark name of a calendar unit; raises on names outside the list."""
    try:
        return UNIT_NAMES[unit.upper()]
    except KeyError:
        raise ValueError(f"unit not recognised: {unit}") from None


def ntz(value: str | datetime) -> Column:
    """A TIMESTAMP_NTZ literal. Constant folding turns it into a pushable bound."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds between 1970-01-01 and a zone-less timestamp.

    Built from the parts of the wall time: a timestamp difference would read
    both sides in the session zone and jump where that zone does.
    """
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86_400_000_000 + seconds.cast("bigint") * 1_000_000 + fraction


def literal_micros(moment: datetime) -> int:
    """:func:`epoch_micros` of a time known when the plan is built."""
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970-01-01, rounded down."""
    return F.floor(epoch_micros(ts) / F.lit(1000)).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    """The inverse of :func:`epoch_micros`."""
    return F.timestamp_add("MICROSECOND", micros, ntz("1970-01-01 00:00:00"))


def to_instant(ts: Column) -> Column:
    """Zone-less wall time as an instant (read as UTC), as watermarks require."""
    return F.timestamp_micros(epoch_micros(ts))


def from_instant(instant: Column) -> Column:
    """The inverse of :func:`to_instant`."""
    return from_epoch_micros(F.unix_micros(instant))


def add_units(ts: Column, amount: int, unit: str) -> Column:
    """``ts`` moved by ``amount`` calendar units; month ends clamp."""
    return F.timestamp_add(canonical_unit(unit), F.lit(amount), ts)


def floor_to(ts: Column, unit: str) -> Column:
    """``ts`` rounded down to a calendar unit."""
    name, day = canonical_unit(unit), F.to_date(ts)
    if name in ("YEAR", "MONTH"):
        return F.trunc(day, name).cast("timestamp_ntz")
    if name in ("DAY", "HOUR"):
        begun = day.cast("timestamp_ntz")
        return begun if name == "DAY" else F.timestamp_add("HOUR", F.hour(ts), begun)
    micros = epoch_micros(ts)
    return from_epoch_micros(micros - F.pmod(micros, F.lit(_UNIT_MICROS[name])))


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970-01-01, the cheapest slice of a time axis."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 24 + F.hour(ts)


def date_math(ts: Column, steps: Sequence[tuple]) -> Column:
    """Apply ``("round", unit)`` and ``("add", n, unit)`` steps from left to right."""
    for step in steps:
        if step[0] == "round":
            ts = floor_to(ts, step[1])
        elif step[0] == "add":
            ts = add_units(ts, step[1], step[2])
        else:
            raise ValueError(f"date math step not recognised: {step[0]}")
    return ts


def to_zone(ts: Column, zone: str = "GMT+4", source: str = "UTC") -> Column:
    """Wall time of ``source`` as wall time of ``zone``."""
    return F.convert_timezone(F.lit(source), F.lit(zone), ts)


def span_days(start: Column, end: Column) -> Column:
    """Calendar days between two timestamps."""
    return F.date_diff(F.to_date(end), F.to_date(start))


def _compact(day: Column) -> Column:
    return F.replace(day.cast("string"), F.lit("-"), F.lit(""))


def day_key(ts: Column) -> Column:
    """``yyyyMMdd`` as text, the value of the ``day`` partition column."""
    return _compact(F.to_date(ts))


def day_label(ts: Column, prefix: str = "tb_") -> Column:
    """The day table a timestamp belongs to."""
    return F.concat(F.lit(prefix), day_key(ts))


def neighbor_day_label(
    label: Column, step: int = 1, latest: Column | None = None, prefix: str = "tb_"
) -> Column:
    """The day label ``step`` days on; with ``latest``, never past it."""
    day = F.to_date(F.substring(label, len(prefix) + 1, 8), "yyyyMMdd")
    moved = F.concat(F.lit(prefix), _compact(F.date_add(day, step)))
    if latest is None:
        return moved
    return F.when(label >= latest, label).otherwise(F.least(moved, latest))


def floor_second(ts: Column) -> Column:
    """``ts`` without its fraction of a second."""
    return floor_to(ts, "SECOND")
