"""Interval texts such as ``5m`` and the automatic bucket width."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, functions as F

# Seconds in one interval unit.
UNIT_SECONDS = {
    "y": 31536000, "M": 2592000, "w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1,
}

# Raw width up to the first figure (milliseconds) becomes the second.
WIDTH_LADDER = (
    (500, 100),
    (5000, 1000),
    (7500, 5000),
    (15000, 10000),
    (45000, 30000),
    (180000, 60000),
    (450000, 300000),
    (1200000, 600000),
    (2700000, 1800000),
    (7200000, 3600000),
    (21600000, 10800000),
    (86400000, 43200000),
    (172800000, 86400000),
    (604800000, 86400000),
    (1814400000, 604800000),
)
# Below the limit (exclusive) 30 days, from it on one year.
MONTH_LIMIT_MS, MONTH_MS, YEAR_MS = 3628800000, 2592000000, 31536000000

# From so many seconds a bucket, label times so.
TIME_PATTERNS = ((2628000, "MM/yy"), (86400, "MM/dd/yy"), (60, "HH:mm<br>MM/dd"), (0, "HH:mm:ss"))

# Fixed value: the text of a duration of nothing, in its customary spelling.
NO_DURATION = "less then a second"

# Where each part stands in the text of a timestamp.
_TEXT_PARTS = {"yy": 3, "MM": 6, "dd": 9, "HH": 12, "mm": 15, "ss": 18}

_INTERVAL = re.compile(r"(\d+)(?:\.\d+)?([Mwdhmsy])")


@dataclass(frozen=True)
class Interval:
    """A count of one unit. Months and years follow the calendar; ``ms`` is no text's unit."""

    count: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Interval:
        match = _INTERVAL.search(text)
        if match is None:
            raise ValueError("an interval is a number followed by one of Mwdhmsy")
        return cls(int(match[1]), match[2])

    @property
    def micros(self) -> int:
        return self.count * (1000 if self.unit == "ms" else UNIT_SECONDS[self.unit] * 1_000_000)

    @property
    def seconds(self) -> int | float:
        """Seconds, a fraction for some intervals of milliseconds."""
        whole, rest = divmod(self.micros, 1_000_000)
        return self.micros / 1_000_000 if rest else whole

    @property
    def delta(self) -> timedelta:
        return timedelta(microseconds=self.micros)

    @property
    def months(self) -> int:
        """Calendar months, 0 for fixed-length units."""
        return self.count * {"M": 1, "y": 12}.get(self.unit, 0)

    def shift(self, ts: Column, times: int = 1) -> Column:
        """``ts`` moved by whole intervals; months and years by the calendar."""
        if self.months:
            return F.timestamp_add("MONTH", F.lit(self.months * times), ts)
        return F.timestamp_add("MICROSECOND", F.lit(self.micros * times), ts)

    def sql(self) -> str:
        """The step as a Spark interval literal."""
        if self.months:
            return f"INTERVAL {self.months} MONTH"
        if self.unit == "ms":
            return f"INTERVAL {self.count} MILLISECOND"
        return f"INTERVAL {self.seconds} SECOND"


def interval_seconds(text: Column) -> Column:
    """Seconds in interval text held in a column; null when it is none."""
    parts = r"(\d+)(?:\.\d+)?([Mwdhmsy])"
    unit = F.regexp_extract(text, parts, 2)
    factor = F.lit(None).cast("bigint")
    for name, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == name, F.lit(seconds)).otherwise(factor)
    return F.regexp_extract(text, parts, 1).try_cast("bigint") * factor


def auto_width_ms(span_ms: Column, bars: int = 100) -> Column:
    """Bucket width for about ``bars`` buckets over a span, from the fixed ladder."""
    raw = span_ms / F.lit(bars)
    width = F.when(raw < MONTH_LIMIT_MS, F.lit(MONTH_MS)).otherwise(F.lit(YEAR_MS))
    for limit, value in reversed(WIDTH_LADDER):
        width = F.when(raw <= limit, F.lit(value)).otherwise(width)
    return width.cast("bigint")


def auto_interval(span: timedelta, bars: int = 100) -> Interval:
    """:func:`auto_width_ms` for a span known when the plan is built."""
    raw = span / timedelta(milliseconds=1) / bars
    width = next((value for limit, value in WIDTH_LADDER if raw <= limit), None)
    if width is None:
        width = MONTH_MS if raw < MONTH_LIMIT_MS else YEAR_MS
    if width < 1000:
        return Interval(width, "ms")
    seconds = width // 1000
    for unit in "ydhms":
        whole = seconds // UNIT_SECONDS[unit]
        if whole:
            return Interval(whole, unit)


def duration_text(seconds: Column) -> Column:
    """The largest whole unit of a duration, as in ``90`` -> ``1m``."""
    whole = F.floor(seconds)
    rest = seconds - F.floor(seconds / 60) * 60
    rest_text = F.when(rest == F.floor(rest), F.floor(rest).cast("string")).otherwise(
        rest.cast("double").cast("string")
    )
    text = F.when(rest > 0, F.concat(rest_text, F.lit("s"))).otherwise(F.lit(NO_DURATION))
    for unit in "mhdy":
        size = UNIT_SECONDS[unit]
        text = F.when(
            whole >= size, F.concat(F.floor(whole / size).cast("string"), F.lit(unit))
        ).otherwise(text)
    return F.when(seconds.isNotNull(), text)


def time_pattern(interval: Interval) -> str:
    """Label format that suits a bucket width."""
    return next(pattern for floor, pattern in TIME_PATTERNS if interval.seconds >= floor)


def time_text(ts: Column, interval: Interval) -> Column:
    """A timestamp as a label that suits a bucket width."""
    pieces = re.split("(yy|MM|dd|HH|mm|ss)", time_pattern(interval))
    text = ts.cast("string")
    return F.concat(*(
        F.substring(text, _TEXT_PARTS[p], 2) if p in _TEXT_PARTS else F.lit(p) for p in pieces if p
    ))
