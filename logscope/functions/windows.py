"""Literal time windows, known when the plan is built."""

from __future__ import annotations

import calendar
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

from pyspark.sql import Column

from logscope.functions.times import canonical_unit, ntz

_FIXED_OFFSET = re.compile(r"^(?:GMT|UTC)([+-])(\d{1,2})(?::(\d{2}))?$")
_DELTA_ARGS = {
    "DAY": "days", "HOUR": "hours", "MINUTE": "minutes",
    "SECOND": "seconds", "MILLISECOND": "milliseconds",
}


def zone_of(name: str) -> tzinfo:
    """A zone from ``GMT+4`` style text or an IANA name."""
    match = _FIXED_OFFSET.match(name)
    if match is None:
        return ZoneInfo(name)
    sign = 1 if match[1] == "+" else -1
    return timezone(sign * timedelta(hours=int(match[2]), minutes=int(match[3] or 0)))


def _moment(value: str | datetime) -> datetime:
    return datetime.fromisoformat(value) if isinstance(value, str) else value


def _utc_to_local(value: str | datetime, zone: str | None) -> datetime:
    moment = _moment(value)
    if zone is None:
        return moment
    return moment.replace(tzinfo=timezone.utc).astimezone(zone_of(zone)).replace(tzinfo=None)


def _back(now: datetime, amount: int, unit: str) -> datetime:
    unit = canonical_unit(unit)
    if unit in _DELTA_ARGS:
        return now - timedelta(**{_DELTA_ARGS[unit]: amount})
    months = now.year * 12 + now.month - 1 - amount * (12 if unit == "YEAR" else 1)
    year, month = divmod(months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


@dataclass(frozen=True)
class TimeWindow:
    """From ``start`` to ``end``, zone-less, both ends inclusive as a filter."""

    start: datetime
    end: datetime

    @classmethod
    def of(cls, start: str | datetime, end: str | datetime) -> TimeWindow:
        return cls(_moment(start), _moment(end))

    @classmethod
    def absolute(cls, start, end, zone: str | None = None) -> TimeWindow:
        """Bounds given in UTC, kept in ``zone``'s wall time."""
        return cls(_utc_to_local(start, zone), _utc_to_local(end, zone))

    @classmethod
    def relative(cls, amount: int, unit: str, now: str | datetime) -> TimeWindow:
        """The last ``amount`` units before ``now``, unrounded."""
        end = _moment(now)
        return cls(_back(end, amount, unit), end)

    @classmethod
    def since(cls, start, now: str | datetime, zone: str | None = None) -> TimeWindow:
        """From a UTC start to ``now``."""
        return cls(_utc_to_local(start, zone), _moment(now))

    @classmethod
    def intersection(cls, windows: Sequence[TimeWindow]) -> TimeWindow:
        """Latest start to earliest end."""
        return cls(max(w.start for w in windows), min(w.end for w in windows))

    @classmethod
    def hull(cls, windows: Sequence[TimeWindow]) -> TimeWindow:
        """Earliest start to latest end."""
        return cls(min(w.start for w in windows), max(w.end for w in windows))

    @property
    def length(self) -> timedelta:
        return self.end - self.start

    @property
    def day_span(self) -> int:
        return (self.end.date() - self.start.date()).days

    def day_keys(self) -> tuple[str, str]:
        """First and last ``yyyyMMdd`` the window touches."""
        return self.start.strftime("%Y%m%d"), self.end.strftime("%Y%m%d")

    def checked(self, max_span_days: int = 5) -> TimeWindow:
        """This window, or an error before any job runs."""
        if self.start >= self.end:
            raise ValueError("the start time must be earlier than the end time")
        if self.day_span >= max_span_days:
            raise ValueError(f"the window reaches the limit of {max_span_days} days")
        return self

    def earlier(self, by: timedelta) -> TimeWindow:
        """The same window ``by`` earlier."""
        return TimeWindow(self.start - by, self.end - by)

    def zoomed(self, factor: float, now: str | datetime) -> TimeWindow:
        """Scaled about the centre; a window that ended before now never passes it."""
        now = _moment(now)
        center = self.end - self.length / 2
        half = self.length * factor / 2
        start, end = center - half, center + half
        if end > now and self.end < now:
            start, end = start - (end - now), now
        return TimeWindow(start, end)

    def covers(self, ts: Column) -> Column:
        """Both ends inclusive; plain bounds, so they reach the scan."""
        return (ts >= ntz(self.start)) & (ts <= ntz(self.end))

    def covers_half_open(self, ts: Column) -> Column:
        """Start inclusive, end exclusive."""
        return (ts >= ntz(self.start)) & (ts < ntz(self.end))
