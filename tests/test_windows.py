"""Literal windows, intervals and date math."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from logscope.functions import intervals, numbers, times
from logscope.functions.intervals import Interval, auto_interval
from logscope.functions.windows import TimeWindow

NOW = datetime(2024, 3, 31, 12, 0, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_absolute_window_takes_utc_and_gives_local():
    window = TimeWindow.absolute("2016-05-22T09:32:21", "2016-05-22T10:00:00", zone="GMT+4")
    assert window.start == datetime(2016, 5, 22, 13, 32, 21)
    assert window.end == datetime(2016, 5, 22, 14, 0)


@pytest.mark.parametrize("zone, hour", [("GMT+4", 13), ("UTC-03:30", 6), ("Asia/Dubai", 13)])
def test_zone_forms(zone, hour):
    assert TimeWindow.since("2016-05-22 09:32:00", NOW, zone).start.hour in (hour, hour - 1)


def test_to_zone_column(spark):
    got = one(spark, times.to_zone(times.ntz("2016-05-22 09:32:21"), "GMT+4"))
    assert got == datetime(2016, 5, 22, 13, 32, 21)


@pytest.mark.parametrize("amount, unit, start", [
    (15, "MINUTE", datetime(2024, 3, 31, 11, 45)),
    (90, "SECONDS", datetime(2024, 3, 31, 11, 58, 30)),
    (2, "DAYS", datetime(2024, 3, 29, 12)),
    (1, "MONTH", datetime(2024, 2, 29, 12)),
    (1, "YEAR", datetime(2023, 3, 31, 12)),
    (13, "MONTHS", datetime(2023, 2, 28, 12)),
])
def test_relative_window(amount, unit, start):
    assert TimeWindow.relative(amount, unit, NOW) == TimeWindow(start, NOW)


def test_unknown_unit_is_refused():
    with pytest.raises(ValueError, match="not recognised"):
        TimeWindow.relative(1, "WEEK", NOW)


def test_span_guard():
    TimeWindow.of("2024-01-01 23:59:00", "2024-01-05 00:01:00").checked()
    with pytest.raises(ValueError, match="limit of 5 days"):
        TimeWindow.of("2024-01-01 23:59:00", "2024-01-06 00:01:00").checked()
    with pytest.raises(ValueError, match="earlier"):
        TimeWindow.of("2024-01-01", "2024-01-01").checked()


def test_zoom_never_passes_now():
    day = timedelta(days=1)
    window = TimeWindow(NOW - 3 * day, NOW - day)
    assert window.zoomed(2, NOW) == TimeWindow(NOW - 4 * day, NOW)
    assert window.zoomed(4, NOW) == TimeWindow(NOW - 8 * day, NOW)
    assert window.zoomed(0.5, NOW) == TimeWindow(NOW - 2.5 * day, NOW - 1.5 * day)
    running = TimeWindow(NOW - day, NOW + day)
    assert running.zoomed(2, NOW) == TimeWindow(NOW - 2 * day, NOW + 2 * day)


def test_intersection_and_hull():
    a, b = TimeWindow.of("2024-01-01", "2024-01-10"), TimeWindow.of("2024-01-05", "2024-01-20")
    assert TimeWindow.intersection([a, b]) == TimeWindow.of("2024-01-05", "2024-01-10")
    assert TimeWindow.hull([a, b]) == TimeWindow.of("2024-01-01", "2024-01-20")


@pytest.mark.parametrize("text, seconds", [
    ("5m", 300), ("1w", 604800), ("2M", 5184000), ("1y", 31536000), ("1.5h", 3600), ("10s", 10)])
def test_interval_text(spark, text, seconds):
    assert Interval.parse(text).seconds == seconds
    assert one(spark, intervals.interval_seconds(F.lit(text))) == seconds


def test_interval_text_without_unit(spark):
    with pytest.raises(ValueError):
        Interval.parse("5 q")
    assert one(spark, intervals.interval_seconds(F.lit("5 q"))) is None


@pytest.mark.parametrize("span, text", [
    (timedelta(minutes=15), "10s"), (timedelta(hours=1), "30s"), (timedelta(days=1), "10m"),
    (timedelta(days=7), "1h"), (timedelta(days=30), "12h"), (timedelta(days=365), "1d"),
    (timedelta(days=4000), "30d"), (timedelta(days=5000), "1y"), (timedelta(seconds=45), "100ms"),
])
def test_auto_interval(spark, span, text):
    # The column ladder and the one for literals agree.
    got = auto_interval(span)
    assert f"{got.count}{got.unit}" == text
    width = one(spark, intervals.auto_width_ms(F.lit(span // timedelta(milliseconds=1))))
    assert width == got.seconds * 1000


@given(st.integers(min_value=60_000, max_value=10**13))
def test_ladder_is_monotone(span_ms):
    def width(ms):
        try:
            return auto_interval(timedelta(milliseconds=ms)).seconds
        except ValueError:
            return 0
    assert width(span_ms) <= width(span_ms * 2)


@pytest.mark.parametrize("seconds, text", [
    (90, "1m"), (3600, "1h"), (86399, "23h"), (86400, "1d"), (31536000, "1y"), (5, "5s"),
    (0, "less then a second"), (0.1, "0.1s"), (2.5, "2.5s")])
def test_duration_text(spark, seconds, text):
    assert one(spark, intervals.duration_text(F.lit(seconds))) == text


def test_time_patterns():
    assert [intervals.time_pattern(Interval.parse(t)) for t in ("2M", "1M", "1d", "1m", "59s")] == [
        "MM/yy", "MM/dd/yy", "MM/dd/yy", "HH:mm<br>MM/dd", "HH:mm:ss"]


def test_date_math_steps(spark):
    base = times.ntz("2016-05-22 09:32:21.123456")
    assert one(spark, times.date_math(base, [("add", -15, "MINUTE")])) == datetime(
        2016, 5, 22, 9, 17, 21, 123456)
    assert one(spark, times.date_math(base, [("round", "MONTH"), ("add", 1, "MONTH"),
                                             ("add", -1, "SECOND")])) == datetime(2016, 5, 31, 23, 59, 59)
    for unit, want in {"YEAR": datetime(2016, 1, 1), "DAY": datetime(2016, 5, 22),
                       "SECOND": datetime(2016, 5, 22, 9, 32, 21),
                       "MILLI": datetime(2016, 5, 22, 9, 32, 21, 123000)}.items():
        assert one(spark, times.floor_to(base, unit)) == want
    assert one(spark, times.floor_to(times.ntz("1969-12-31 23:59:59.5"), "SECOND")) == datetime(
        1969, 12, 31, 23, 59, 59)


def test_times_do_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    # 02:30 does not exist in this zone on that day.
    ts = times.ntz("2024-03-10 02:30:00")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, times.floor_to(ts, "HOUR")) == datetime(2024, 3, 10, 2)
        assert one(spark, times.from_instant(times.to_instant(ts))) == datetime(2024, 3, 10, 2, 30)
        assert one(spark, times.day_label(ts)) == "tb_20240310"
        assert one(spark, times.add_units(ts, 1, "HOUR")) == datetime(2024, 3, 10, 3, 30)
        assert one(spark, times.add_units(ts, -1, "DAY")) == datetime(2024, 3, 9, 2, 30)
        assert one(spark, intervals.time_text(ts, Interval(1, "h"))) == "02:30<br>03/10"
        assert one(spark, times.to_zone(ts)) == datetime(2024, 3, 10, 6, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_day_labels(spark):
    label = F.lit("tb_20240229")
    assert one(spark, times.neighbor_day_label(label)) == "tb_20240301"
    assert one(spark, times.neighbor_day_label(label, -1)) == "tb_20240228"
    assert one(spark, times.neighbor_day_label(label, 1, F.lit("tb_20240229"))) == "tb_20240229"
    assert one(spark, times.neighbor_day_label(label, 1, F.lit("tb_20240115"))) == "tb_20240229"


@pytest.mark.parametrize("old, new, want", [
    (0, 5, None), (3, 4, 33.33), (800, 799, -0.12), (3, 2, -33.33), (8, 9, 12.5), (7, 7, 0.0)])
def test_percent_change(spark, old, new, want):
    # -0.125 rounds half up, to -0.12.
    assert one(spark, numbers.percent_change(F.lit(old), F.lit(new))) == want


def test_percent_is_floored(spark):
    assert one(spark, numbers.percent_of(F.lit(2), F.lit(3))) == 66.66
    assert one(spark, numbers.percent_of(F.lit(2), F.lit(0))) is None


def test_number_texts(spark):
    assert one(spark, numbers.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, numbers.thousands(F.lit(999))) == "999"
    for number, wanted in ((1234.56789, "1,234.56789"), (-0.5, "-0.5"), (-1234567.0, "-1,234,567"),
                           (0.0, "0"), (100.10, "100.1"), (1e10, "10,000,000,000")):
        assert one(spark, numbers.thousands(F.lit(number))) == wanted
    assert one(spark, numbers.thousands(F.lit(None).cast("double"))) is None
    assert one(spark, numbers.numeric_gap(F.lit(0), F.lit(250))) == 4
    assert one(spark, numbers.to_number(F.lit("x1"))) is None
    assert one(spark, numbers.to_number(F.lit("NaN"))) is None
    assert one(spark, numbers.to_number(F.lit("1e3"))) == 1000.0
    assert one(spark, numbers.rescale(F.lit(5), F.lit(0), F.lit(10), 0, 30)) == 15.0
    assert one(spark, numbers.rescale(F.lit(5), F.lit(5), F.lit(5))) is None
