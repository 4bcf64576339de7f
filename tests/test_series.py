"""Histograms, zero-filling, trends and ranks on small cases."""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logscope.functions.intervals import Interval
from logscope.functions.windows import TimeWindow
from logscope.operators import series
from logscope.operators.predicates import Query, match_all
from logscope.operators.ranking import first_rows, rank_in_group, top_per_group

HOUR = timedelta(hours=1)
START = datetime(2024, 1, 1)


def times(spark, *stamps):
    return spark.createDataFrame([(s,) for s in stamps], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("ts"))


def bars(df):
    return {(r["series"], r["bucket"]): r["count"] for r in df.collect()}


def test_window_edges(spark):
    rows = times(spark, "2024-01-01 00:00:00", "2024-01-01 04:00:00", "2023-12-31 23:59:59.999999",
                 "2024-01-01 03:59:59.999999", "2024-01-01 04:00:00.000001")
    even = TimeWindow.of("2024-01-01 00:00:00", "2024-01-01 04:00:00")
    # A row at the very end passes the filter but lies in no bucket.
    got = bars(series.histogram(rows, "ts", even, Interval(2, "h")))
    assert got == {("all", START): 1, ("all", START + 2 * HOUR): 1}
    # A gap that does not divide the window: the last bucket holds the end.
    got = bars(series.histogram(rows, "ts", even, Interval(3, "h")))
    assert got == {("all", START): 1, ("all", START + 3 * HOUR): 2}


def test_empty_table_is_all_zero(spark):
    window = TimeWindow.of("2024-01-01", "2024-01-03")
    queries = [Query("a", match_all()), Query("b", F.lit(None).cast("boolean"))]
    got = bars(series.histogram(times(spark).where("false"), "ts", window, Interval(1, "d"), queries))
    day = timedelta(days=1)
    assert got == {(q, START + i * day): 0 for q in "ab" for i in range(2)}


@pytest.mark.parametrize("start, end, interval, edges", [
    ("2024-01-01", "2024-04-01", "1M", ["01-01", "02-01", "03-01"]),
    ("2024-01-31", "2024-05-31", "1M", ["01-31", "02-29", "03-31", "04-30"]),
    ("2024-01-31", "2024-05-01", "2M", ["01-31", "03-31"]),
    ("2024-01-15", "2024-03-15 00:00:01", "1M", ["01-15", "02-15", "03-15"]),
    ("2024-01-01", "2024-12-31", "1y", ["01-01"]),
])
def test_calendar_buckets(spark, start, end, interval, edges):
    window = TimeWindow.of(start, end)
    days = spark.range((window.end - window.start).days).select(
        F.timestamp_add("DAY", F.col("id"), F.lit(start).cast("timestamp_ntz")).alias("ts"))
    got = bars(series.histogram(days, "ts", window, Interval.parse(interval)))
    starts = sorted(b for _, b in got)
    assert [f"{b:%m-%d}" for b in starts] == edges
    for here, after in zip(starts, [*starts[1:], window.end]):
        assert got["all", here] == min((after - here).days, (window.end - here).days)


def test_calendar_bucket_just_before_the_month_is_over(spark):
    rows = times(spark, "2024-02-29 11:59:59", "2024-02-29 12:00:00")
    window = TimeWindow.of("2024-01-31 12:00:00", "2024-03-31 12:00:00")
    got = bars(series.histogram(rows, "ts", window, Interval(1, "M")))
    assert got == {("all", datetime(2024, 1, 31, 12)): 1, ("all", datetime(2024, 2, 29, 12)): 1}


def test_range_histogram(spark):
    rows = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (25.0,), (29.9,), (30.0,), (-0.1,), (None,)],
                                 "v double")
    got = bars(series.range_histogram(rows, "v", 0, 25, 10))
    assert got == {("all", 0): 2, ("all", 10): 1, ("all", 20): 2}


def points(spark, hours, value=1):
    rows = [("s", START + h * HOUR, value) for h in hours]
    return spark.createDataFrame(rows, "series string, b timestamp, count bigint").select(
        "series", F.col("b").cast("timestamp_ntz").alias("bucket"), "count")


def shown(df):
    return sorted(((r["bucket"] - START) // HOUR, r["count"]) for r in df.collect())


@pytest.mark.parametrize("hours, filled", [
    ([0, 1], [(0, 1), (1, 1)]),
    ([0, 2], [(0, 1), (1, 0), (2, 1)]),
    ([0, 3], [(0, 1), (1, 0), (2, 0), (3, 1)]),
    ([0, 5], [(0, 1), (1, 0), (4, 0), (5, 1)]),
])
def test_minimal_fill(spark, hours, filled):
    assert shown(series.fill_minimal(points(spark, hours), Interval(1, "h"))) == filled


def test_full_fill(spark):
    got = shown(series.fill_all(points(spark, [0, 1, 4, 6]), Interval(1, "h")))
    assert got == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (6, 1)]


def test_fill_keeps_points_off_the_grid(spark):
    got = shown(series.fill_all(points(spark, [0, 3]), Interval(2, "h")))
    assert got == [(0, 1), (2, 0), (3, 1)]


def test_required_times(spark):
    both = points(spark, [0, 2]).unionByName(points(spark, [1]).withColumn("series", F.lit("r")))
    got = {(r["series"], (r["bucket"] - START) // HOUR): r["count"]
           for r in series.require_times(both, ["r", "s", "t"]).collect()}
    assert got == {**{("s", h): int(h != 1) for h in range(3)},
                   **{("r", h): int(h == 1) for h in range(3)}, **{("t", h): 0 for h in range(3)}}


def test_required_times_keep_unnamed_series(spark):
    got = series.require_times(points(spark, [0]), ["r"])
    assert sorted((r["series"], r["count"]) for r in got.collect()) == [("r", 0), ("s", 1)]


def test_edges_and_zeros(spark):
    window = TimeWindow(START, START + 5 * HOUR)
    got = series.pad_edges(points(spark, [1, 5]), window)
    assert sorted(((r["bucket"] - START) // HOUR, r["count"]) for r in got.collect()) == [
        (0, None), (1, 1), (5, 1)]
    filled = series.pad_edges(series.fill_all(points(spark, [1, 3]), Interval(1, "h")), window)
    kept = series.drop_zeros(filled)
    assert sorted((r["bucket"] - START) // HOUR for r in kept.collect()) == [0, 1, 3, 5]


def test_stacked_percent_of_an_empty_bucket(spark):
    got = series.stacked_percent(points(spark, [0], value=0)).first()
    assert got["percent"] is None


def test_trend(spark):
    rows = times(spark, "2024-01-02 00:00:00", "2024-01-02 12:00:00", "2024-01-03 00:00:00",
                 "2024-01-01 01:00:00", "2024-01-04 00:00:00")
    window = TimeWindow.of("2024-01-02", "2024-01-03")
    never = Query("never", F.col("ts") > F.lit("2024-01-02").cast("timestamp_ntz"))
    got = {r["query"]: tuple(r)[1:] for r in series.trend(
        rows, "ts", window, timedelta(days=1), [Query("all", match_all()), never]).collect()}
    assert got == {"all": (2, 1, 100.0), "never": (1, 0, None)}


def test_rank_of_a_hot_group(spark):
    rows = spark.range(2000).select(
        "id", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.lit(None)).alias("g"),
        F.floor(F.col("id") / 7).alias("t"))
    ranked = rank_in_group(rows, "g", F.floor(F.col("t") / 20), [F.col("t"), F.col("id")])
    got = sorted((r["g"] or "", r["rank"], r["id"]) for r in ranked.collect())
    want = []
    for group in ("hot", None):
        found = [i for i in range(2000) if ("hot" if i % 10 < 9 else None) == group]
        want += [(group or "", n, i) for n, i in enumerate(found, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("n", [3, 1200])
def test_top_per_group(spark, n):
    rows = spark.range(4000).select("id", (F.col("id") % 3).alias("g"))
    got = top_per_group(rows, ["g"], [F.col("id").desc()], n, rank="r").collect()
    assert {(r["g"], r["id"]) for r in got} == {
        (g, i) for g in range(3) for i in [i for i in range(3999, -1, -1) if i % 3 == g][:n]}
    assert {r["r"] for r in got} == set(range(1, n + 1))


@pytest.fixture(scope="module")
def hot(spark):
    """4000 rows; slice 3 holds a third of them, one group nine tenths, some slices are null."""
    third = F.when(F.col("id") % 3 == 0, 30).otherwise(F.floor(F.col("id") / 40))
    return spark.range(4000).select(
        "id", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.lit(None)).alias("g"),
        F.when(F.col("id") % 50 != 7, third).alias("t")).repartition(8)


def in_order(rows):
    return sorted(rows, key=lambda r: (r["t"] is not None, r["t"] or 0, r["id"]))


@pytest.mark.parametrize("n", [10, 1001, 1500, 3999, 9000])
def test_first_rows_by_slices(hot, n):
    got = first_rows(hot, F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], n).collect()
    assert [r["id"] for r in got] == [r["id"] for r in in_order(hot.collect())[:n]]


@pytest.mark.parametrize("n", [1001, 1500, 3999])
def test_top_per_group_by_slices(hot, n):
    got = top_per_group(hot, ["g"], [F.col("t"), F.col("id")], n, slice_by=F.floor(F.col("t") / 10))
    want = set()
    for group in ("hot", None):
        want |= {r["id"] for r in in_order([r for r in hot.collect() if r["g"] == group])[:n]}
    assert {r["id"] for r in got.collect()} == want and got.columns == hot.columns


def test_slices_out_of_reach_are_not_sorted(hot):
    found = first_rows(hot, F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], 1001)
    ranked = hot.sparkSession.read.parquet(found.inputFiles()[0].rsplit("/", 1)[0])
    slices = {r[0] for r in ranked.select(F.floor(F.col("t") / 10)).distinct().collect()}
    assert ranked.count() < hot.count() and slices == {None, 0, 1, 2, 3}


def test_multi_series_drops_what_is_no_number(spark):
    rows = spark.createDataFrame([(1, "1.5", "x"), (2, "NaN", "7"), (3, None, "8")],
                                 "at int, a string, b string")
    got = [tuple(r) for r in series.multi_series(rows, "at", ["a", "b"]).collect()]
    assert got == [(1, "a", 1.5), (2, "b", 7.0), (3, "b", 8.0)]


def test_a_hot_moment_is_spread_over_tasks(spark):
    """One group holds nine tenths of the rows, all at one time: no task ranks them all."""
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 10 < 9, "hot").otherwise("rare").alias("g"), F.lit(1).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_in_group(rows, "g", F.col("t"), [F.col("t"), F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = Counter("hot" if i % 10 < 9 else "rare" for i in range(20_000))
    got = ranked.groupBy("g").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {g: (1, n, n) for g, n in wanted.items()}
    path = re.search(r"file:(\S*/ranked-\w+/data)", ranked.inputFiles()[0])[1]
    parts = [r["count"] for r in spark.read.parquet(path).groupBy("_part").count().collect()]
    assert len(parts) >= 4 and max(parts) < 3 * 20_000 / len(parts)
