"""Streams against their batch counterparts, over several micro-batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from logscope.functions.intervals import Interval
from logscope.functions.windows import TimeWindow
from logscope.operators import series
from logscope.operators.predicates import Query, match_all, term
from logscope.streaming import live

WINDOW = TimeWindow.of("2024-01-01 05:00:00", "2024-01-31 00:00:00")


def queries():
    return [Query("errors", term("event_type", "error")), Query("all", match_all())]


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """The events as five files in time order, oldest first."""
    folder = tmp_path_factory.mktemp("stream")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(5):
        low, high = f"2024-01-{1 + 6 * i:02d}", f"2024-01-{min(7 + 6 * i, 31):02d}"
        part = events.where(TimeWindow.of(low, high).covers_half_open(F.col("ts")))
        part.coalesce(1).write.mode("append").parquet(str(folder / "events"))
    return events, str(folder / "events")


def source(spark, batches):
    events, path = batches
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, tmp_path):
    live.run_available(live.table_sink(stream, str(tmp_path / "data"), str(tmp_path / "state")))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "data"))


def test_histogram_equals_batch_on_closed_buckets(spark, batches, tmp_path):
    got = run(spark, live.live_histogram(source(spark, batches), "ts", WINDOW, Interval(6, "h"), queries()),
              tmp_path)
    batch = series.histogram(batches[0], "ts", WINDOW, Interval(6, "h"), queries())
    newest = batches[0].agg(F.max("ts")).first()[0] - timedelta(hours=1)
    full = {b["bucket"] for b in batch.where("series = 'all' and count > 0").collect()}
    closed = {tuple(r) for r in batch.collect()
              if r["bucket"] + timedelta(hours=6) <= newest and r["bucket"] in full}
    assert {tuple(r) for r in got.collect()} == closed and len(closed) > 200


def test_streams_do_not_depend_on_the_session_zone(spark, batches, tmp_path):
    old = spark.conf.get("spark.sql.session.timeZone")
    counts = {}
    for zone in ("UTC", "America/St_Johns"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = live.live_histogram(source(spark, batches), "ts", WINDOW, Interval(1, "d"), queries())
            rows = run(spark, found, tmp_path / zone.replace("/", "-")).collect()
            counts[zone] = {tuple(r) for r in rows}
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)
    assert counts["UTC"] == counts["America/St_Johns"]
    assert {r[1].hour for r in counts["UTC"]} == {5}


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "id int, ts timestamp_ntz"
    folder = str(tmp_path / "in")
    stamps = ("2024-01-01 00:10", "2024-01-01 09:00", "2024-01-01 09:30", "2024-01-01 00:20",
              "2024-01-01 20:00")
    for stamp in stamps:
        spark.createDataFrame([(1, stamp)], "id int, t string").select(
            "id", F.col("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    window = TimeWindow.of("2024-01-01", "2024-01-02")
    got = run(spark, live.live_histogram(stream, "ts", window, Interval(1, "h"), [Query("all", match_all())]),
              tmp_path)
    # The fourth row lies behind the watermark by the time it comes.
    assert sorted((r["bucket"].hour, r["count"]) for r in got.collect()) == [(0, 1), (9, 2)]


def test_copies_over_batches(spark, batches, tmp_path):
    twice = source(spark, batches).unionByName(source(spark, batches))
    got = run(spark, live.without_copies(twice, ["event_id"], "ts", "2 days"), tmp_path)
    assert got.count() == batches[0].count()


def test_terms_are_replaced_by_each_version(spark, batches, tmp_path):
    found = live.live_terms(source(spark, batches), "event_type")
    live.run_available(live.result_sink(found, str(tmp_path / "out"), str(tmp_path / "state")))
    got = live.latest_result(spark, str(tmp_path / "out"), "value string, count bigint")
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    assert {tuple(r) for r in got.collect()} == {
        tuple(r) for r in batches[0].groupBy("event_type").count().collect()}


def test_day_sink(spark, batches, tmp_path):
    live.run_available(live.day_sink(source(spark, batches), "ts", str(tmp_path / "t"), str(tmp_path / "s")))
    days = {p.name for p in (tmp_path / "t").glob("day=*")}
    assert len(days) == 30 and "day=20240117" in days


def test_a_stopped_stream_goes_on(spark, batches, tmp_path):
    for _ in range(2):
        rows = live.since_stream(source(spark, batches), "ts", "2024-01-15")
        got = run(spark, rows, tmp_path)
    assert got.count() == batches[0].where("ts >= '2024-01-15'").count()


def test_calendar_buckets_are_refused(spark, batches):
    with pytest.raises(ValueError, match="fixed length"):
        live.live_histogram(source(spark, batches), "ts", WINDOW, Interval(1, "M"), queries())


def test_trend_over_closed_buckets(spark):
    rows = spark.createDataFrame(
        [("a", datetime(2024, 1, 2), 5), ("a", datetime(2024, 1, 1), 4), ("b", datetime(2024, 1, 2), 1),
         ("a", datetime(2024, 1, 3), 100)], "series string, t timestamp, count bigint"
    ).select("series", F.col("t").cast("timestamp_ntz").alias("bucket"), "count")
    got = live.trend_of_buckets(rows, TimeWindow.of("2024-01-02", "2024-01-03"), timedelta(days=1))
    assert {tuple(r) for r in got.collect()} == {("a", 5, 4, 25.0), ("b", 1, 0, None)}


def test_trend_moves_between_batches(spark, batches, tmp_path):
    """Each version is over the week up to the newest bucket closed by then."""
    seen, width = [], Interval(6, "h")
    counts = live.live_histogram(source(spark, batches), "ts", WINDOW, width, queries())
    original = live.trend_of_buckets

    def spy(buckets, window, ago):
        plan = buckets._jdf.queryExecution().executedPlan().toString()
        seen.append((window, "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1][:80]))
        return original(buckets, window, ago)

    live.trend_of_buckets = spy
    try:
        live.run_available(live.trend_sink(
            counts, str(tmp_path / "buckets"), str(tmp_path / "trend"), str(tmp_path / "state"),
            interval=width))
    finally:
        live.trend_of_buckets = original
    ends = [w.end for w, _ in seen]
    assert len(set(ends)) >= 3 and ends == sorted(ends) and all(pruned for _, pruned in seen)
    assert len(list((tmp_path / "trend").glob("batch=*"))) == 2
    final = live.latest_result(spark, str(tmp_path / "trend"),
                               "query string, now bigint, then bigint, percent double")
    now = seen[-1][0]
    events = [r["ts"] for r in batches[0].select("ts").collect()]
    want = sum(now.start <= t < now.end for t in events)
    assert {r["query"]: r["now"] for r in final.collect()}["all"] == want


def test_moving_hits_checks_its_durations(spark, batches):
    with pytest.raises(ValueError):
        live.moving_hits(source(spark, batches), "ts", "1 minute", "5 minutes")
    with pytest.raises(ValueError):
        live.moving_hits(source(spark, batches), "ts", "soon")


def test_stream_of_one_odd_file(spark, batches, tmp_path):
    folder = tmp_path / "odd"
    batches[0].coalesce(1).write.parquet(str(folder))
    part = next(folder.glob("part-*.parquet"))
    named = folder / "a[1]{x}.parquet"
    named.write_bytes(part.read_bytes())
    got = run(spark, live.stream_table(
        spark, str(named), batches[0].schema, bytes_per_trigger=1 << 20), tmp_path)
    assert got.count() == batches[0].count()
