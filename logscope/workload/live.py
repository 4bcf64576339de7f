"""Queries that run a stream over a whole table and return what it wrote."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from logscope.functions.intervals import Interval
from logscope.functions.windows import TimeWindow
from logscope.operators.predicates import Query, term
from logscope.scratch import scratch_path
from logscope.streaming import live
from logscope.workload.registry import Tables, query

WINDOW = TimeWindow.of("2024-01-01 05:00:00", "2024-01-31 00:00:00")


def _stream(t: Tables) -> DataFrame:
    return live.stream_table(t.spark, t.path("events"), t.events.schema)


def _work_off(t: Tables, name: str, make_writer, result: str | None = None) -> str:
    folder = scratch_path(t.spark, name)
    live.run_available(make_writer(f"{folder}/data", f"{folder}/checkpoint"))
    return f"{folder}/{result or 'data'}"


def _appended(t: Tables, name: str, stream: DataFrame) -> DataFrame:
    path = _work_off(t, name, lambda data, state: live.table_sink(stream, data, state))
    return t.spark.read.schema(stream.schema).parquet(path)


_QUERIES = [("errors", "error"), ("clicks", "click")]


@query("STR-1", """
WITH b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01 05:00:00') AS bucket,
                  event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01 05:00:00'),
c AS (SELECT bucket FROM b GROUP BY bucket HAVING bucket + INTERVAL 6 HOUR
        <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
SELECT 'errors' AS series, bucket, count(*) FILTER (event_type = 'error') AS count
FROM b JOIN c USING (bucket) GROUP BY bucket
UNION ALL SELECT 'clicks', bucket, count(*) FILTER (event_type = 'click')
FROM b JOIN c USING (bucket) GROUP BY bucket
""")
def stream_histogram(t: Tables) -> DataFrame:
    counts = live.live_histogram(
        _stream(t), "ts", WINDOW, Interval(6, "h"),
        [Query(name, term("event_type", kind)) for name, kind in _QUERIES])
    return _appended(t, "live-histogram", counts)


@query("STR-2", """
WITH m AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute FROM events),
w AS (SELECT minute + to_minutes(k) AS window_end FROM m, generate_series(1, 15) s(k))
SELECT window_end, count(*) AS hits FROM w
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY window_end
""")
def stream_moving_hits(t: Tables) -> DataFrame:
    return _appended(t, "moving-hits", live.moving_hits(_stream(t), "ts"))


@query("STR-2", """
WITH m AS (SELECT time_bucket(INTERVAL 2 MINUTE, ts) AS pane FROM events),
w AS (SELECT time_bucket(INTERVAL 4 MINUTE, pane) + to_minutes(k) AS window_end, pane
      FROM m, generate_series(2, 14, 2) s(k))
SELECT window_end, count(*) AS hits FROM w
WHERE epoch(window_end) % 240 = 120 AND pane < window_end AND pane >= window_end - INTERVAL 10 MINUTE
  AND window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY window_end
""")
def stream_moving_hits_uneven(t: Tables) -> DataFrame:
    """Windows whose step does not divide their length."""
    return _appended(t, "moving-hits-uneven", live.moving_hits(_stream(t), "ts", "10 minutes", "4 minutes"))


@query("STR-3", """
SELECT event_type AS value, count(*) AS count, min(value) AS min, max(value) AS max,
       round(avg(value), 6) AS mean, round(sum(value), 4) AS sum FROM events GROUP BY event_type
""")
def stream_terms(t: Tables) -> DataFrame:
    found = live.live_terms(_stream(t), "event_type", "value")
    path = _work_off(t, "live-terms", lambda data, state: live.result_sink(found, data, state))
    rows = live.latest_result(
        t.spark, path, "value string, count bigint, min double, max double, mean double, sum double")
    return rows.withColumns({"mean": F.round("mean", 6), "sum": F.round("sum", 4)})


@query("STR-4", """
SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'
""")
def stream_since(t: Tables) -> DataFrame:
    recent = live.since_stream(_stream(t), "ts", "2024-01-20 12:00:00")
    return _appended(t, "since", recent.select("event_id", "ts", "event_type"))


@query("STR-5", "SELECT * FROM events")
def stream_without_copies(t: Tables) -> DataFrame:
    twice = _stream(t).unionByName(_stream(t))
    return _appended(t, "without-copies", live.without_copies(twice, ["event_id"], "ts"))


@query("STR-6", """
SELECT event_id, ts, strftime(ts, '%Y%m%d') AS day FROM events
""")
def stream_day_sink(t: Tables) -> DataFrame:
    rows = _stream(t).select("event_id", "ts")
    path = _work_off(t, "day-sink", lambda data, state: live.day_sink(rows, "ts", data, state))
    return t.spark.read.schema("event_id bigint, ts timestamp_ntz, day string").parquet(path)


@query("STR-7", """
WITH c AS (
  SELECT query,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-20 05:00:00' AND ts < TIMESTAMP '2024-01-27 05:00:00') AS now,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-13 05:00:00' AND ts < TIMESTAMP '2024-01-20 05:00:00') AS "then"
  FROM (SELECT CASE event_type WHEN 'error' THEN 'errors' ELSE 'clicks' END AS query, ts
        FROM events WHERE event_type IN ('error', 'click')) GROUP BY query)
SELECT query, now, "then",
  floor((now - "then") * 100.0::DOUBLE / "then" * 100 + 0.5) / 100 AS percent FROM c
""")
def stream_trend(t: Tables) -> DataFrame:
    counts = live.live_histogram(
        _stream(t), "ts", WINDOW, Interval(6, "h"),
        [Query(name, term("event_type", kind)) for name, kind in _QUERIES])
    now = TimeWindow.of("2024-01-20 05:00:00", "2024-01-27 05:00:00")
    folder = scratch_path(t.spark, "live-trend")
    live.run_available(live.trend_sink(
        counts, f"{folder}/buckets", f"{folder}/trend", f"{folder}/checkpoint", now,
        timedelta(days=7)))
    return live.latest_result(
        t.spark, f"{folder}/trend", "query string, now bigint, then bigint, percent double")


@query("STR-7", """
WITH b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01 05:00:00') AS bucket,
                  event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01 05:00:00'),
c AS (SELECT bucket, event_type FROM b WHERE bucket + INTERVAL 6 HOUR
        <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
e AS (SELECT max(bucket) + INTERVAL 6 HOUR AS stop FROM c),
n AS (
  SELECT CASE event_type WHEN 'error' THEN 'errors' ELSE 'clicks' END AS query,
    count(*) FILTER (bucket >= stop - INTERVAL 7 DAY) AS now,
    count(*) FILTER (bucket < stop - INTERVAL 7 DAY AND bucket >= stop - INTERVAL 14 DAY) AS "then"
  FROM c, e WHERE event_type IN ('error', 'click') GROUP BY ALL)
SELECT query, now, "then",
  floor((now - "then") * 100.0::DOUBLE / "then" * 100 + 0.5) / 100 AS percent FROM n
""")
def stream_moving_trend(t: Tables) -> DataFrame:
    """The trend over the week up to the newest closed bucket."""
    width = Interval(6, "h")
    counts = live.live_histogram(
        _stream(t), "ts", WINDOW, width, [Query(name, term("event_type", kind)) for name, kind in _QUERIES])
    folder = scratch_path(t.spark, "moving-trend")
    live.run_available(live.trend_sink(
        counts, f"{folder}/buckets", f"{folder}/trend", f"{folder}/checkpoint", interval=width))
    return live.latest_result(
        t.spark, f"{folder}/trend", "query string, now bigint, then bigint, percent double")
