"""Queries for histograms, zero-filling, trends and raw series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from logscope.functions.intervals import Interval
from logscope.functions.times import floor_to, hour_number
from logscope.functions.windows import TimeWindow
from logscope.operators import series
from logscope.operators.facets import hits
from logscope.operators.predicates import Query, match_all, term
from logscope.operators.ranking import rank_in_group
from logscope.sources.tables import scan
from logscope.workload.registry import Tables, query

JANUARY = TimeWindow.of("2024-01-01 00:00:00", "2024-01-31 00:00:00")
MID_JANUARY = TimeWindow.of("2024-01-08 05:30:00", "2024-01-22 05:30:00")


@query("SRC-1 PRD-2 PRD-10 AGG-14 JOIN-4", """
SELECT 'errors' AS series, b AS bucket, count(event_id) AS count
FROM generate_series(TIMESTAMP '2024-01-08 05:30:00', TIMESTAMP '2024-01-21 05:30:00',
                     INTERVAL 1 DAY) s(b)
LEFT JOIN events ON ts >= b AND ts < b + INTERVAL 1 DAY AND event_type = 'error'
GROUP BY b
""")
def series_daily_errors(t: Tables) -> DataFrame:
    rows = scan(t.events, MID_JANUARY, max_span_days=None)
    errors = [Query("errors", term("event_type", "error"))]
    return series.histogram(rows, "ts", MID_JANUARY, Interval(1, "d"), errors)


@query("AGG-14 FN-7 FN-8", """
SELECT 'all' AS series, b AS bucket, count(event_id) AS count
FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 21:00:00', INTERVAL 3 HOUR) s(b)
LEFT JOIN events ON ts >= b AND ts < b + INTERVAL 3 HOUR AND ts <= TIMESTAMP '2024-01-31'
GROUP BY b
""")
def series_auto_histogram(t: Tables) -> DataFrame:
    # 30 days over 200 bars: 3.6 h a bar, which the ladder makes 3 h.
    return series.histogram(t.events, "ts", JANUARY, bars=200)


@query("AGG-15 SET-2", """
WITH s AS (SELECT b FROM generate_series(TIMESTAMP '2024-01-10 06:00:00',
             TIMESTAMP '2024-01-14 00:00:00', INTERVAL 7 HOUR) s(b) WHERE b < TIMESTAMP '2024-01-14')
SELECT q.series, b AS bucket, count(*) FILTER (ts IS NOT NULL AND
    CASE q.series WHEN 'errors' THEN event_type = 'error' ELSE value > 30 END) AS count
FROM (VALUES ('errors'), ('large')) q(series), s
LEFT JOIN events ON ts >= b AND ts < b + INTERVAL 7 HOUR
  AND ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-14'
GROUP BY q.series, b
""")
def series_per_query(t: Tables) -> DataFrame:
    window = TimeWindow.of("2024-01-10 06:00:00", "2024-01-14 00:00:00")
    return series.histogram(t.events, "ts", window, Interval(7, "h"), [
        Query("errors", term("event_type", "error")), Query("large", F.col("value") > 30)])


@query("AGG-16", """
SELECT 'all' AS series, b AS bucket, count(o_orderkey) AS count
FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH) s(b)
LEFT JOIN orders ON o_orderdate >= b AND o_orderdate < b + INTERVAL 1 MONTH
  AND o_orderdate <= TIMESTAMP '1999-01-01'
GROUP BY b
""")
def series_monthly_orders(t: Tables) -> DataFrame:
    window = TimeWindow.of("1995-01-01", "1999-01-01")
    return series.histogram(t.orders, "o_orderdate", window, Interval(1, "M"))


@query("AGG-16", """
WITH s AS (SELECT i, TIMESTAMP '1995-01-31' + to_months(CAST(2 * i AS INTEGER)) AS b,
           TIMESTAMP '1995-01-31' + to_months(CAST(2 * i + 2 AS INTEGER)) AS e FROM range(12) r(i))
SELECT 'all' AS series, b AS bucket, count(o_orderkey) AS count
FROM s LEFT JOIN orders ON o_orderdate >= b AND o_orderdate < e
  AND o_orderdate <= TIMESTAMP '1997-01-31'
GROUP BY b
""")
def series_month_ends(t: Tables) -> DataFrame:
    window = TimeWindow.of("1995-01-31", "1997-01-31")
    return series.histogram(t.orders, "o_orderdate", window, Interval(2, "M"))


@query("AGG-14 FN-7", """
SELECT 'all' AS series, b AS bucket, count(ts) AS count
FROM generate_series(TIMESTAMP '2024-01-10 06:00:00', TIMESTAMP '2024-01-10 06:00:44.9',
  INTERVAL 100 MILLISECOND) s(b)
LEFT JOIN events ON ts >= b AND ts < b + INTERVAL 100 MILLISECOND GROUP BY b
""")
def series_short_window(t: Tables) -> DataFrame:
    """A window so short that its automatic buckets are below one second."""
    window = TimeWindow.of("2024-01-10 06:00:00", "2024-01-10 06:00:45")
    return series.histogram(t.events, "ts", window)


@query("AGG-17 FN-9", """
SELECT 'urgent' AS series, b AS bucket, count(o_orderkey) AS count
FROM generate_series(1000, 500000, 4991) s(b)
LEFT JOIN orders ON o_totalprice >= b AND o_totalprice < b + 4991
  AND o_orderpriority = '1-URGENT'
GROUP BY b
UNION ALL SELECT 'all', b, count(o_orderkey)
FROM generate_series(1000, 500000, 4991) s(b)
LEFT JOIN orders ON o_totalprice >= b AND o_totalprice < b + 4991
GROUP BY b
""")
def series_price_ranges(t: Tables) -> DataFrame:
    # The gap is round((500000 - 1000) / 100) + 1.
    shown = [Query("urgent", term("o_orderpriority", "1-URGENT")), Query("all", match_all())]
    return series.range_histogram(t.orders, "o_totalprice", 1000, 500000, 4991, shown)


@query("AGG-18", "SELECT ts, event_id, value FROM events ORDER BY ts, event_id LIMIT 100000")
def series_raw_values(t: Tables) -> DataFrame:
    return series.raw_series(t.events, "ts", "value", ["event_id"])


@query("AGG-19 W-4", """
SELECT event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 500
""")
def series_raw_by_group(t: Tables) -> DataFrame:
    return series.raw_series_by_group(t.events, "ts", "value", "event_type", ["event_id"], 500)


@query("AGG-19 W-4", """
SELECT event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 1500
""")
def series_raw_by_group_salted(t: Tables) -> DataFrame:
    return series.raw_series_by_group(t.events, "ts", "value", "event_type", ["event_id"], 1500)


_TREND = """
WITH c AS (
  SELECT q.query,
    count(*) FILTER (hit AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27') AS now,
    count(*) FILTER (hit AND ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20') AS "then"
  FROM (
    SELECT 'errors' AS query, event_type = 'error' AS hit, ts FROM events
    UNION ALL SELECT 'huge', value > 100000, ts FROM events
    UNION ALL SELECT 'all', true, ts FROM events) q
  GROUP BY q.query)
SELECT query, now, "then", CASE WHEN "then" <> 0 THEN
  floor((now - "then") * 100.0::DOUBLE / "then" * 100 + 0.5) / 100 END AS percent FROM c
"""


def _trend_queries() -> list[Query]:
    return [
        Query("errors", term("event_type", "error")), Query("huge", F.col("value") > 100000),
        Query("all", match_all()),
    ]


@query("AGG-20 FN-11 JOIN-3", _TREND)
def series_trend(t: Tables) -> DataFrame:
    window = TimeWindow.of("2024-01-20", "2024-01-27")
    return series.trend(t.events, "ts", window, timedelta(days=7), _trend_queries())


@query("JOIN-3 FN-11", _TREND)
def series_trend_paired(t: Tables) -> DataFrame:
    window = TimeWindow.of("2024-01-20", "2024-01-27")
    parts = [hits(t.events.where(w.covers_half_open(F.col("ts"))), _trend_queries())
             for w in (window, window.earlier(timedelta(days=7)))]
    return series.pair_counts(*parts)


@query("AGG-31", """
SELECT o_orderkey, o_totalprice, o_custkey, o_orderpriority FROM orders
ORDER BY o_orderkey LIMIT 1000
""")
def chart_scatter(t: Tables) -> DataFrame:
    return series.scatter(t.orders, "o_totalprice", "o_custkey", "o_orderpriority", ["o_orderkey"])


@query("AGG-32 FN-26", """
SELECT l_shipdate AS axis, 'l_quantity' AS series, l_quantity AS value FROM lineitem
UNION ALL SELECT l_shipdate, 'l_tax', l_tax FROM lineitem
UNION ALL SELECT l_shipdate, 'code', TRY_CAST(nullif(l_returnflag || l_linenumber, 'A1') AS DOUBLE)
FROM lineitem WHERE TRY_CAST(l_returnflag || l_linenumber AS DOUBLE) IS NOT NULL
""")
def chart_multi_series(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("code", F.concat("l_returnflag", "l_linenumber"))
    return series.multi_series(rows, "l_shipdate", ["l_quantity", "l_tax", "code"],
                               key=["l_orderkey", "l_linenumber"])


# Zero-filling, over the counts by minute, which leave most minutes out.

def _sparse(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("event_type").alias("series"), floor_to(F.col("ts"), "MINUTE").alias("bucket"))
    return rows.groupBy("series", "bucket").agg(F.count(F.lit(1)).alias("count"))


_SPARSE = """WITH p AS (
  SELECT event_type AS series, date_trunc('minute', ts) AS bucket, count(*) AS count
  FROM events GROUP BY ALL)
"""


@query("W-1 FN-24", _SPARSE + """
, n AS (SELECT *, lag(bucket) OVER w AS prev, lead(bucket) OVER w AS next FROM p
        WINDOW w AS (PARTITION BY series ORDER BY bucket))
SELECT series, bucket, count FROM p
UNION (
  SELECT series, bucket + INTERVAL 1 MINUTE, 0 FROM n WHERE next > bucket + INTERVAL 1 MINUTE
  UNION
  SELECT series, bucket - INTERVAL 1 MINUTE, 0 FROM n WHERE prev < bucket - INTERVAL 1 MINUTE)
""")
def series_fill_minimal(t: Tables) -> DataFrame:
    return series.fill_minimal(_sparse(t), Interval(1, "m"))


@query("W-2", _SPARSE + """
, e AS (SELECT series, min(bucket) AS lo, max(bucket) AS hi FROM p GROUP BY series),
s AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS bucket FROM e)
SELECT s.series, s.bucket, coalesce(p.count, 0) AS count
FROM s LEFT JOIN p ON p.series = s.series AND p.bucket = s.bucket
""")
def series_fill_all(t: Tables) -> DataFrame:
    return series.fill_all(_sparse(t), Interval(1, "m"))


@query("W-6", _SPARSE + """
SELECT s.series, b.bucket, coalesce(p.count, 0) AS count
FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) s(series),
     (SELECT DISTINCT bucket FROM p) b
LEFT JOIN p ON p.series = s.series AND p.bucket = b.bucket
""")
def series_required_times(t: Tables) -> DataFrame:
    names = ["click", "error", "purchase", "signup", "view"]
    return series.require_times(_sparse(t), names)


@query("W-8", _SPARSE + """
, w AS (SELECT * FROM p WHERE bucket BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31')
SELECT series, bucket, CAST(count AS DOUBLE) AS count FROM w
UNION ALL SELECT series, TIMESTAMP '2024-01-01', NULL FROM w GROUP BY series
  HAVING min(bucket) > TIMESTAMP '2024-01-01'
UNION ALL SELECT series, TIMESTAMP '2024-01-31', NULL FROM w GROUP BY series
  HAVING max(bucket) < TIMESTAMP '2024-01-31'
""")
def series_pad_edges(t: Tables) -> DataFrame:
    padded = series.pad_edges(_sparse(t).where(JANUARY.covers(F.col("bucket"))), JANUARY)
    return padded.withColumn("count", F.col("count").cast("double"))


@query("W-9", _SPARSE + "SELECT series, bucket, count FROM p")
def series_drop_zeros(t: Tables) -> DataFrame:
    filled = series.require_times(_sparse(t), ["click", "error", "purchase", "signup", "view"])
    return series.drop_zeros(filled)


@query("W-5", """
WITH c AS (SELECT event_type AS series, date_trunc('day', ts) AS bucket, count(*) AS count
           FROM events GROUP BY ALL)
SELECT series, bucket, count,
       round(count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY bucket), 6) AS percent FROM c
""")
def series_stacked_percent(t: Tables) -> DataFrame:
    daily = t.events.groupBy(
        F.col("event_type").alias("series"), floor_to(F.col("ts"), "DAY").alias("bucket")
    ).agg(F.count(F.lit(1)).alias("count"))
    return series.stacked_percent(daily).withColumn("percent", F.round("percent", 6))


@query("W-7", """
SELECT event_id, event_type, ts,
       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events
""")
def series_rank_in_group(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "ts")
    return rank_in_group(rows, "event_type", hour_number(F.col("ts")),
                         [F.col("ts"), F.col("event_id")])
