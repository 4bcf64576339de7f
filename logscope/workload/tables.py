"""Queries for sources, sinks, key lookups and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logscope.functions.text import shard_number
from logscope.functions.times import day_key, day_label, floor_to
from logscope.functions.windows import TimeWindow
from logscope.operators import export, joins, paging, sets
from logscope.operators.facets import hits, total
from logscope.operators.predicates import Query, match_all, term
from logscope.scratch import scratch_path
from logscope.sources import records, tables
from logscope.workload.registry import Tables, query

THREE_DAYS = TimeWindow.of("2024-01-10 06:30:00", "2024-01-13 06:30:00")
JANUARY = TimeWindow.of("2024-01-01 00:00:00", "2024-01-31 00:00:00")


def shard_label() -> Column:
    """A made-up shard label for an event: one shard an hour of the day."""
    return F.concat(F.lit("_shard"), (F.hour("ts") + 1).cast("string"))


def _day_table(t: Tables) -> str:
    return t.stored("events-by-day", ["events"],
                    lambda path: tables.write_by_day(t.events, path, mode="overwrite"))


def day_table(t: Tables) -> DataFrame:
    """``events`` laid out by day, written once a session."""
    schema = T.StructType([*t.events.schema.fields, T.StructField("day", T.StringType())])
    return tables.read_by_day(t.spark, _day_table(t), schema)


@query("SRC-1 SRC-2 SET-1", """
SELECT event_id, ts, event_type, strftime(ts, '%Y%m%d') AS day FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-13 06:30:00'
""")
def source_scan_days(t: Tables) -> DataFrame:
    rows = tables.scan(day_table(t), THREE_DAYS, max_span_days=5)
    return rows.select("event_id", "ts", "event_type", "day")


@query("SRC-1 AGG-1", """
SELECT count(*) AS hits FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-13 06:30:00'
  AND event_type = 'error'
""")
def source_scan_days_count(t: Tables) -> DataFrame:
    return total(tables.scan(day_table(t), THREE_DAYS, where=term("event_type", "error")))


@query("SRC-1 SNK-6", "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS count FROM events GROUP BY day")
def sink_day_table(t: Tables) -> DataFrame:
    """The layout by day, written anew: what a load costs, apart from the scans that follow."""
    path = scratch_path(t.spark, "events-by-day-anew")
    tables.write_by_day(t.events, path)
    return t.spark.read.schema("event_id bigint, day string").parquet(path).groupBy("day").agg(
        F.count(F.lit(1)).alias("count"))


@query("SRC-4", "SELECT DISTINCT 'tb_' || strftime(ts, '%Y%m%d') AS \"table\" FROM events")
def source_list_days(t: Tables) -> DataFrame:
    return tables.list_days(t.spark, _day_table(t))


@query("SRC-5 SET-3", """
SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' AND TIMESTAMP '2024-02-10 00:00:00'
""")
def source_days_with_data(t: Tables) -> DataFrame:
    wanted = TimeWindow.of("2024-01-20 12:00:00", "2024-02-10 00:00:00")
    found = tables.days_with_data(day_table(t), "ts", wanted)
    return found.select(F.col("day").cast("string").alias("day"))


@query("SRC-6", """
SELECT 'event_id' AS field, 'bigint' AS type, count(event_id) AS present FROM events
UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts) FROM events
UNION ALL SELECT 'user_id', 'bigint', count(user_id) FROM events
UNION ALL SELECT 'event_type', 'string', count(nullif(event_type, 'signup')) FROM events
UNION ALL SELECT 'value', 'double', count(value) FROM events
UNION ALL SELECT 'props', 'string', count(props) FROM events
""")
def source_field_catalogue(t: Tables) -> DataFrame:
    with_gaps = t.events.withColumn("event_type", F.nullif("event_type", F.lit("signup")))
    return tables.field_catalogue(with_gaps)


@query("SRC-7", """
SELECT event_id, ts, user_id, coalesce(nullif(event_type, 'signup'), '') AS event_type,
       value, coalesce(props, '') AS props FROM events
""")
def source_decode(t: Tables) -> DataFrame:
    raw = t.events.withColumn("event_type", F.nullif("event_type", F.lit("signup")))
    raw = raw.select(*(F.col(c).cast("string").alias(c) for c in raw.columns))
    return records.decode(raw, {
        "event_id": "long_n", "ts": "tdate", "user_id": "long_n", "event_type": "string",
        "value": "double_n", "props": "text_general",
    })


@query("SRC-8", """
SELECT event_id AS rowkey, ts AS "timestamp", user_id AS "Source_Ip",
       event_type AS "Http_Method", value, props FROM events
""")
def source_display_names(t: Tables) -> DataFrame:
    codes = t.events.withColumnsRenamed({
        "event_id": "rowkey", "ts": "ts", "user_id": "si", "event_type": "hm"})
    return records.with_display_names(codes, {
        "ts": "timestamp", "si": "Source_Ip", "di": "Destination_Ip", "hm": "Http_Method"})


@query("SRC-9", """
WITH k AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ms, minute(ts) AS task FROM events
), h AS (
  SELECT *, lpad(to_hex(ms), 16, '0') AS th, lpad(to_hex(task), 4, '0') AS kh FROM k
)
SELECT event_id, ms || '#' || task AS rowkey, ms AS key_time, CAST(task AS INTEGER) AS key_task,
       upper(substr(th, 15, 2) || substr(th, 13, 2) || substr(th, 11, 2) || substr(th, 9, 2)
       || substr(th, 7, 2) || substr(th, 5, 2) || substr(th, 3, 2) || substr(th, 1, 2) || kh)
         AS stored,
       ms || '#' || task AS restored
FROM h
""")
def source_row_key(t: Tables) -> DataFrame:
    keyed = t.events.select("event_id", records.row_key(F.col("ts"), F.minute("ts")).alias("rowkey"))
    stored = records.storage_key(F.col("rowkey"))
    return keyed.select(
        "event_id", "rowkey", records.row_key_time(F.col("rowkey")).alias("key_time"),
        records.row_key_task(F.col("rowkey")).alias("key_task"), stored.alias("stored"),
        records.from_storage_key(stored).alias("restored"),
    )


@query("SRC-10", """
WITH feed AS (
  SELECT event_id, value, 0 AS version FROM events
  UNION ALL
  SELECT event_id, value * 2, 1 FROM events WHERE event_type = 'purchase'
)
SELECT event_id, value, version FROM feed
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY version DESC) = 1
""")
def source_upsert(t: Tables) -> DataFrame:
    first = t.events.select("event_id", "value", F.lit(0).alias("version"))
    again = t.events.where(term("event_type", "purchase")).select(
        "event_id", (F.col("value") * 2).alias("value"), F.lit(1).alias("version"))
    return tables.latest_by_key(first.unionByName(again), ["event_id"], ["version"])


@query("SRC-10", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def source_latest_order(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return tables.latest_by_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("AGG-33 FN-27 SRT-11", """
SELECT strftime(ts, '%Y%m%d') AS day, CAST(hour(ts) + 1 AS INTEGER) AS shard,
       count(*) AS count
FROM events GROUP BY ALL
""")
def source_rows_per_partition(t: Tables) -> DataFrame:
    labelled = t.events.select(
        day_key(F.col("ts")).alias("day"), shard_number(shard_label()).alias("shard"))
    return tables.rows_per_partition(labelled, "day", "shard")


# Sinks: write, then read back what was written.

def _exported(t: Tables, df: DataFrame, kind: str, **options) -> DataFrame:
    path = scratch_path(t.spark, f"export-{kind}")
    export.export(df, path, kind, ceiling=None, **options)
    columns = options.get("columns") or df.columns
    reader = t.spark.read.schema(df.select(*columns).schema).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if kind == "csv":
        return reader.option("header", options.get("header", False)).option("escape", '"').csv(path)
    return reader.option("rowTag", "doc").xml(path) if kind == "xml" else reader.json(path)


@query("SNK-1", "SELECT * FROM events")
def sink_json(t: Tables) -> DataFrame:
    return _exported(t, t.events, "json")


@query("SNK-2 FN-15", "SELECT * FROM events")
def sink_csv(t: Tables) -> DataFrame:
    return _exported(t, t.events, "csv", header=True)


@query("SNK-3 FN-14", "SELECT * FROM events")
def sink_xml(t: Tables) -> DataFrame:
    return _exported(t, t.events, "xml")


@query("SNK-4", """
SELECT ceiling, (SELECT count(*) FROM lineitem) > ceiling AS refused
FROM (VALUES (CAST(1000 AS BIGINT)), (CAST(100000000 AS BIGINT))) v(ceiling)
""")
def sink_row_ceiling(t: Tables) -> DataFrame:
    """The test an export makes before it writes, below and above the table's size."""
    return reduce(DataFrame.unionByName, (
        export.over_ceiling(t.lineitem, n).select(F.lit(n).cast("bigint").alias("ceiling"), "refused")
        for n in (1000, 100_000_000)))


@query("SNK-5", "SELECT event_id, ts, event_type FROM events")
def sink_columns(t: Tables) -> DataFrame:
    return _exported(t, t.events, "json", columns=["event_id", "ts", "event_type"])


@query("SNK-6", "SELECT event_id, ts, value FROM events")
def sink_sorted(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "value")
    return _exported(t, rows, "csv", sort=[("value", "desc"), ("ts", "asc")], key=["event_id"])


# Key lookups.

@query("SRC-3 JOIN-1", """
SELECT o.o_orderkey, CAST(l.l_linenumber AS DOUBLE) AS l_linenumber, l.l_quantity, l.l_shipdate
FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') o
LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l.l_orderkey = o.o_orderkey
""")
def lookup_with_stubs(t: Tables) -> DataFrame:
    found = t.orders.where(term("o_orderpriority", "1-URGENT")).select("o_orderkey")
    stored = t.lineitem.where(term("l_returnflag", "R")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("double"), "l_quantity",
        "l_shipdate")
    return joins.look_up(found, stored, "o_orderkey")


@query("JOIN-2", """
SELECT o.o_orderkey, l.l_linenumber, l.l_quantity, l.l_shipdate
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
""")
def lookup_without_stubs(t: Tables) -> DataFrame:
    stored = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_shipdate")
    return joins.look_up(t.orders.select("o_orderkey"), stored, "o_orderkey", stubs=False)


@query("JOIN-6", """
SELECT event_id, user_id, event_type FROM events WHERE user_id IN (
  SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 5)
""")
def rows_of_top_terms(t: Tables) -> DataFrame:
    return joins.rows_of_top_terms(t.events, "user_id", 5).select("event_id", "user_id", "event_type")


@query("JOIN-6", """
WITH e AS (SELECT event_id, nullif(event_type, 'signup') AS kind FROM events)
SELECT event_id, kind FROM e WHERE kind IS NULL OR kind NOT IN (
  SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 2)
""")
def rows_of_other_terms(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.nullif("event_type", F.lit("signup")).alias("kind"))
    return joins.rows_of_other_terms(rows, "kind", 2).select("event_id", "kind")


# Set operations.

@query("SET-1", "SELECT event_id, value, event_type FROM events")
def set_union_tables(t: Tables) -> DataFrame:
    # Two tables of one layout: the events before and after the middle of the month.
    rows, middle = t.events.select("event_id", "value", "event_type", "ts"), F.lit("2024-01-16")
    early = F.col("ts") < middle.cast("timestamp_ntz")
    halves = [rows.where(early).drop("ts"), rows.where(~early | F.col("ts").isNull()).drop("ts")]
    return sets.union_tables(halves)


@query("SET-2", """
SELECT event_type AS query, user_id, count(*) AS count FROM events
WHERE event_type IN ('view', 'error') GROUP BY ALL
""")
def set_union_labelled(t: Tables) -> DataFrame:
    by_user = {
        kind: t.events.where(term("event_type", kind)).groupBy("user_id").count()
        for kind in ("view", "error")
    }
    return sets.union_labelled(by_user)


@query("SET-3", """
SELECT user_id FROM events WHERE event_type = 'purchase'
INTERSECT SELECT user_id FROM events WHERE event_type = 'error'
""")
def set_common(t: Tables) -> DataFrame:
    users = [t.events.where(term("event_type", k)).select("user_id") for k in ("purchase", "error")]
    return sets.common(*users)


@query("SET-4", """
SELECT DISTINCT date_trunc('hour', ts) AS bucket FROM events WHERE event_type IN ('view', 'error')
""")
def set_distinct_union(t: Tables) -> DataFrame:
    times = [
        t.events.where(term("event_type", k)).select(floor_to(F.col("ts"), "HOUR").alias("bucket"))
        for k in ("view", "error")
    ]
    return sets.distinct_union(times)


@query("SET-5", """
SELECT DISTINCT c_custkey AS custkey FROM customer
EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def set_difference(t: Tables) -> DataFrame:
    urgent = t.orders.where(term("o_orderpriority", "1-URGENT")).select(
        F.col("o_custkey").alias("custkey"))
    return sets.difference(t.customer.select(F.col("c_custkey").alias("custkey")), urgent)


@query("AGG-1 PRD-1", "SELECT count(*) AS hits FROM events")
def total_hits(t: Tables) -> DataFrame:
    return total(t.events, match_all())


@query("AGG-2 SET-2", """
SELECT * FROM (
  SELECT 'errors' AS query, count(*) FILTER (event_type = 'error') AS hits FROM events
  UNION ALL SELECT 'large', count(*) FILTER (value >= 50) FROM events
  UNION ALL SELECT 'all', count(*) FROM events),
  (SELECT count(*) FILTER (event_type = 'error') + count(*) FILTER (value >= 50) + count(*)
     AS total FROM events)
""")
def hits_per_query(t: Tables) -> DataFrame:
    return hits(t.events, [
        Query("errors", term("event_type", "error")), Query("large", F.col("value") >= 50),
        Query("all", match_all()),
    ])


@query("SRT-11 FN-4", """
SELECT 'tb_' || strftime(ts, '%Y%m%d') AS day, '_shard' || (hour(ts) + 1) AS shard, event_id
FROM events
""")
def rows_by_shard(t: Tables) -> DataFrame:
    rows = t.events.select(day_label(F.col("ts")).alias("day"), shard_label().alias("shard"), "event_id")
    return paging.by_shard(rows, "day", "shard", "event_id")
