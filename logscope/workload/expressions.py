"""Queries for the scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from logscope.functions import intervals, nested, numbers, text, times
from logscope.functions.intervals import Interval
from logscope.operators import flattening
from logscope.workload.registry import Tables, query


@query("FN-1", """
SELECT event_id, date_trunc('hour', ts) - INTERVAL 15 MINUTE AS quarter_before,
       date_trunc('month', ts + INTERVAL 2 MONTH) - INTERVAL 1 DAY AS month_end,
       date_trunc('year', ts) AS year_start,
       date_trunc('day', ts + INTERVAL 36 HOUR) + INTERVAL 5 MILLISECOND AS next_day
FROM events
""")
def fn_date_math(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        times.date_math(ts, [("round", "HOUR"), ("add", -15, "MINUTE")]).alias("quarter_before"),
        times.date_math(ts, [("add", 2, "MONTHS"), ("round", "MONTH"), ("add", -1, "DAY")]
                        ).alias("month_end"),
        times.date_math(ts, [("round", "YEAR")]).alias("year_start"),
        times.date_math(ts, [("add", 36, "HOURS"), ("round", "DATE"), ("add", 5, "MILLIS")]
                        ).alias("next_day"),
    )


@query("FN-2", "SELECT event_id, ts + INTERVAL 4 HOUR AS local_time FROM events")
def fn_local_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.to_zone(F.col("ts")).alias("local_time"))


@query("FN-3", """
SELECT event_id, date_diff('day', TIMESTAMP '2024-01-01 23:59:59', ts) AS days FROM events
""")
def fn_span_days(t: Tables) -> DataFrame:
    days = times.span_days(times.ntz("2024-01-01 23:59:59"), F.col("ts"))
    return t.events.select("event_id", days.cast("bigint").alias("days"))


@query("FN-4 FN-5", """
SELECT event_id, 'tb_' || strftime(ts, '%Y%m%d') AS label,
  'tb_' || strftime(ts + INTERVAL 1 DAY, '%Y%m%d') AS next,
  'tb_' || strftime(ts - INTERVAL 1 DAY, '%Y%m%d') AS previous,
  CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'tb_' || strftime(ts, '%Y%m%d')
       ELSE 'tb_' || strftime(ts + INTERVAL 1 DAY, '%Y%m%d') END AS capped
FROM events
""")
def fn_day_labels(t: Tables) -> DataFrame:
    label = times.day_label(F.col("ts"))
    return t.events.select(
        "event_id", label.alias("label"), times.neighbor_day_label(label).alias("next"),
        times.neighbor_day_label(label, -1).alias("previous"),
        times.neighbor_day_label(label, 1, F.lit("tb_20240120")).alias("capped"),
    )


@query("FN-6", """
SELECT event_id, CAST(user_id AS DOUBLE) * CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 60
  WHEN 'purchase' THEN 604800 WHEN 'view' THEN 2592000 END AS seconds FROM events
""")
def fn_interval_seconds(t: Tables) -> DataFrame:
    unit = F.create_map(*(F.lit(v) for pair in (
        ("click", "s"), ("error", "m"), ("purchase", "w"), ("view", "M"), ("signup", " none")
    ) for v in pair))[F.col("event_type")]
    written = F.concat(F.col("user_id").cast("string"), unit)
    return t.events.select("event_id", intervals.interval_seconds(written).cast("double").alias("seconds"))


# The width ladder of ``functions.intervals``, restated.
@query("FN-7", """
WITH s AS (SELECT event_type, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS span FROM events
           GROUP BY event_type)
SELECT event_type, span, CAST(CASE
  WHEN span / 100 <= 500 THEN 100 WHEN span / 100 <= 5000 THEN 1000
  WHEN span / 100 <= 7500 THEN 5000 WHEN span / 100 <= 15000 THEN 10000
  WHEN span / 100 <= 45000 THEN 30000 WHEN span / 100 <= 180000 THEN 60000
  WHEN span / 100 <= 450000 THEN 300000 WHEN span / 100 <= 1200000 THEN 600000
  WHEN span / 100 <= 2700000 THEN 1800000 WHEN span / 100 <= 7200000 THEN 3600000
  WHEN span / 100 <= 21600000 THEN 10800000 WHEN span / 100 <= 86400000 THEN 43200000
  WHEN span / 100 <= 604800000 THEN 86400000 WHEN span / 100 <= 1814400000 THEN 604800000
  WHEN span / 100 < 3628800000 THEN 2592000000 ELSE 31536000000 END AS BIGINT) AS width FROM s
""")
def fn_auto_width(t: Tables) -> DataFrame:
    spans = t.events.groupBy("event_type").agg(
        F.floor((times.epoch_micros(F.max("ts")) - times.epoch_micros(F.min("ts"))) / 1000).alias("span"))
    return spans.withColumn("width", intervals.auto_width_ms(F.col("span")))


@query("FN-8", """
SELECT event_id, CASE WHEN s >= 31536000 THEN (s // 31536000) || 'y' WHEN s >= 86400 THEN
  (s // 86400) || 'd' WHEN s >= 3600 THEN (s // 3600) || 'h' WHEN s >= 60 THEN (s // 60) || 'm'
  WHEN s > 0 THEN s || 's' ELSE 'less then a second' END AS text
FROM (SELECT event_id, CAST(floor(value * value * 200) AS BIGINT) AS s FROM events)
""")
def fn_duration_text(t: Tables) -> DataFrame:
    seconds = F.floor(F.col("value") * F.col("value") * 200)
    return t.events.select("event_id", intervals.duration_text(seconds).alias("text"))


@query("FN-9", """
SELECT o_orderpriority, CAST(floor((max(o_totalprice) - min(o_totalprice)) / 100 + 0.5) + 1 AS BIGINT)
  AS gap FROM orders GROUP BY o_orderpriority
""")
def fn_numeric_gap(t: Tables) -> DataFrame:
    bounds = t.orders.groupBy("o_orderpriority").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return bounds.select("o_orderpriority", numbers.numeric_gap(F.col("lo"), F.col("hi")).alias("gap"))


@query("FN-10", """
SELECT event_id, CASE WHEN user_id <> 0 THEN floor(event_id / user_id * 10000) / 100 END AS percent
FROM events
""")
def fn_percent(t: Tables) -> DataFrame:
    share = numbers.percent_of(F.col("event_id"), F.col("user_id"))
    return t.events.select("event_id", share.alias("percent"))


@query("FN-11", """
SELECT event_id, CASE WHEN user_id <> 0 THEN
  floor((event_id - user_id) * 100.0::DOUBLE / user_id * 100 + 0.5) / 100 END AS change FROM events
""")
def fn_percent_change(t: Tables) -> DataFrame:
    change = numbers.percent_change(F.col("user_id"), F.col("event_id"))
    return t.events.select("event_id", change.alias("change"))


@query("FN-12", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "a.list", json_extract_string(props, '$.k') AS "a.one",
  '{"n":' || json_extract_string(props, '$.k') || '}, {"n":2}' AS "b",
  '[' || json_extract_string(props, '$.k') || ',1.0]' AS "c" FROM events
""")
def fn_flatten_json(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    document = F.concat(
        F.lit('{"c":['), k, F.lit(',1.0],"b":[{"n":'), k, F.lit('},{"n":2}],"a":{"one":['), k,
        F.lit('],"list":'), k, F.lit("}}"))
    numbers_, objects = T.ArrayType(T.DecimalType(9, 0)), T.ArrayType(T.StructType().add("n", T.LongType()))
    schema = T.StructType().add("c", T.ArrayType(T.DecimalType(9, 1))).add("b", objects).add(
        "a", T.StructType().add("one", numbers_).add("list", T.LongType()))
    flat = nested.flatten_json(t.events.withColumn("doc", document), "doc", schema, keep=("event_id",))
    return flat.withColumn("c", F.regexp_replace("c", r"\[(\d+)\.0,", "[$1,"))


@query("FN-12", """
WITH e AS (SELECT event_id, event_id % 3 AS kind, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE kind WHEN 0 THEN k WHEN 2 THEN '[' || k || ',2]' END AS "a",
  CASE kind WHEN 1 THEN k END AS "a.b", CASE kind WHEN 1 THEN k END AS "a.c",
  CASE kind WHEN 1 THEN '{"n":' || k || '}, {"n":2}' WHEN 2 THEN '[]' END AS "list",
  CASE kind WHEN 0 THEN 'x' END AS "t", CASE kind WHEN 2 THEN 'y' END AS "t.u" FROM e
""")
def fn_flatten_any_json(t: Tables) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    document = F.when(kind == 0, F.concat(F.lit('{"a":'), k, F.lit(',"t":"x"}'))).when(kind == 1, F.concat(
        F.lit('{"a":{"b":'), k, F.lit(',"c":['), k, F.lit(']},"list":[{"n":'), k, F.lit('},{"n":2}],"gone":null}')),
    ).otherwise(F.concat(F.lit('{"a":['), k, F.lit(',2],"list":[],"t":{"u":"y"}}')))
    return flattening.flatten_any_json(t.events.withColumn("doc", document), "doc", keep=("event_id",))


@query("FN-13", """
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent,
       CAST(user_id AS VARCHAR) AS deep FROM events
""")
def fn_value_at(t: Tables) -> DataFrame:
    deep = F.concat(F.lit('{"a":{"b":[0,1,{"c":'), F.col("user_id").cast("string"), F.lit("}]}}"))
    return t.events.select(
        "event_id", nested.value_at(F.col("props"), "k").alias("k"),
        nested.value_at(F.col("props"), "a.b[2].c").alias("absent"),
        nested.value_at(deep, "a.b[2].c").alias("deep"),
    )


@query("FN-14", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages
""")
def fn_xml_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.xml_escape(F.col("html")).alias("escaped"))


@query("FN-15", """
SELECT doc_id, CASE WHEN contains(text, ',') THEN '"' || replace(text, '"', '""') || '"' ELSE text END
  AS quoted FROM documents
""")
def fn_csv_quote(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.csv_quote(F.col("text")).alias("quoted"))


@query("FN-16", r"""
SELECT doc_id, replace(replace(
    regexp_replace(regexp_replace(text,
      '(^|[^\p{L}\p{N}])((?i)the|for)($|[^\p{L}\p{N}])', '\1ʬ\2ʭ\3', 'g'),
      '(^|[^\p{L}\p{N}])((?i)the|for)($|[^\p{L}\p{N}])', '\1ʬ\2ʭ\3', 'g'),
    'ʬ', '<em>'), 'ʭ', '</em>') AS highlight FROM documents
""")
def fn_highlight(t: Tables) -> DataFrame:
    marked = text.highlight(F.col("text"), ["the", "for"])
    return t.documents.select("doc_id", marked.alias("highlight"))


@query("FN-17", """
SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS snippet
FROM documents
""")
def fn_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.snippet(F.col("text"), 120, 3).alias("snippet"))


@query("FN-18", """
SELECT event_id, strftime(ts, '%H:%M:%S') AS by_second, strftime(ts, '%H:%M<br>%m/%d') AS by_hour,
       strftime(ts, '%m/%d/%y') AS by_day, strftime(ts, '%m/%y') AS by_year FROM events
""")
def fn_time_text(t: Tables) -> DataFrame:
    widths = {"by_second": (30, "s"), "by_hour": (1, "h"), "by_day": (7, "d"), "by_year": (1, "y")}
    return t.events.select("event_id", *(
        intervals.time_text(F.col("ts"), Interval(*w)).alias(name) for name, w in widths.items()))


@query("FN-19", """
SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS large,
  format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS price FROM orders
""")
def fn_thousands(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", numbers.thousands(F.col("o_orderkey") * 1000).alias("large"),
        numbers.thousands(F.floor("o_totalprice")).alias("price"))


@query("FN-19", """
SELECT o_orderkey, format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)) || regexp_replace(
  substr(printf('%.2f', o_totalprice), -3), '\\.?0*$', '') AS price FROM orders
""")
def fn_thousands_decimals(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", numbers.thousands(F.round("o_totalprice", 2)).alias("price"))


@query("FN-20", """
SELECT event_id, CAST(user_id - 90 AS DOUBLE) AS lat,
       CASE WHEN event_type <> 'error' THEN CAST(value AS DOUBLE) END AS lon FROM events
""")
def fn_lat_lon(t: Tables) -> DataFrame:
    lon = F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise("none")
    point = F.concat_ws(",", (F.col("user_id") - 90).cast("string"), lon)
    return t.events.select("event_id", numbers.latitude(point).alias("lat"),
                           numbers.longitude(point).alias("lon"))


@query("FN-23 FN-24", """
SELECT event_id, date_trunc('second', ts) AS second, ts + INTERVAL 10 MINUTE AS later,
       ts - INTERVAL 1 MONTH AS month_before, ts + INTERVAL 1 YEAR AS year_after FROM events
""")
def fn_time_steps(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id", times.floor_second(ts).alias("second"), Interval(10, "m").shift(ts).alias("later"),
        Interval(1, "M").shift(ts, -1).alias("month_before"),
        Interval(1, "y").shift(ts).alias("year_after"))


def _links(df: DataFrame, key: str, column: str) -> DataFrame:
    found = F.map_from_arrays(
        F.array(*(F.lit(kind) for kind in text.LINK_PATTERNS)),
        F.array(*(text.links(F.col(column), kind) for kind in text.LINK_PATTERNS)))
    return df.select(key, F.explode(found).alias("kind", "links")).select(
        key, "kind", F.explode("links").alias("link"))


# The link patterns of ``functions.text``, restated; literal cases with links
# written by hand are in the tests.
_LINKS = r"""
SELECT {key}, 'url' AS kind, unnest(regexp_extract_all({text},
  '(?i)\b(?:https?|ftp)://[-A-Z0-9+&@#/%?=~_|!:,.;]*[-A-Z0-9+&@#/%=~_|*]')) AS link FROM {table}
UNION ALL SELECT {key}, 'host', unnest(regexp_extract_all({text},
  '(?i)(?:^|[^/])(www\.\S+)\b', 1)) FROM {table}
UNION ALL SELECT {key}, 'mail', unnest(regexp_extract_all({text},
  '[a-zA-Z_0-9.]+@[a-zA-Z_0-9.]+')) FROM {table}
"""


@query("FN-25", _LINKS.format(key="doc_id", text="text", table="documents"))
def fn_links_in_documents(t: Tables) -> DataFrame:
    return _links(t.documents, "doc_id", "text")


@query("FN-25", _LINKS.format(key="page_id", text="html", table="pages"))
def fn_links_in_pages(t: Tables) -> DataFrame:
    return _links(t.pages, "page_id", "html")


@query("FN-26", """
SELECT l_orderkey, TRY_CAST(code AS DOUBLE) AS number
FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'x' ELSE '' END
             || CAST(l_quantity AS VARCHAR) AS code FROM lineitem)
WHERE TRY_CAST(code AS DOUBLE) IS NOT NULL
""")
def fn_to_number(t: Tables) -> DataFrame:
    code = F.concat(F.when(F.col("l_returnflag") == "R", "x").otherwise(""),
                    F.col("l_quantity").cast("string"))
    return t.lineitem.select("l_orderkey", numbers.to_number(code).alias("number")).where(
        F.col("number").isNotNull())


@query("FN-22", """
SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ())
  / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) * 10, 6) AS scaled FROM orders
""")
def fn_rescale(t: Tables) -> DataFrame:
    bounds = t.orders.agg(F.struct(F.min("o_totalprice").alias("lo"),
                                   F.max("o_totalprice").alias("hi"))).scalar()
    scaled = numbers.rescale(F.col("o_totalprice"), bounds["lo"], bounds["hi"])
    return t.orders.select("o_orderkey", F.round(scaled, 6).alias("scaled"))


@query("FN-28", """
SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":'
  || user_id || '}' AS json FROM events
""")
def fn_row_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.row_json("event_id", "event_type", "user_id").alias("json"))


@query("FN-29 FN-30", r"""
SELECT doc_id, array_to_string(list_sort(ws), ' ') AS sorted,
       array_to_string(list_sort(ws)[2:4], ' ') AS part
FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
      FROM documents)
""")
def fn_sorted_list(t: Tables) -> DataFrame:
    ordered = F.array_sort(text.words(F.col("text")))
    return t.documents.select("doc_id", F.array_join(ordered, " ").alias("sorted"),
                              F.array_join(F.slice(ordered, 2, 3), " ").alias("part"))
