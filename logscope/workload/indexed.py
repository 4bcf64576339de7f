"""Queries answered from tables kept beside the logs: indexes, counters, sketches, layouts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F, types as T

from logscope.functions.intervals import Interval
from logscope.functions.windows import TimeWindow
from logscope.operators import heavy
from logscope.operators.joins import look_up
from logscope.operators.predicates import term
from logscope.plans.search import SearchPage, search
from logscope.scratch import scratch_path
from logscope.sources.bucketed import open_bucketed, write_bucketed
from logscope.sources.catalogue import put_catalogue, read_catalogue
from logscope.sources.geo_layout import in_placed_box, write_by_place
from logscope.sources.page_index import PageIndex, open_pages, write_pages
from logscope.sources.postings import TextIndex, open_index, write_index
from logscope.sources.rollups import Rollup, Term, put_counters
from logscope.sources.upserts import UpsertTable, upsert_sink
from logscope.streaming.live import run_available, stream_table
from logscope.workload import facets, filters  # noqa: F401  (their queries must be registered first)
from logscope.workload.registry import REGISTRY, Tables, query
from logscope.workload.tables import day_table


def _sql(name: str) -> str:
    """The SQL of the query that scans: both must give the same rows."""
    return REGISTRY[name].sql


def _index(t: Tables, table: str, key: list[str], fields: list[str], stop_words=()) -> TextIndex:
    df = getattr(t, table)
    path = t.stored("-".join(["index", table, *fields, *stop_words]), [table], lambda path: write_index(
        df, path, key, fields, stop_words=stop_words, mode="overwrite"))
    return open_index(t.spark, path, [df.schema[k] for k in key])


def _documents(t: Tables) -> TextIndex:
    return _index(t, "documents", ["doc_id"], ["text", "lang", "source"])


@query("PRD-3", _sql("filter_phrase_url").replace("SELECT page_id, url FROM w", "SELECT page_id FROM w"))
def index_phrase_url(t: Tables) -> DataFrame:
    return _index(t, "pages", ["page_id"], ["url"]).phrase("url", "example.com")


@query("PRD-3 PRD-4", _sql("filter_phrase_stop_words"))
def index_phrase_stop_words(t: Tables) -> DataFrame:
    return _index(t, "documents", ["doc_id"], ["text"], ("the", "a")).phrase("text", "of the and")


@query("PRD-6", _sql("filter_all_words"))
def index_all_words(t: Tables) -> DataFrame:
    return _documents(t).all_words("text", "the OF and")


@query("PRD-5", _sql("filter_any_field_word"))
def index_any_field_word(t: Tables) -> DataFrame:
    return _index(t, "conversations", ["conv_id", "turn"], ["text", "role"]).any_field_word(
        ["text", "role"], "user")


@query("PRD-5", _sql("filter_catch_all_list"))
def index_catch_all(t: Tables) -> DataFrame:
    return _documents(t).any_field_word(["text", "lang", "source"], "the EN")


@query("PRD-22", _sql("filter_synonyms"))
def index_synonyms(t: Tables) -> DataFrame:
    return _documents(t).words_or_synonyms("text", "house of", {"house": ["The", "la"], "of": ["de"]})


def _search(t: Tables) -> SearchPage:
    return search(t.documents, "text", "the of", key=["doc_id"], facet_fields=["lang", "source"],
                  sort=[("n_chars", "desc")], number=1, size=10, facet_limit=5, snippet_length=80,
                  index=_documents(t))


@query("AGG-34", _sql("search_total"))
def index_search_total(t: Tables) -> DataFrame:
    return _search(t).total


@query("AGG-34 SRT-7", _sql("search_rows"))
def index_search_rows(t: Tables) -> DataFrame:
    return _search(t).rows


@query("AGG-34 AGG-7", _sql("search_facets"))
def index_search_facets(t: Tables) -> DataFrame:
    return _search(t).facets


# Top values by a bounded sketch.

@query("AGG-3", _sql("facet_terms"))
def sketch_terms(t: Tables) -> DataFrame:
    return heavy.terms(t.events, "user_id", 10)


@query("AGG-4", """
WITH c AS (SELECT l_partkey AS value, count(*) AS n FROM lineitem GROUP BY l_partkey),
top AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 15)
SELECT 'term' AS kind, CAST(value AS DOUBLE) AS value, n AS count FROM top
UNION ALL SELECT 'missing', NULL, 0
UNION ALL SELECT 'other', NULL, (SELECT count(*) FROM lineitem) - (SELECT CAST(sum(n) AS BIGINT) FROM top)
""")
def sketch_terms_with_rest(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").cast("double"))
    return heavy.terms_with_rest(rows, "l_partkey", 15)


@query("AGG-9 FN-22", _sql("facet_tag_cloud"))
def sketch_tag_cloud(t: Tables) -> DataFrame:
    cloud = heavy.tag_cloud(t.documents, "text", 20, stop_words=["the"])
    return cloud.withColumn("size", F.round("size", 6))


# Pages of any number from a table in order.

def _pages(t: Tables) -> PageIndex:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    path = t.stored("pages-of-lineitem", ["lineitem"], lambda path: write_pages(
        rows, path, [("l_extendedprice", "desc")], ["l_orderkey", "l_linenumber", "l_shipdate"],
        "l_shipdate", mode="overwrite"))
    return open_pages(t.spark, path, rows.schema)


_PRICED = """SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_shipdate
"""


@query("SRT-7", _PRICED + "LIMIT 50 OFFSET 5000")
def page_by_index(t: Tables) -> DataFrame:
    return _pages(t).page(100, 50)


@query("SRT-7 SRT-9", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
QUALIFY row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_shipdate)
  > ((SELECT count(*) FROM lineitem) - 1) // 40 * 40
""")
def page_last_by_index(t: Tables) -> DataFrame:
    return _pages(t).last_page(40)


# Counters by minute.

def _rollup(t: Tables) -> Rollup:
    fields = ("event_type", "user_id")
    path = t.stored("events-by-minute", ["events"], lambda path: put_counters(t.events, path, "ts", fields))
    return Rollup(t.spark, path, day_table(t), "ts", fields)


_ODD = TimeWindow.of("2024-01-05 03:10:00", "2024-01-12 17:45:20.5")


@query("AGG-14 AGG-15", """
WITH b AS (SELECT * FROM generate_series(TIMESTAMP '2024-01-05 03:10:00', TIMESTAMP '2024-01-12 17:45:20.5',
    INTERVAL 90 MINUTE) g(bucket)),
q(series) AS (VALUES ('all'), ('errors'), ('user 7')),
e AS (SELECT time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '2024-01-05 03:10:00') AS bucket, * FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:10:00' AND TIMESTAMP '2024-01-12 17:45:20.5')
SELECT q.series, b.bucket, count(e.event_id) FILTER (q.series = 'all' OR q.series = 'errors' AND event_type = 'error'
  OR q.series = 'user 7' AND user_id = 7) AS count
FROM q CROSS JOIN b LEFT JOIN e USING (bucket) GROUP BY q.series, b.bucket
""")
def rollup_histogram(t: Tables) -> DataFrame:
    return _rollup(t).histogram(_ODD, Interval.parse("90m"), [
        Term("all"), Term("errors", "event_type", "error"), Term("user 7", "user_id", "7")])


_CUT = TimeWindow.of("2024-01-20 00:10:30.25", "2024-01-26 13:00:59")


@query("JOIN-3 AGG-20 FN-11", """
WITH c AS (SELECT q.query,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-20 00:10:30.25' AND ts < TIMESTAMP '2024-01-26 13:00:59') AS now,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-13 00:10:30.25' AND ts < TIMESTAMP '2024-01-19 13:00:59') AS "then"
  FROM events JOIN (VALUES ('errors'), ('all'), ('nobody')) q(query)
    ON q.query = 'all' OR q.query = 'errors' AND event_type = 'error' OR q.query = 'nobody' AND ts IS NULL
  GROUP BY q.query UNION ALL SELECT 'nobody', 0, 0)
SELECT query, now, "then", CASE WHEN "then" <> 0 THEN
  floor((now - "then") * 100.0::DOUBLE / "then" * 100 + 0.5) / 100 END AS percent FROM c
""")
def rollup_trend(t: Tables) -> DataFrame:
    return _rollup(t).trend(_CUT, timedelta(days=7), [
        Term("errors", "event_type", "error"), Term("all"), Term("nobody", "user_id", "-1")])


@query("AGG-2 AGG-1", """
SELECT 'all' AS query, count(*) AS hits FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:10:00' AND TIMESTAMP '2024-01-12 17:45:20.5'
UNION ALL SELECT 'clicks', count(*) FROM events WHERE event_type = 'click'
AND ts BETWEEN TIMESTAMP '2024-01-05 03:10:00' AND TIMESTAMP '2024-01-12 17:45:20.5'
""")
def rollup_hits(t: Tables) -> DataFrame:
    return _rollup(t).hits(_ODD, [Term("all"), Term("clicks", "event_type", "click")])


@query("AGG-3", """
SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 03:10:00' AND TIMESTAMP '2024-01-12 17:45:20.5'
GROUP BY user_id ORDER BY count DESC, value LIMIT 10
""")
def rollup_terms(t: Tables) -> DataFrame:
    return _rollup(t).terms("user_id", _ODD)


# Stored tables: upserts, and records in buckets.

def _event_table(t: Tables, name: str) -> UpsertTable:
    schema = T.StructType([*(t.events.schema[c] for c in ("event_id", "ts", "value")),
                           T.StructField("version", T.IntegerType())])
    return UpsertTable(t.spark, scratch_path(t.spark, name), schema, ("event_id",), ("version",), "ts", parts=8)


@query("SRC-10", _sql("source_upsert"))
def source_upsert_stored(t: Tables) -> DataFrame:
    table = _event_table(t, "upserts")
    first = t.events.select("event_id", "ts", "value", F.lit(0).alias("version"))
    again = t.events.where(term("event_type", "purchase")).select(
        "event_id", "ts", (F.col("value") * 2).alias("value"), F.lit(1).alias("version"))
    # The feed comes twice, and an older one after it: neither changes anything.
    for feed in (first, again, again, first):
        table.merge(feed)
    return table.rows().select("event_id", "value", "version")


@query("SRC-10 STR-5", "SELECT event_id, value, strftime(ts, '%Y%m%d') AS day FROM events")
def stream_upsert(t: Tables) -> DataFrame:
    table = _event_table(t, "stream-upserts")
    feed = stream_table(t.spark, t.path("events"), t.events.schema).select(
        "event_id", "ts", "value", F.lit(0).alias("version"))
    # Two deliveries of all files, as after a restart that lost its checkpoint.
    for number in range(2):
        run_available(upsert_sink(feed, table, scratch_path(t.spark, f"upsert-checkpoint-{number}")))
    return table.rows().select("event_id", "value", "day")


@query("SRC-3 JOIN-1", _sql("lookup_with_stubs"))
def lookup_hot_records(t: Tables) -> DataFrame:
    found = t.orders.where(term("o_orderpriority", "1-URGENT")).select("o_orderkey")
    stored = t.lineitem.where(term("l_returnflag", "R")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("double"), "l_quantity",
        "l_shipdate")
    return look_up(found, stored, "o_orderkey", hot_records=True)


@query("SRC-3 JOIN-1", _sql("lookup_with_stubs"))
def lookup_bucketed(t: Tables) -> DataFrame:
    path = t.stored("lineitem-by-order", ["lineitem"],
                    lambda path: write_bucketed(t.lineitem, path, "l_orderkey", 16))
    stored = open_bucketed(t.spark, path, t.lineitem.schema, "l_orderkey", 16).where(
        term("l_returnflag", "R")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("double"), "l_quantity",
        "l_shipdate")
    found = t.orders.where(term("o_orderpriority", "1-URGENT")).select("o_orderkey")
    return look_up(found, stored, "o_orderkey")


# The catalogue kept by day, and points laid out by place.

@query("SRC-6", """
SELECT field, type, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-11') AS rows, present FROM (
  SELECT 'event_id' AS field, 'bigint' AS type, count(event_id) AS present FROM events WHERE ts < TIMESTAMP '2024-01-11'
  UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts) FROM events WHERE ts < TIMESTAMP '2024-01-11'
  UNION ALL SELECT 'event_type', 'string', count(nullif(event_type, 'signup')) FROM events WHERE ts < TIMESTAMP '2024-01-11'
  UNION ALL SELECT 'value', 'double', count(value) FROM events WHERE ts < TIMESTAMP '2024-01-11')
""")
def source_catalogue_by_day(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", F.nullif("event_type", F.lit("signup")).alias("event_type"), "value")
    path = t.stored("catalogue", ["events"], lambda path: put_catalogue(rows, path, "ts"))
    return read_catalogue(t.spark, path, ("20240101", "20240110")).select("field", "type", "rows", "present")


@query("PRD-18 AGG-23", _sql("filter_geo_box"))
def filter_geo_layout(t: Tables) -> DataFrame:
    points = filters.event_points(t)
    path = t.stored("events-by-place", ["events"], lambda path: write_by_place(points, path, "point"))
    return in_placed_box(t.spark.read.parquet(path), (-88, -100), (-70.5, 50.5)).select("event_id")
