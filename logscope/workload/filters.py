"""Queries for predicates, filters and query selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logscope.functions.text import words
from logscope.functions.windows import TimeWindow
from logscope.operators import predicates as p
from logscope.operators.facets import hits, value_counts
from logscope.sources.records import project
from logscope.workload.registry import Tables, query

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _ids(df: DataFrame, predicate) -> DataFrame:
    return df.where(predicate).select("event_id", "event_type", "value")


def _with_gaps(t: Tables) -> DataFrame:
    """Events with null for signups and empty text for views."""
    kind = F.nullif("event_type", F.lit("signup"))
    return t.events.withColumn("kind", F.when(kind == "view", "").otherwise(kind))


_GAPS = """WITH e AS (
  SELECT *, CASE event_type WHEN 'signup' THEN NULL WHEN 'view' THEN '' ELSE event_type END AS kind
  FROM events)
"""


@query("PRD-1", "SELECT event_id, event_type, value FROM events")
def filter_match_all(t: Tables) -> DataFrame:
    return _ids(t.events, p.match_all())


@query("PRD-2", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error'")
def filter_term(t: Tables) -> DataFrame:
    return _ids(t.events, p.term("event_type", "error"))


@query("PRD-3", r"""
WITH w AS (
  SELECT page_id, url,
         list_filter(string_split_regex(lower(url), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
  FROM pages)
SELECT page_id, url FROM w
WHERE len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'example' AND ws[i + 1] = 'com')) > 0
""")
def filter_phrase_url(t: Tables) -> DataFrame:
    return t.pages.where(p.phrase("url", "example.com")).select("page_id", "url")


@query("PRD-3 PRD-4", rf"""
WITH w AS (
  SELECT doc_id, list_filter({_WORDS}, lambda x: x NOT IN ('the', 'a')) AS ws FROM documents)
SELECT doc_id FROM w
WHERE len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'of' AND ws[i + 1] = 'and')) > 0
""")
def filter_phrase_stop_words(t: Tables) -> DataFrame:
    found = p.phrase("text", "of the and", stop_words=["The", "a"])
    return t.documents.where(found).select("doc_id")


@query("PRD-4", rf"""
SELECT word, count(*) AS count FROM (
  SELECT unnest(list_filter({_WORDS}, lambda x: x NOT IN ('the', 'of', 'and'))) AS word
  FROM documents)
GROUP BY word
""")
def text_word_counts(t: Tables) -> DataFrame:
    tokens = t.documents.select(
        F.explode(words(F.col("text"), ["the", "of", "and"])).alias("word"))
    return value_counts(tokens, "word").withColumnRenamed("value", "word")


@query("PRD-5", rf"""
SELECT conv_id, turn FROM conversations
WHERE list_contains({_WORDS}, 'user') OR role = 'user'
""")
def filter_any_field_word(t: Tables) -> DataFrame:
    return t.conversations.where(p.any_field_word(["text", "role"], "user")).select("conv_id", "turn")


@query("PRD-5", rf"""
SELECT doc_id FROM documents
WHERE (list_contains({_WORDS}, 'the') OR 'the' IN (lang, source))
  AND (list_contains({_WORDS}, 'en') OR 'en' IN (lang, source))
""")
def filter_catch_all_list(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.array("text", "lang", "source").alias("values"))
    return rows.where(p.any_value_word("values", "the EN")).select("doc_id")


@query("PRD-6", rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents)
SELECT doc_id FROM w WHERE list_contains(ws, 'the') AND list_contains(ws, 'of')
  AND list_contains(ws, 'and')
""")
def filter_all_words(t: Tables) -> DataFrame:
    return t.documents.where(p.all_words("text", "the OF and")).select("doc_id")


@query("PRD-7", """
SELECT event_id, event_type, value FROM events WHERE event_type = 'error' OR value >= 40
""")
def filter_any_query(t: Tables) -> DataFrame:
    return _ids(t.events, p.any_query([
        p.Query("errors", p.term("event_type", "error")), p.Query("large", F.col("value") >= 40)]))


@query("PRD-8", """
SELECT event_id, event_type, value FROM events
WHERE (event_type = 'error' AND value > 10) OR (event_type = 'view' AND NOT value > 5)
""")
def filter_compose(t: Tables) -> DataFrame:
    return _ids(t.events, p.any_of(
        p.all_of(p.term("event_type", "error"), F.col("value") > 10),
        p.all_of(p.term("event_type", "view"), p.negate(F.col("value") > 5)),
    ))


@query("PRD-8", _GAPS + """
SELECT event_id, kind FROM e WHERE kind IS DISTINCT FROM 'error'
""")
def filter_not_keeps_missing(t: Tables) -> DataFrame:
    return _with_gaps(t).where(p.negate(p.term("kind", "error"))).select("event_id", "kind")


@query("PRD-9", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 250000
""")
def filter_range(t: Tables) -> DataFrame:
    return t.orders.where(p.between("o_totalprice", 100000, 250000)).select(
        "o_orderkey", "o_totalprice")


@query("PRD-10 FN-2", """
SELECT event_id, ts FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 04:00:00' AND TIMESTAMP '2024-01-07 03:30:00'
""")
def filter_absolute_window(t: Tables) -> DataFrame:
    window = TimeWindow.absolute("2024-01-05T00:00:00", "2024-01-06T23:30:00", zone="GMT+4")
    return t.events.where(window.covers(F.col("ts"))).select("event_id", "ts")


@query("PRD-11", """
SELECT event_id, ts FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 36 HOUR AND TIMESTAMP '2024-01-15 12:00:00'
""")
def filter_relative_window(t: Tables) -> DataFrame:
    window = TimeWindow.relative(36, "HOUR", now="2024-01-15 12:00:00")
    return t.events.where(window.covers(F.col("ts"))).select("event_id", "ts")


@query("PRD-12", """
SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-25 10:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00'
""")
def filter_since_window(t: Tables) -> DataFrame:
    window = TimeWindow.since("2024-01-25 06:00:00", now="2024-01-30 00:00:00", zone="GMT+4")
    return t.events.where(window.covers(F.col("ts"))).select("event_id", "ts")


@query("PRD-13", _GAPS + """
SELECT event_id, kind, value FROM e
WHERE value > 5 AND kind IS DISTINCT FROM 'error' AND (user_id < 40 OR value > 100)
""")
def filter_mandates(t: Tables) -> DataFrame:
    return _with_gaps(t).where(p.combine([
        p.Filter(F.col("value") > 5),
        p.Filter(p.term("kind", "error"), "mustNot"),
        p.Filter(F.col("user_id") < 40, "either"),
        p.Filter(F.col("value") > 100, "either"),
        p.Filter(p.term("kind", "click"), "must", active=False),
    ])).select("event_id", "kind", "value")


@query("PRD-14", _GAPS + "SELECT event_id, kind FROM e WHERE kind IS NOT NULL AND kind <> ''")
def filter_exists(t: Tables) -> DataFrame:
    return _with_gaps(t).where(p.exists("kind")).select("event_id", "kind")


@query("PRD-14", _GAPS + "SELECT event_id, event_type FROM e WHERE kind IS NULL OR kind = ''")
def filter_missing(t: Tables) -> DataFrame:
    return _with_gaps(t).where(p.missing("kind")).select("event_id", "event_type")


@query("PRD-15", """
SELECT event_id, event_type, value FROM events
WHERE value <= 200 AND NOT (event_type = 'view' OR user_id BETWEEN 10 AND 20)
""")
def filter_query_as_filter(t: Tables) -> DataFrame:
    ad_hoc = p.any_of(p.term("event_type", "view"), p.between("user_id", 10, 20))
    return _ids(t.events, p.combine([
        p.Filter(p.between("value", None, 200)), p.Filter(ad_hoc, "mustNot")]))


@query("PRD-16", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def filter_has_all_values(t: Tables) -> DataFrame:
    tagged = t.documents.withColumn("tags", F.array("lang", "source"))
    return tagged.where(p.has_all_values("tags", ["src1", "en"])).select("doc_id")


@query("PRD-17", _GAPS + """
SELECT event_id, kind FROM e WHERE kind IS NULL OR kind NOT IN ('click', 'error')
""")
def filter_excludes(t: Tables) -> DataFrame:
    return _with_gaps(t).where(p.excludes("kind", ["click", "error"])).select("event_id", "kind")


@query("PRD-18 FN-20", """
SELECT event_id FROM events
WHERE value * 0.36::DOUBLE - 90 BETWEEN -88 AND -70.5
  AND hour(ts) * 15 + minute(ts) * 0.25::DOUBLE - 180 BETWEEN -100 AND 50.5
""")
def filter_geo_box(t: Tables) -> DataFrame:
    return event_points(t).where(p.in_box("point", (-88, -100), (-70.5, 50.5))).select("event_id")


def event_points(t: Tables) -> DataFrame:
    """Events with a made-up ``"lat,lon"`` field: latitude by value, longitude by time of day."""
    lon = F.hour("ts") * 15 + F.minute("ts") * F.lit(0.25) - 180
    return t.events.withColumn("point", F.concat_ws(
        ",", (F.col("value") * F.lit(0.36) - 90).cast("string"), lon.cast("string")))


@query("PRD-19", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1997-02-01 00:00:00'
""")
def filter_window_intersection(t: Tables) -> DataFrame:
    window = TimeWindow.intersection([
        TimeWindow.of("1996-01-01", "1997-02-01"), TimeWindow.of("1996-03-01", "1998-01-01")])
    return t.orders.where(window.covers(F.col("o_orderdate"))).select("o_orderkey", "o_orderdate")


@query("PRD-19", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1998-01-01 00:00:00'
""")
def filter_window_hull(t: Tables) -> DataFrame:
    window = TimeWindow.hull([
        TimeWindow.of("1996-01-01", "1997-02-01"), TimeWindow.of("1996-03-01", "1998-01-01")])
    return t.orders.where(window.covers(F.col("o_orderdate"))).select("o_orderkey", "o_orderdate")


@query("PRD-20", "SELECT event_id FROM events")
def project_key_only(t: Tables) -> DataFrame:
    return project(t.events, "event_id")


@query("PRD-20", "SELECT event_id, ts, value FROM events")
def project_columns(t: Tables) -> DataFrame:
    return project(t.events, "event_id", ["event_id", "ts", "value"])


@query("PRD-21 SET-5", """
SELECT 'views' AS query, count(*) FILTER (event_type = 'view') AS hits,
  count(*) FILTER (event_type = 'view') + count(*) FILTER (event_type = 'click') AS total FROM events
UNION ALL
SELECT 'clicks', count(*) FILTER (event_type = 'click'),
  count(*) FILTER (event_type = 'view') + count(*) FILTER (event_type = 'click') FROM events
""")
def filter_choose_queries(t: Tables) -> DataFrame:
    saved = [
        p.Query("errors", p.term("event_type", "error"), pinned=True),
        p.Query("views", p.term("event_type", "view")),
        p.Query("clicks", p.term("event_type", "click")),
    ]
    return hits(t.events, p.choose(saved, "unpinned"))


@query("PRD-22", rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents)
SELECT doc_id FROM w WHERE list_has_any(ws, ['house', 'the', 'la']) AND list_has_any(ws, ['of', 'de'])
""")
def filter_synonyms(t: Tables) -> DataFrame:
    synonyms = {"house": ["The", "la"], "of": ["de"]}
    return t.documents.where(p.words_or_synonyms("text", "house of", synonyms)).select("doc_id")


@query("PRD-23", """
SELECT event_id, ts FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-17 00:00:00'
""")
def filter_zoomed_window(t: Tables) -> DataFrame:
    window = TimeWindow.of("2024-01-14", "2024-01-16").zoomed(2, now="2024-01-17 00:00:00")
    return t.events.where(window.covers(F.col("ts"))).select("event_id", "ts")
