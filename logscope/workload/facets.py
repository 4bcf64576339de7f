"""Queries for counts, statistics, pivots, maps and the search page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logscope.functions.text import words
from logscope.functions.times import day_key
from logscope.operators import clusters, facets, geo, pivots
from logscope.operators.predicates import term
from logscope.plans.search import SearchPage, search
from logscope.workload.filters import event_points
from logscope.workload.registry import Tables, query

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _signups_missing(t: Tables) -> DataFrame:
    return t.events.withColumn("kind", F.nullif("event_type", F.lit("signup")))


def _with_hour(t: Tables) -> DataFrame:
    return t.events.withColumn("hour", F.hour("ts").cast("bigint"))


@query("AGG-3", """
SELECT user_id AS value, count(*) AS count FROM events GROUP BY user_id
ORDER BY count DESC, value LIMIT 10
""")
def facet_terms(t: Tables) -> DataFrame:
    return facets.terms(t.events, "user_id", 10)


@query("AGG-6 PRD-17", """
SELECT event_type AS value, count(*) AS count FROM events WHERE event_type <> 'view'
GROUP BY event_type ORDER BY count DESC, value LIMIT 3
""")
def facet_terms_ascending(t: Tables) -> DataFrame:
    return facets.terms(t.events, "event_type", 3, order="ascending", exclude=["view"])


@query("AGG-4", """
WITH e AS (SELECT nullif(event_type, 'signup') AS kind FROM events),
top AS (SELECT kind AS value, count(*) AS count FROM e WHERE kind IS NOT NULL
        GROUP BY kind ORDER BY count DESC, value LIMIT 2)
SELECT 'term' AS kind, value, count FROM top
UNION ALL SELECT 'missing', NULL, count(*) FROM e WHERE kind IS NULL
UNION ALL SELECT 'other', NULL,
  CAST((SELECT count(*) FROM e WHERE kind IS NOT NULL) - (SELECT sum(count) FROM top) AS BIGINT)
""")
def facet_terms_with_rest(t: Tables) -> DataFrame:
    return facets.terms_with_rest(_signups_missing(t), "kind", 2)


@query("AGG-4", rf"""
WITH w AS (SELECT unnest(list_distinct({_WORDS})) AS value FROM documents)
SELECT * FROM (SELECT 'term' AS kind, value, count(*) AS count FROM w GROUP BY value
               ORDER BY count DESC, value LIMIT 8)
UNION ALL SELECT 'missing', NULL, count(*) FROM documents WHERE len({_WORDS}) = 0
UNION ALL SELECT 'other', NULL, 0
""")
def facet_terms_tokenised(t: Tables) -> DataFrame:
    rows = t.documents.select(words(F.col("text")).alias("words"))
    return facets.terms_with_rest(rows, "words", 8, tokenised=True)


@query("AGG-5", """
SELECT event_type AS value, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
       round(sum(value), 4) AS sum FROM events GROUP BY event_type
""")
def facet_stats(t: Tables) -> DataFrame:
    found = facets.stats(t.events, "event_type", "value")
    return found.withColumns({"mean": F.round("mean", 6), "sum": F.round("sum", 4)})


@query("AGG-5 AGG-6", """
SELECT user_id AS value, max(value) AS max FROM events GROUP BY user_id
ORDER BY max, value LIMIT 7
""")
def facet_stats_smallest(t: Tables) -> DataFrame:
    return facets.stats_terms(t.events, "user_id", "value", "max", 7, "ascending")


@query("AGG-7", """
SELECT 'event_type' AS field, event_type AS value, count(*) AS count FROM events GROUP BY event_type
UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY user_id
""")
def facet_several(t: Tables) -> DataFrame:
    return facets.facets(t.events, ["event_type", "user_id"], limit=None)


@query("AGG-8 W-4", """
WITH c AS (
  SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents GROUP BY lang
  UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY count DESC, value) <= 4
""")
def facet_several_limited(t: Tables) -> DataFrame:
    return facets.facets(t.documents, ["lang", "source"], limit=4)


@query("AGG-9 FN-22", rf"""
WITH w AS (SELECT unnest(list_distinct({_WORDS})) AS word FROM documents),
c AS (SELECT word, count(*) AS count FROM w WHERE word <> 'the' GROUP BY word
      ORDER BY count DESC, word LIMIT 20),
s AS (SELECT word, count, count / (SELECT count(*) FROM documents) AS share FROM c)
SELECT word, count, share, max(share) OVER () AS max_share,
       round(5 + 30 * (share / max(share) OVER ()), 6) AS size FROM s
""")
def facet_tag_cloud(t: Tables) -> DataFrame:
    cloud = facets.tag_cloud(t.documents, "text", 20, stop_words=["the"])
    return cloud.withColumn("size", F.round("size", 6))


_CELLS = "SELECT event_type AS row, hour(ts) AS col, count(*) AS count FROM events GROUP BY ALL"


@query("AGG-10", """
WITH c AS (SELECT user_id AS row, event_type || '-' || hour(ts) AS col, count(*) AS count
           FROM events GROUP BY ALL),
r AS (SELECT row FROM c GROUP BY row ORDER BY sum(count) DESC, row LIMIT 6),
v AS (SELECT DISTINCT col FROM c),
g AS (SELECT r.row, v.col, coalesce(c.count, 0) AS count FROM r, v
      LEFT JOIN c ON c.row = r.row AND c.col = v.col)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY row ORDER BY count DESC, col) <= 6
""")
def pivot_facet(t: Tables) -> DataFrame:
    rows = t.events.withColumn("what", F.concat_ws("-", "event_type", F.hour("ts")))
    return pivots.pivot(rows, "user_id", "what", 6)


@query("JOIN-5 AGG-10", """
WITH c AS (SELECT user_id AS row, strftime(ts, '%Y%m%d') AS col, count(*) AS count
           FROM events GROUP BY ALL),
r AS (SELECT row FROM c GROUP BY row ORDER BY sum(count) DESC, row LIMIT 12),
v AS (SELECT col FROM c GROUP BY col ORDER BY sum(count) DESC, col LIMIT 9)
SELECT r.row, v.col, coalesce(c.count, 0) AS count FROM r, v
LEFT JOIN c ON c.row = r.row AND c.col = v.col
""")
def pivot_matrix(t: Tables) -> DataFrame:
    rows = t.events.withColumn("day", day_key(F.col("ts")))
    return pivots.matrix(rows, "user_id", "day", 12, 9)


@query("AGG-11", f"""
SELECT col, CAST(sum(count) AS BIGINT) AS total, min(count) AS low, max(count) AS high
FROM ({_CELLS}) GROUP BY col
""")
def pivot_column_sums(t: Tables) -> DataFrame:
    return pivots.column_sums(pivots.matrix(_with_hour(t), "event_type", "hour"))


@query("AGG-11", f"SELECT min(count) AS low, max(count) AS high FROM ({_CELLS})")
def pivot_domain(t: Tables) -> DataFrame:
    return pivots.domain(pivots.cell_counts(_with_hour(t), "event_type", "hour"))


@query("AGG-12", "SELECT hour(ts) AS row, event_type AS col, count(*) AS count FROM events GROUP BY ALL")
def pivot_transposed(t: Tables) -> DataFrame:
    return pivots.transpose(pivots.cell_counts(_with_hour(t), "event_type", "hour"))


@query("AGG-13", f"""
WITH c AS ({_CELLS})
SELECT c.*, coalesce(s.count, 0) AS sort_count
FROM c LEFT JOIN (SELECT row, count FROM c WHERE col = 5) s ON s.row = c.row
""")
def pivot_ordered_rows(t: Tables) -> DataFrame:
    return pivots.order_rows(pivots.cell_counts(_with_hour(t), "event_type", "hour"), 5)


@query("AGG-13", f"""
WITH c AS ({_CELLS})
SELECT c.*, coalesce(s.count, 0) AS sort_count
FROM c LEFT JOIN (SELECT col, count FROM c WHERE row = 'error') s ON s.col = c.col
""")
def pivot_ordered_columns(t: Tables) -> DataFrame:
    cells = pivots.cell_counts(_with_hour(t), "event_type", "hour")
    return pivots.order_columns(cells, "error", descending=False)


@query("FN-22", f"""
WITH c AS ({_CELLS})
SELECT row, col, count, round((count - min(count) OVER ())
  / (max(count) OVER () - min(count) OVER ()) * 10, 6) AS intensity FROM c
""")
def pivot_intensity(t: Tables) -> DataFrame:
    cells = pivots.intensity(pivots.cell_counts(_with_hour(t), "event_type", "hour"))
    return cells.withColumn("intensity", F.round("intensity", 6))


def _regions(t: Tables) -> DataFrame:
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    mixed = F.when(F.col("c_acctbal") < 4500, F.lower("n_name")).otherwise(F.col("n_name"))
    return named.withColumn("state", mixed)


@query("AGG-21 FN-21", """
SELECT n_name AS region, count(*) AS count
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def map_region_counts(t: Tables) -> DataFrame:
    return facets.region_counts(_regions(t), "state")


@query("AGG-22 FN-21", """
SELECT n_name AS region, min(c_acctbal) AS min, max(c_acctbal) AS max,
       round(avg(c_acctbal), 6) AS mean, round(sum(c_acctbal), 4) AS sum
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def map_region_stats(t: Tables) -> DataFrame:
    found = facets.region_stats(_regions(t), "state", "c_acctbal")
    return found.withColumns({"mean": F.round("mean", 6), "sum": F.round("sum", 4)})


@query("AGG-23", """
SELECT * FROM (
  SELECT ts, event_id, value * 0.36::DOUBLE - 90 AS lat,
         hour(ts) * 15 + minute(ts) * 0.25::DOUBLE - 180 AS lon FROM events)
WHERE lat BETWEEN -85 AND 0 AND lon BETWEEN -90 AND 90
ORDER BY ts DESC, event_id LIMIT 200
""")
def map_latest_points(t: Tables) -> DataFrame:
    return geo.latest_points(event_points(t), "point", "ts", ["event_id"], (-85, -90), (0, 90), 200)


@query("AGG-24", """
WITH p AS (SELECT value * 0.36::DOUBLE - 90 AS lat,
                  hour(ts) * 15 + minute(ts) * 0.25::DOUBLE - 180 AS lon FROM events)
SELECT CAST(floor(lat / 10.0) AS BIGINT) AS cell_lat, CAST(floor(lon / 10.0) AS BIGINT) AS cell_lon,
       count(*) AS count, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon
FROM p GROUP BY 1, 2
""")
def map_grid_clusters(t: Tables) -> DataFrame:
    cells = geo.grid_clusters(event_points(t), "point", 10.0)
    return cells.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("AGG-24", """
WITH RECURSIVE p AS (SELECT value * 0.36::DOUBLE - 90 AS lat,
                  hour(ts) * 15 + minute(ts) * 0.25::DOUBLE - 180 AS lon, count(*) AS n FROM events GROUP BY 1, 2),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lat, lon) AS id, floor(lat / 0.3)::BIGINT AS r, * FROM p),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM (SELECT *, unnest([r - 1, r, r + 1]) AS near FROM s) a
  JOIN s b ON a.near = b.r AND abs(a.lon - b.lon) < 0.31
  WHERE (a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon) <= 0.3::DOUBLE * 0.3),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT CAST(sum(n) AS BIGINT) AS count, round(sum(n * lat) / sum(n), 6) AS lat, round(sum(n * lon) / sum(n), 6) AS lon,
  round(min(lat), 6) AS south, round(min(lon), 6) AS west, round(max(lat), 6) AS north, round(max(lon), 6) AS east
FROM (SELECT a, min(b) AS first FROM reach GROUP BY a) JOIN s ON a = id GROUP BY first
""")
def map_near_clusters(t: Tables) -> DataFrame:
    found = clusters.near_clusters(event_points(t), "point", 0.3)
    return found.select("count", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@query("AGG-25", rf"""
SELECT value, count(*) AS count FROM (SELECT unnest({_WORDS}) AS value FROM documents)
GROUP BY value ORDER BY count DESC, value LIMIT 10
""")
def table_top_values(t: Tables) -> DataFrame:
    rows = t.documents.select(words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return facets.top_field_values(rows, "words", 10)


@query("AGG-25", """
SELECT '["' || lang || '","' || source || '"]' AS value, count(*) AS count FROM documents
GROUP BY value ORDER BY count DESC, value LIMIT 10
""")
def table_top_values_whole(t: Tables) -> DataFrame:
    tagged = t.documents.select(F.array("lang", "source").alias("tags"))
    return facets.top_field_values(tagged, "tags", 10, grouped=True)


@query("AGG-26", """
WITH e AS (SELECT nullif(event_type, 'signup') AS kind, nullif(user_id, 7) AS user_id, value FROM events)
SELECT 'user_id' AS field, count(user_id) AS count FROM e WHERE kind IS NOT NULL
UNION ALL SELECT 'value', count(value) FROM e WHERE kind IS NOT NULL
""")
def table_related_fields(t: Tables) -> DataFrame:
    rows = _signups_missing(t).withColumn("user_id", F.nullif("user_id", F.lit(7)))
    return facets.related_fields(rows, "kind", ["user_id", "value"])


@query("AGG-27 AGG-28 FN-10", """
WITH e AS (SELECT nullif(event_type, 'signup') AS kind, user_id FROM events)
SELECT 'kind' AS field, count(kind) AS present, floor(count(kind) / count(*) * 10000) / 100 AS percent
FROM e UNION ALL SELECT 'user_id', count(user_id), floor(count(user_id) / count(*) * 10000) / 100 FROM e
""")
def table_field_presence(t: Tables) -> DataFrame:
    return facets.presence(_signups_missing(t), ["kind", "user_id"])


@query("AGG-28 W-3 FN-10", """
WITH c AS (SELECT user_id AS value, count(*) AS count FROM events GROUP BY user_id)
SELECT value, count, floor(count / (SELECT sum(count) FROM c) * 10000) / 100 AS percent FROM c
""")
def facet_percent(t: Tables) -> DataFrame:
    return facets.with_percent(facets.value_counts(t.events, "user_id"))


@query("W-3", """
SELECT event_type AS value, count(*) AS count, count(*) / (SELECT count(*) FROM events) AS share
FROM events GROUP BY event_type
""")
def facet_share(t: Tables) -> DataFrame:
    return facets.with_share(facets.value_counts(t.events, "event_type"))


@query("AGG-29 JOIN-6", """
WITH top AS (SELECT user_id AS v FROM events GROUP BY v ORDER BY count(*) DESC, v LIMIT 5)
SELECT 'term' AS kind, CAST(v AS VARCHAR) AS query, (SELECT count(*) FROM events WHERE user_id = v) AS hits FROM top
UNION ALL SELECT 'other', 'other', count(*) FROM events WHERE user_id NOT IN (SELECT v FROM top)
""")
def derived_terms(t: Tables) -> DataFrame:
    return facets.derived_queries(t.events, "user_id", 5)


@query("AGG-29", """
WITH top AS (SELECT user_id AS v FROM events WHERE value > 20 GROUP BY v
             ORDER BY count(*) DESC, v LIMIT 5)
SELECT 'term' AS kind, CAST(v AS VARCHAR) AS query,
       (SELECT count(*) FROM events WHERE user_id = v AND value > 20) AS hits FROM top
UNION ALL SELECT 'other', 'other', count(*) FROM events
WHERE NOT (user_id IN (SELECT v FROM top) AND value > 20)
""")
def derived_terms_and(t: Tables) -> DataFrame:
    return facets.derived_queries(t.events, "user_id", 5, F.col("value") > 20, "AND")


@query("AGG-29", """
WITH top AS (SELECT user_id AS v FROM events WHERE value > 20 GROUP BY v
             ORDER BY count(*) DESC, v LIMIT 5)
SELECT 'term' AS kind, CAST(v AS VARCHAR) AS query,
       (SELECT count(*) FROM events WHERE user_id = v OR value > 20) AS hits FROM top
UNION ALL SELECT 'other', 'other', count(*) FROM events
WHERE NOT (user_id IN (SELECT v FROM top) OR value > 20)
""")
def derived_terms_or(t: Tables) -> DataFrame:
    return facets.derived_queries(t.events, "user_id", 5, F.col("value") > 20, "OR")


@query("AGG-30", """
SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max,
       min(o_orderdate) AS o_orderdate_min, max(o_orderdate) AS o_orderdate_max FROM orders
""")
def chart_extents(t: Tables) -> DataFrame:
    return facets.extents(t.orders, ["o_totalprice", "o_orderdate"])


# The search page.

def _search(t: Tables) -> SearchPage:
    return search(t.documents, "text", "the of", key=["doc_id"], facet_fields=["lang", "source"],
                  sort=[("n_chars", "desc")], number=1, size=10, facet_limit=5, snippet_length=80)


_FOUND = rf"""WITH f AS (
  SELECT * FROM documents WHERE list_has_all({_WORDS}, ['the', 'of']))
"""


@query("AGG-34", _FOUND + "SELECT count(*) AS hits FROM f")
def search_total(t: Tables) -> DataFrame:
    return _search(t).total


# The marks are letters while the replacement runs twice, so neither pass marks a mark.
@query("AGG-34 SRT-7 FN-16 FN-17", _FOUND + r"""
, pg AS (SELECT * FROM f ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10)
SELECT doc_id, n_chars, lang, source, text,
  replace(replace(
    regexp_replace(regexp_replace(text,
      '(^|[^\p{L}\p{N}])((?i)the|of)($|[^\p{L}\p{N}])', '\1ʬ\2ʭ\3', 'g'),
      '(^|[^\p{L}\p{N}])((?i)the|of)($|[^\p{L}\p{N}])', '\1ʬ\2ʭ\3', 'g'),
    'ʬ', '<em>'), 'ʭ', '</em>') AS highlight,
  CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS snippet
FROM pg
""")
def search_rows(t: Tables) -> DataFrame:
    return _search(t).rows


@query("AGG-34 PRD-1 FN-16", """
SELECT doc_id, text, text AS highlight FROM documents ORDER BY doc_id LIMIT 50
""")
def search_blank(t: Tables) -> DataFrame:
    found = search(t.documents, "text", " ", key=["doc_id"], facet_fields=["lang"], size=50)
    return found.rows.select("doc_id", "text", "highlight")


@query("AGG-34 AGG-7 AGG-8", _FOUND + """
, c AS (SELECT 'lang' AS field, lang AS value, count(*) AS count FROM f GROUP BY lang
  UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY source)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY count DESC, value) <= 5
""")
def search_facets(t: Tables) -> DataFrame:
    return _search(t).facets
