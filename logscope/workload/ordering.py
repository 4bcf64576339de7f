"""Queries for order, top-k and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logscope.operators import paging
from logscope.workload.registry import Tables, query

_KEY, _TIME = ["event_id"], "ts"


def _gaps(t: Tables) -> DataFrame:
    """Events with a rounded value and a kind that is null for signups."""
    return t.events.select(
        "event_id", "ts", F.nullif("event_type", F.lit("signup")).alias("kind"),
        F.floor("value").alias("amount"),
    )


_GAPS = """WITH e AS (SELECT event_id, ts, nullif(event_type, 'signup') AS kind,
  CAST(floor(value) AS BIGINT) AS amount FROM events)
"""


@query("SRT-1", "SELECT event_id, event_type, value FROM events")
def sort_many_fields(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "event_type", "value")
    ordered = paging.sorted_rows(rows, [("event_type", "asc"), ("value", "desc")], _KEY, _TIME)
    return ordered.select("event_id", "event_type", "value")


@query("SRT-2 SRT-6", _GAPS + """
SELECT * FROM e ORDER BY kind ASC NULLS FIRST, amount DESC, event_id LIMIT 300
""")
def sort_missing_first(t: Tables) -> DataFrame:
    return paging.top_rows(_gaps(t), [("kind", "asc"), ("amount", "desc")], _KEY, _TIME, 300)


@query("SRT-2 SRT-5", _GAPS + """
SELECT * FROM e ORDER BY kind DESC NULLS LAST, amount, event_id LIMIT 300
""")
def sort_missing_last(t: Tables) -> DataFrame:
    return paging.top_rows(_gaps(t), [("kind", "desc"), ("amount", "asc")], _KEY, _TIME, 300)


@query("SRT-3", """
SELECT doc_id, text FROM documents ORDER BY text, doc_id LIMIT 25
""")
def sort_text_by_bytes(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text")
    return paging.top_rows(rows, [("text", "asc")], ["doc_id"], "doc_id", 25)


@query("SRT-4", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def sort_unknown_field(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts")
    return paging.top_rows(rows, [("no_such_field", "desc")], _KEY, _TIME, 50)


@query("SRT-5", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_shipdate LIMIT 10
""")
def top_rows(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return paging.top_rows(rows, [("l_extendedprice", "desc")],
                           ["l_orderkey", "l_linenumber", "l_shipdate"], "l_shipdate", 10)


@query("SRT-7", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 75")
def page_by_number(t: Tables) -> DataFrame:
    return paging.page(t.events.select("event_id", "value"), [("value", "desc")], _KEY, "value", 3, 25)


@query("SRT-9", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10 OFFSET 75")
def page_up_to_total(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value")
    return paging.page(rows, [("value", "desc")], _KEY, "value", 3, 25, total=85)


@query("SRT-8", _GAPS + """
SELECT * FROM e ORDER BY kind DESC NULLS LAST, amount, ts DESC, event_id LIMIT 40 OFFSET 80
""")
def page_after_cursor(t: Tables) -> DataFrame:
    sort = [("kind", "desc"), ("amount", "asc"), ("ts", "desc")]
    rows, last = _gaps(t), None
    for _ in range(2):
        last = paging.cursor(paging.page_after(rows, sort, _KEY, _TIME, 40, last), sort, _KEY, _TIME)
    return paging.page_after(rows, sort, _KEY, _TIME, 40, last)


@query("SRT-8", _GAPS + """
SELECT * FROM e WHERE kind IS NULL ORDER BY amount DESC, event_id LIMIT 40 OFFSET 40
""")
def page_after_missing_value(t: Tables) -> DataFrame:
    # The first pages of an ascending sort lie inside the rows without a kind.
    sort = [("kind", "asc"), ("amount", "desc")]
    rows = _gaps(t)
    first = paging.page_after(rows, sort, _KEY, _TIME, 40, None)
    return paging.page_after(rows, sort, _KEY, _TIME, 40, paging.cursor(first, sort, _KEY, _TIME))


@query("SRT-10", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20")
def sort_toggled(t: Tables) -> DataFrame:
    clicked = paging.toggled(paging.toggled(None, "value"), "value")
    return paging.top_rows(t.events.select("event_id", "value"), [clicked], _KEY, "value", 20)
