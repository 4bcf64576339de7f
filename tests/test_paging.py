"""Order, pages and cursors."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

import plans
from logscope.operators import paging

SCHEMA = "id int, name string, n int, ts timestamp_ntz"


@pytest.fixture(scope="module")
def rows(spark):
    names = ["b", None, "a", "", "B", "é", "b", None, "a", "a", "z", "aa"]
    base = spark.createDataFrame(
        [(i, name, i % 3 if i % 4 else None) for i, name in enumerate(names)],
        "id int, name string, n int")
    stamp = F.timestamp_add("DAY", F.col("id") % 5, F.lit("2024-01-01").cast("timestamp_ntz"))
    return base.withColumn("ts", stamp)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_missing_first_ascending_last_descending(rows):
    up = [r["name"] for r in paging.sorted_rows(rows, [("name", "asc")], ["id"], "ts").collect()]
    # Bytes decide: upper case before lower case before accents; empty text is a value.
    assert up == [None, None, "", "B", "a", "a", "a", "aa", "b", "b", "z", "é"]
    down = paging.sorted_rows(rows, [("name", "desc")], ["id"], "ts")
    assert [r["name"] for r in down.collect()] == up[::-1]


def test_key_breaks_ties(rows):
    assert ids(paging.top_rows(rows, [("name", "desc")], ["id"], "ts", 5)) == [5, 10, 0, 6, 11]


def test_checks_come_before_any_job(rows):
    with pytest.raises(ValueError, match="analysed"):
        paging.sorted_rows(rows, [("name", "asc")], ["id"], "ts", analysed=["name"])
    with pytest.raises(ValueError, match="direction"):
        paging.sorted_rows(rows, [("n", "up")], ["id"], "ts")
    assert paging.checked_sort(rows, [("gone", "desc"), ("id", "desc")], ["id"], "ts") == [
        ("ts", "desc"), ("id", "desc")]
    assert paging.checked_sort(rows, [("gone", "desc"), ("ts", "asc")], ["id"], "ts") == [
        ("ts", "desc"), ("id", "asc")]


def test_toggle():
    assert paging.toggled(None, "a") == ("a", "desc")
    assert paging.toggled(("a", "desc"), "a") == ("a", "asc")
    assert paging.toggled(("a", "asc"), "a") == ("a", "desc")
    assert paging.toggled(("a", "asc"), "b") == ("b", "desc")


def test_numbered_pages(rows):
    whole = ids(paging.sorted_rows(rows, [("n", "desc")], ["id"], "ts"))
    pages = [ids(paging.page(rows, [("n", "desc")], ["id"], "ts", i, 5)) for i in range(4)]
    assert pages == [whole[:5], whole[5:10], whole[10:], []]
    capped = [ids(paging.page(rows, [("n", "desc")], ["id"], "ts", i, 5, total=7)) for i in range(3)]
    assert capped == [whole[:5], whole[5:7], []]


def walk(rows, sort, size):
    last, seen = None, []
    for _ in range(30):
        found = paging.page_after(rows, sort, ["id"], "ts", size, last)
        seen += ids(found)
        last = paging.cursor(found, sort, ["id"], "ts")
        if last is None:
            return seen
    raise AssertionError("the cursor does not come to an end")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    fields=st.permutations(["name", "n", "ts"]), kept=st.integers(0, 3),
    directions=st.lists(st.sampled_from(["asc", "desc"]), min_size=3, max_size=3),
    size=st.integers(3, 7),
)
def test_cursor_walks_the_whole_order(rows, fields, kept, directions, size):
    sort = list(zip(fields, directions))[:kept]
    assert walk(rows, sort, size) == ids(paging.sorted_rows(rows, sort, ["id"], "ts"))


def test_cursor_in_a_run_of_missing_values(rows):
    assert walk(rows, [("name", "asc")], 1) == ids(paging.sorted_rows(rows, [("name", "asc")], ["id"], "ts"))


def test_sorted_shards_merge(spark):
    # Two shards of 20 rows; the best ten of both.
    shards = spark.range(40).select(
        F.concat(F.lit("_shard"), (F.col("id") % 2).cast("string")).alias("shard"),
        F.concat(F.lit("k"), F.col("id")).alias("rowkey"), (F.col("id") * 7 % 40).alias("timestamp"))
    best = paging.top_rows(shards, [("timestamp", "desc")], ["rowkey"], "timestamp", 10)
    assert [r["timestamp"] for r in best.collect()] == list(range(39, 29, -1))


def test_shards_sort_as_numbers(spark):
    rows = spark.createDataFrame(
        [("d1", "_shard15", "a"), ("d1", "_shard2", "b"), ("d2", "_shard1", "c"), ("d1", "_shard2", "a")],
        "day string, shard string, id string")
    got = [tuple(r) for r in paging.by_shard(rows, "day", "shard", "id").collect()]
    assert [g[1] for g in got] == ["_shard2", "_shard2", "_shard15", "_shard1"]


def test_top_rows_and_pages_keep_only_their_rows(spark, rows):
    top = paging.top_rows(rows, [("n", "desc")], ["id"], "ts", 5)
    assert "TakeOrderedAndProject(limit=5" in plans.planned(top)
    third = paging.page(rows, [("n", "desc")], ["id"], "ts", 2, 5)
    assert "TakeOrderedAndProject(limit=15, offset=10" in plans.planned(third)
    after = paging.page_after(rows, [("n", "desc")], ["id"], "ts", 5, {"n": 1, "id": 4})
    assert "TakeOrderedAndProject(limit=5" in plans.planned(after)
