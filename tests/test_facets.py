"""Counts, pivots and nested JSON on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

import plans
from conftest import SMALL
import compare
from logscope.functions import nested
from logscope.operators import facets, geo, joins, pivots, sets
from logscope.operators.predicates import Query
from logscope.sources import records, tables


def listed(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def kinds(spark):
    values = ["b"] * 3 + ["a"] * 3 + ["c"] * 5 + ["d"] * 2 + [None] * 4
    return spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)],
                                 "id int, kind string, v double")


def test_ties_at_the_boundary(kinds):
    assert listed(facets.terms(kinds, "kind", 2)) == [("c", 5), ("a", 3)]
    assert listed(facets.terms(kinds, "kind", 2, "ascending")) == [("a", 3), ("c", 5)]
    assert listed(facets.terms(kinds, "kind", 2, exclude=["c"])) == [("a", 3), ("b", 3)]


def test_rest_rows(kinds):
    got = listed(facets.terms_with_rest(kinds, "kind", 2))
    assert sorted(got, key=str) == sorted([
        ("term", "c", 5), ("term", "a", 3), ("missing", None, 4), ("other", None, 5)], key=str)
    # More terms asked for than there are: nothing is left over and no null term is shown.
    got = listed(facets.terms_with_rest(kinds, "kind", 9))
    assert ("missing", None, 4) in got and ("other", None, 0) in got and len(got) == 6


def test_rest_rows_of_an_empty_table(kinds):
    got = listed(facets.terms_with_rest(kinds.where("false"), "kind", 2))
    assert sorted(got) == [("missing", None, 0), ("other", None, 0)]


def test_smallest_statistics(kinds):
    assert listed(facets.stats_terms(kinds, "kind", "v", "max", 2, "ascending")) == [
        ("b", 2.0), ("a", 5.0)]
    assert listed(facets.stats_terms(kinds, "kind", "v", "count", 1)) == [("c", 5)]


def test_tag_cloud_shares(spark):
    rows = spark.createDataFrame([("a a b",), ("a",), ("",), (None,)], "t string")
    got = {r["word"]: r for r in facets.tag_cloud(rows, "t", 5).collect()}
    assert (got["a"]["count"], got["a"]["share"], got["a"]["size"]) == (2, 0.5, 35.0)
    assert (got["b"]["share"], got["b"]["max_share"], got["b"]["size"]) == (0.25, 0.5, 20.0)


def test_top_values_of_lists(spark):
    rows = spark.createDataFrame([(["x", "y"],), (["x"],), ([],), (None,)], "v array<string>")
    assert listed(facets.top_field_values(rows, "v")) == [("x", 2), ("", 1), ("y", 1)]
    assert listed(facets.top_field_values(rows, "v", grouped=True)) == [
        ("", 1), ('["x","y"]', 1), ('["x"]', 1), ("[]", 1)]


def test_mixed_case_regions(spark):
    rows = spark.createDataFrame([("ca", 1.0), ("CA", 3.0), ("Ny", 5.0), (None, 9.0)], "s string, v double")
    assert sorted(listed(facets.region_counts(rows, "s"))) == [("CA", 2), ("NY", 1)]
    got = {r["region"]: r["mean"] for r in facets.region_stats(rows, "s", "v").collect()}
    assert got == {"CA": 2.0, "NY": 5.0}


def test_derived_queries_count_missing_rows_as_other(kinds):
    wide = F.col("v") >= 4
    assert dict(listed(facets.derived_queries(kinds, "kind", 2).drop("kind"))) == {"c": 5, "a": 3, "other": 9}
    assert dict(listed(facets.derived_queries(kinds, "kind", 1, wide, "AND").drop("kind"))) == {"c": 5, "other": 12}
    # Of 17 rows 13 match; "c" adds none.
    assert dict(listed(facets.derived_queries(kinds, "kind", 1, wide, "OR").drop("kind"))) == {"c": 13, "other": 4}
    assert dict(listed(facets.derived_queries(kinds, "kind", 1, wide, "OR", rest=False).drop("kind"))) == {"c": 13}


def test_pivot_shows_zeros_only_where_columns_run_out(spark):
    rows = spark.createDataFrame(
        [("r1", "x")] * 3 + [("r1", "y")] * 2 + [("r1", "z")] + [("r2", "z")] * 2 + [("r3", "w")],
        "r string, c string")
    got = listed(pivots.pivot(rows, "r", "c", 2))
    assert sorted(got) == [("r1", "x", 3), ("r1", "y", 2), ("r2", "w", 0), ("r2", "z", 2)]
    full = listed(pivots.matrix(rows, "r", "c", 2, 2))
    assert sorted(full) == [("r1", "x", 3), ("r1", "z", 1), ("r2", "x", 0), ("r2", "z", 2)]


def test_pivot_order(spark):
    cells = spark.createDataFrame(
        [("a", 1, 5), ("a", 2, 0), ("b", 1, 9), ("c", 2, 4)], "row string, col int, count bigint")
    rows = [r["row"] for r in pivots.order_rows(cells, 1).collect()]
    assert rows == ["b", "a", "a", "c"]
    columns = [r["col"] for r in pivots.order_columns(cells, "a", descending=False).collect()]
    assert columns == [2, 2, 1, 1]
    assert listed(pivots.domain(cells)) == [(0, 9)]
    assert sorted(listed(pivots.column_sums(cells))) == [(1, 14, 5, 9), (2, 4, 0, 4)]


def test_other_rows_keep_missing_values(kinds):
    other = joins.rows_of_other_terms(kinds, "kind", 2)
    assert sorted(r["id"] for r in other.collect()) == [0, 1, 2, 11, 12, 13, 14, 15, 16]


def test_look_up(spark):
    hits = spark.createDataFrame([(1, "p"), (2, "q"), (2, "r"), (None, "s")], "k int, h string")
    stored = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "n")], "k int, v string")
    matched = [(2, "q", "x"), (2, "q", "y"), (2, "r", "x"), (2, "r", "y")]
    assert sorted(listed(joins.look_up(hits, stored, "k", stubs=False))) == matched
    got = listed(joins.look_up(hits, stored, "k"))
    assert sorted(got, key=str) == sorted([*matched, (1, "p", None), (None, "s", None)], key=str)


def test_grid_leaves_out_bad_points(spark):
    rows = spark.createDataFrame([("1,1",), ("2,3",), ("-1,1",), ("x,1",), (None,)], "at string")
    got = {tuple(r)[:3] for r in geo.grid_clusters(rows, "at", 10.0).collect()}
    assert got == {(0, 0, 2), (-1, 0, 1)}


def test_union_of_tables_with_other_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, u string")
    b = spark.createDataFrame([(2,)], "id int")
    assert sorted(listed(sets.union_tables([a, b]))) == [(1, "x"), (2, None)]
    assert sorted(listed(sets.union_labelled({"p": b, "q": b}))) == [("p", 2), ("q", 2)]


def test_flatten_json(spark):
    schema = T.StructType().add("b", T.StructType().add("y", T.StringType()).add(
        "x", T.StructType().add("n", T.LongType()))).add(
        "a", T.ArrayType(T.StructType().add("k", T.LongType()))).add(
        "list", T.ArrayType(T.LongType())).add("words", T.ArrayType(T.StringType()))
    rows = spark.createDataFrame([
        (1, '{"b":{"y":"t","x":{"n":7}},"a":[{"k":1},{"k":2}],"list":[5],"words":["u"]}'),
        (2, '{"list":[5,6]}'), (3, "no json")], "id int, doc string")
    flat = nested.flatten_json(rows, "doc", schema, keep=("id",))
    assert flat.columns == ["id", "a", "b.x.n", "b.y", "list", "words"]
    assert listed(flat) == [
        (1, '{"k":1}, {"k":2}', 7, "t", "5", ["u"]), (2, None, None, None, "[5,6]", None),
        (3, None, None, None, None, None)]


def test_decode(spark):
    raw = spark.createDataFrame([("5", None, "x", "2024-01-01T00:00:00.5")], "a string, b string, c string, d string")
    got = records.decode(raw, {"a": "long_n", "b": "string", "c": "double_n", "d": "tdate"})
    row = got.first()
    assert (row["a"], row["b"], row["c"]) == (5, "", None)
    assert dict(got.dtypes)["d"] == "timestamp_ntz" and row["d"].microsecond == 500000
    with pytest.raises(ValueError, match="not supported"):
        records.decode(raw, {"a": "bool"})


def test_row_keys(spark):
    keys = spark.createDataFrame([("1463909541000#3",), ("0#-1",)], "k string")
    stored = records.storage_key(F.col("k"))
    got = listed(keys.select(stored, records.from_storage_key(stored), records.row_key_time(F.col("k")),
                             records.row_key_task(F.col("k"))))
    time = (1463909541000).to_bytes(8, "little").hex().upper()
    assert got == [(f"{time}0003", "1463909541000#3", 1463909541000, 3),
                   ("0000000000000000FFFF", "0#-1", 0, -1)]


def test_latest_by_key_cuts_in_the_map_task(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("version"))
    newest = tables.latest_by_key(rows, ["k"], ["version"])
    assert sorted(listed(newest)) == [(0, 999), (1, 997), (2, 998)]
    assert plans.planned(tables.latest_by_key(rows, ["k"], ["version"])).count("WindowGroupLimit") == 2


def test_field_catalogue_with_distinct_values(kinds):
    got = {r["field"]: tuple(r)[1:] for r in tables.field_catalogue(kinds, approximate_distinct=True).collect()}
    assert got["kind"] == ("string", 13, 4)
    assert got["id"][:2] == ("int", 17)


def test_hits_of_one_query_and_of_none_matching(kinds):
    one = [Query("a", F.col("kind") == "a")]
    assert listed(facets.hits(kinds, one)) == [("a", 3, 3)]
    several = [*one, Query("never", F.lit(None).cast("boolean")), Query("wide", F.col("v") >= 4)]
    assert listed(facets.hits(kinds, several)) == [("a", 3, 16), ("never", 0, 16), ("wide", 13, 16)]
    assert listed(facets.hits(kinds.where("false"), several))[0] == ("a", 0, 0)


def test_look_up_reads_each_table_once(spark):
    assert plans.scans(compare.contract.queries()["lookup_with_stubs"](spark, SMALL)) == 2


def test_a_value_named_other_is_a_term(spark):
    rows = spark.createDataFrame([("other",)] * 3 + [("x",)], "k string")
    got = listed(facets.derived_queries(rows, "k", 1))
    assert got == [("term", "other", 3), ("other", "other", 1)]


def test_hits_need_a_query(kinds):
    with pytest.raises(ValueError, match="at least one"):
        facets.hits(kinds, [])
