"""Every registered query against its SQL, and what its plan must not hold."""

from __future__ import annotations

import re

import pytest

import compare
import plans
from conftest import SMALL
from logscope.workload import REGISTRY

# Bare text patterns of the operator ids, by how many there are of each.
OPERATORS = {
    "SRC": 10, "SNK": 6, "PRD": 23, "JOIN": 6, "AGG": 34, "W": 9, "SRT": 11, "SET": 5, "FN": 30,
    "STR": 7,
}


@pytest.fixture(scope="module")
def connection():
    return compare.duck(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_same_as_sql(spark, connection, name):
    assert compare.problem(name, spark, connection, SMALL) is None


def test_every_operator_is_registered():
    covered = {c for entry in REGISTRY.values() for c in entry.covers}
    wanted = {f"{group}-{i}" for group, n in OPERATORS.items() for i in range(1, n + 1)}
    assert covered == wanted


def test_every_query_has_sql():
    assert [e.name for e in REGISTRY.values() if e.sql is None] == []


@pytest.mark.parametrize("name", [n for n in REGISTRY if not n.startswith(("stream", "sink"))])
def test_plan_stays_distributed(spark, name):
    plan = plans.planned(compare.contract.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "Scan ExistingRDD"):
        assert bad not in plan
    for first in re.findall(r"windowspecdefinition\(([^,)]*)", plan):
        assert not re.search(r" (ASC|DESC) ", first), f"window without partition: {first}"


def test_entry(spark):
    result = compare.contract.entry(spark)
    assert result.columns == ["series", "bucket", "count"]
    assert result.count() == 14


@pytest.mark.parametrize("name", [
    "facet_terms_with_rest", "facet_terms_tokenised", "facet_tag_cloud", "facet_several",
    "pivot_facet", "pivot_matrix", "pivot_column_sums", "pivot_intensity", "pivot_ordered_rows",
    "derived_terms", "derived_terms_and", "derived_terms_or", "hits_per_query",
    "series_per_query", "series_trend", "series_fill_minimal", "series_fill_all",
    "series_required_times", "series_pad_edges", "table_field_presence", "facet_percent",
])
def test_one_scan(spark, name):
    assert plans.scans(compare.contract.queries()[name](spark, SMALL)) == 1
