"""Set operations on results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several day tables; a column absent from one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_labelled(results: Mapping[str, DataFrame], label: str = "query") -> DataFrame:
    """Results below each other, each row with the name of its result."""
    named = [df.select(F.lit(name).alias(label), "*") for name, df in results.items()]
    return union_tables(named)


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows in both."""
    return left.intersect(right)


def distinct_union(results: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows of all results."""
    return union_tables(results).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` does not hold."""
    return left.subtract(right)
