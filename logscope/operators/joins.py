"""Key lookups and joins against top terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logscope.operators.facets import terms
from logscope.operators.predicates import keep


def look_up(hits: DataFrame, records: DataFrame, key: str, stubs: bool = True,
            hot_records: bool = False) -> DataFrame:
    """Full records of the hit keys. ``stubs`` keeps a key without a record, fields null.

    One join, so each table is read once. Adaptive execution splits a hot key of the
    hits; without stubs also one of the records, which as a rule hold a key once. For
    records with a hot key, ``hot_records`` joins them without stubs and adds the keys
    without a record, found in the records' keys alone.
    """
    if not (stubs and hot_records):
        return hits.join(records, key, "left" if stubs else "inner")
    found = hits.join(records, key)
    missing = hits.join(records.select(key).distinct(), key, "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def _top(df: DataFrame, field: str, size: int, exclude: Sequence, where: Column | None) -> DataFrame:
    top = terms(df, field, size, exclude=exclude, where=where)
    return top.select(F.col("value").alias(field))


def rows_of_top_terms(
    df: DataFrame, field: str, size: int, exclude: Sequence = (), where: Column | None = None
) -> DataFrame:
    """Rows whose field holds one of its ``size`` most frequent values."""
    return keep(df, where).join(_top(df, field, size, exclude, where), field, "left_semi")


def rows_of_other_terms(
    df: DataFrame, field: str, size: int, exclude: Sequence = (), where: Column | None = None
) -> DataFrame:
    """All other rows, those without a value included."""
    return keep(df, where).join(_top(df, field, size, exclude, where), field, "left_anti")
