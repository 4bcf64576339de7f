"""Deterministic order, top-k and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from logscope.functions.text import shard_number

Sort = Sequence[tuple[str, str]]


def toggled(current: tuple[str, str] | None, field: str) -> tuple[str, str]:
    """The next sort after a click on a field: turn it round, or start descending."""
    if current is not None and current[0] == field:
        return field, "desc" if current[1] == "asc" else "asc"
    return field, "desc"


def checked_sort(
    df: DataFrame, sort: Sort, key: Sequence[str], time: str, analysed: Sequence[str] = ()
) -> list[tuple[str, str]]:
    """The full order: known fields as asked, unknown ones as the time field, then the key.

    Analysed text cannot be sorted on; asking for it raises before any job.
    """
    full: list[tuple[str, str]] = []
    for field, direction in sort:
        if field in analysed:
            raise ValueError(f"analysed text cannot be sorted: {field}")
        if direction not in ("asc", "desc"):
            raise ValueError(f"sort direction not recognised: {direction}")
        name = field if field in df.columns else time
        if name not in (f for f, _ in full):
            full.append((name, direction))
    return full + [(k, "asc") for k in key if k not in (f for f, _ in full)]


def order_columns(sort: Sort) -> list[Column]:
    """Spark orders: nulls first ascending, last descending; text by bytes."""
    return [
        F.col(f).asc_nulls_first() if d == "asc" else F.col(f).desc_nulls_last() for f, d in sort
    ]


def sorted_rows(
    df: DataFrame, sort: Sort, key: Sequence[str], time: str, analysed: Sequence[str] = ()
) -> DataFrame:
    """All rows in a total order (a range shuffle, no single task)."""
    return df.orderBy(*order_columns(checked_sort(df, sort, key, time, analysed)))


def top_rows(
    df: DataFrame, sort: Sort, key: Sequence[str], time: str, k: int, analysed: Sequence[str] = ()
) -> DataFrame:
    """The first ``k`` rows; each task keeps ``k`` of its own before the merge."""
    return sorted_rows(df, sort, key, time, analysed).limit(k)


def page(
    df: DataFrame, sort: Sort, key: Sequence[str], time: str, number: int, size: int,
    total: int | None = None, analysed: Sequence[str] = (),
) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; ``total`` caps the rows of all pages.

    Every task keeps the rows up to the page's end, so this is for the first
    pages; walk further with :func:`page_after`.
    """
    if number < 0 or size < 0:
        raise ValueError("a page has a number and a size of 0 or more")
    begin, end = number * size, (number + 1) * size
    if total is not None:
        begin, end = min(begin, total), min(end, total)
    ordered = sorted_rows(df, sort, key, time, analysed)
    return ordered.limit(end).offset(begin)


def _same(field: str, value) -> Column:
    return F.col(field).isNull() if value is None else F.col(field) == F.lit(value)


def _beyond(field: str, value, direction: str, or_same: bool = False) -> Column:
    column = F.col(field)
    if direction == "asc":
        if value is None:
            return F.lit(True) if or_same else column.isNotNull()
        return column >= F.lit(value) if or_same else column > F.lit(value)
    if value is None:
        return column.isNull() if or_same else F.lit(False)
    return (column <= F.lit(value) if or_same else column < F.lit(value)) | column.isNull()


def after(sort: Sort, last: Mapping) -> Column:
    """Rows that follow the ``last`` one in a total order, by value rather than position.

    The leading bound on the first field is implied; it is there to reach the scan.
    """
    cases = []
    for i, (field, direction) in enumerate(sort):
        prefix = [_same(f, last[f]) for f, _ in sort[:i]]
        cases.append(reduce(and_, [*prefix, _beyond(field, last[field], direction)]))
    first, direction = sort[0]
    return _beyond(first, last[first], direction, or_same=True) & reduce(or_, cases)


def page_after(
    df: DataFrame, sort: Sort, key: Sequence[str], time: str, size: int, last: Mapping | None,
    analysed: Sequence[str] = (),
) -> DataFrame:
    """The ``size`` rows that follow a cursor; the first page without one.

    The cost does not grow with the depth of the page.
    """
    full = checked_sort(df, sort, key, time, analysed)
    rest = df if last is None else df.where(after(full, last))
    return rest.orderBy(*order_columns(full)).limit(size)


def cursor(
    page_rows: DataFrame, sort: Sort, key: Sequence[str], time: str,
    analysed: Sequence[str] = (),
) -> dict | None:
    """The last row's sort values, one row to the driver; ``None`` after an empty page."""
    full = checked_sort(page_rows, sort, key, time, analysed)
    turned = [
        F.col(f).desc_nulls_last() if d == "asc" else F.col(f).asc_nulls_first() for f, d in full
    ]
    row = page_rows.select(*(_plain(page_rows, f) for f, _ in full)).orderBy(*turned).first()
    return None if row is None else row.asDict()


def _plain(df: DataFrame, field: str) -> Column:
    # Times travel as text: a Python datetime literal would pass through the local zone.
    kind = df.schema[field].dataType.typeName()
    return F.col(field).cast("string").alias(field) if kind.startswith("timestamp") else F.col(field)


def by_shard(df: DataFrame, day: str, shard: str, key: str) -> DataFrame:
    """Rows by day, then by the shard's number (2 before 15), then by key."""
    return df.orderBy(day, shard_number(F.col(shard)), key)
