"""Counts and statistics by field value."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logscope.functions.numbers import percent_of, rescale
from logscope.functions.text import distinct_words
from logscope.operators.predicates import Query, any_query, excludes, flags, keep
from logscope.operators.ranking import top_per_group

Order = Literal["descending", "ascending"]
STATS = ("count", "min", "max", "mean", "sum")


def total(df: DataFrame, where: Column | None = None, name: str = "hits") -> DataFrame:
    """One row: the number of matching rows."""
    return keep(df, where).agg(F.count(F.lit(1)).alias(name))


def hits(df: DataFrame, queries: Sequence[Query], where: Column | None = None) -> DataFrame:
    """``(query, hits, total)`` for all queries in one scan.

    Rows that no query matches are dropped first, by the scan where it can.
    """
    if not queries:
        raise ValueError("hits need at least one query")
    counts = [F.count_if(flag).alias(f"_{i}") for i, flag in enumerate(flags(queries))]
    wide = keep(df, where).where(any_query(queries)).agg(*counts)
    rows = F.array(
        *(F.struct(F.lit(q.name).alias("query"), F.col(f"_{i}").alias("hits"))
          for i, q in enumerate(queries))
    )
    grand = sum((F.col(f"_{i}") for i in range(1, len(queries))), F.col("_0"))
    return wide.select(F.inline(rows), grand.alias("total"))


def value_counts(df: DataFrame, field: str | Column, where: Column | None = None) -> DataFrame:
    """``(value, count)`` over every value, the missing one included as null."""
    column = F.col(field) if isinstance(field, str) else field
    return keep(df, where).groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def _by_count(order: Order = "descending") -> list[Column]:
    count = F.col("count").desc() if order == "descending" else F.col("count").asc()
    return [count, F.col("value").asc()]


def _top_of_shared(groups: DataFrame, able: Column, order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` able groups of a table that other parts of the plan use too.

    Sorting the others last and dropping them after the limit keeps the condition
    above the aggregation, so all parts share its one scan and shuffle.
    """
    return groups.orderBy((~able).asc(), *order).limit(size).where(able)


def terms(
    df: DataFrame, field: str, size: int = 10, order: Order = "descending",
    exclude: Sequence = (), where: Column | None = None,
) -> DataFrame:
    """The ``size`` most frequent values, ties by value.

    ``ascending`` shows the same values, least frequent first.
    """
    counts = value_counts(df.where(excludes(field, exclude)), field, where)
    top = counts.where(F.col("value").isNotNull()).orderBy(*_by_count()).limit(size)
    return top if order == "descending" else top.orderBy(*_by_count("ascending"))


def terms_with_rest(
    df: DataFrame, field: str, size: int = 10, exclude: Sequence = (),
    where: Column | None = None, tokenised: bool = False,
) -> DataFrame:
    """:func:`terms` plus the rows ``missing`` and ``other``: ``(kind, value, count)``.

    ``other`` is all rows less the shown terms less the missing ones. For a
    tokenised field (a word list) rows and terms do not add up and it is 0.
    """
    column = F.explode_outer(F.array_distinct(F.col(field))) if tokenised else F.col(field)
    if not tokenised:
        df = df.where(excludes(field, exclude))
    counts = value_counts(keep(df, where).select(column.alias("value")), "value")
    if tokenised and exclude:
        counts = counts.where(excludes("value", exclude))
    top = _top_of_shared(counts, F.col("value").isNotNull(), _by_count(), size)
    shown = top.agg(F.coalesce(F.sum("count"), F.lit(0)))
    rest = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("_all"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("_none"),
    )
    other = F.lit(0).cast("bigint") if tokenised else (
        F.col("_all") - F.col("_none") - shown.scalar()
    )
    nothing = F.lit(None).cast(counts.schema["value"].dataType)
    extra = rest.select(F.inline(F.array(
        F.struct(F.lit("missing").alias("kind"), nothing.alias("value"),
                 F.col("_none").alias("count")),
        F.struct(F.lit("other").alias("kind"), nothing.alias("value"), other.alias("count")),
    )))
    return top.select(F.lit("term").alias("kind"), "value", "count").unionByName(extra)


def _stat(name: str, field: str) -> Column:
    if name == "count":
        return F.count(F.col(field))
    return {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}[name](F.col(field))


def stats(
    df: DataFrame, field: str | Column, of: str, measures: Sequence[str] = STATS[1:],
    where: Column | None = None,
) -> DataFrame:
    """Statistics of a numeric field for every value of another."""
    column = F.col(field) if isinstance(field, str) else field
    grouped = keep(df, where).groupBy(column.alias("value"))
    return grouped.agg(*(_stat(m, of).alias(m) for m in measures))


def stats_terms(
    df: DataFrame, field: str, of: str, mode: str = "mean", size: int = 10,
    order: Order = "descending", where: Column | None = None,
) -> DataFrame:
    """The ``size`` values with the largest (or smallest) statistic, ties by value.

    Unlike :func:`terms`, ``ascending`` shows the smallest of all values.
    """
    all_values = stats(df, field, of, [mode], where).where(F.col("value").isNotNull())
    key = F.col(mode).desc() if order == "descending" else F.col(mode).asc()
    return all_values.orderBy(key, F.col("value").asc()).limit(size)


def facets(
    df: DataFrame, fields: Sequence[str], limit: int | None = 10, where: Column | None = None
) -> DataFrame:
    """``(field, value, count)`` for several fields in one scan, ``limit`` values each.

    Values are shown as text; ties are broken by value; missing ones are left out.
    """
    texts = keep(df, where).select(*(F.col(f).cast("string").alias(f) for f in fields))
    long = texts.unpivot([], list(fields), "field", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts if limit is None else top_per_group(counts, ["field"], _by_count(), limit)


def tag_cloud(
    df: DataFrame, text: str, size: int = 100, stop_words: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """The words most rows hold: ``(word, count, share, max_share, size)``.

    ``share`` is of all matching rows; ``size`` is the font size, 5 to 35 by share.
    """
    base = keep(df, where)
    # Each row also brings one null word: its count is the number of rows, in the same pass.
    tokens = distinct_words(F.col(text), stop_words)
    one_null = F.array(F.lit(None).cast("string"))
    counts = value_counts(base.select(
        F.explode(F.concat(F.coalesce(tokens, F.array().cast("array<string>")), one_null)
                  ).alias("value")), "value")
    top = _top_of_shared(counts, F.col("value").isNotNull(), _by_count(), size)
    hits = counts.agg(F.max(F.when(F.col("value").isNull(), F.col("count")))).scalar()
    return cloud(top, hits)


def cloud(top: DataFrame, hits: Column) -> DataFrame:
    """Shares and font sizes of ``(value, count)`` rows, given the number of matching rows."""
    shares = top.select(F.col("value").alias("word"), "count", (F.col("count") / hits).alias("share"))
    # No more rows meet here than are shown.
    whole = shares.agg(
        F.collect_list(F.struct("word", "count", "share")).alias("_rows"),
        F.max("share").alias("max_share"),
    ).select(F.inline("_rows"), "max_share")
    font = F.lit(5.0) + rescale(F.col("share"), F.lit(0.0), F.col("max_share"), 0, 30)
    return whole.withColumn("size", font)


def region_counts(df: DataFrame, field: str, where: Column | None = None) -> DataFrame:
    """``(region, count)`` by upper-cased code, so mixed-case codes are one region."""
    found = value_counts(df, F.upper(F.col(field)), where).where(F.col("value").isNotNull())
    return found.withColumnRenamed("value", "region")


def region_stats(
    df: DataFrame, field: str, of: str, measures: Sequence[str] = STATS[1:],
    where: Column | None = None,
) -> DataFrame:
    """Statistics by upper-cased code."""
    found = stats(df, F.upper(F.col(field)), of, measures, where)
    return found.where(F.col("value").isNotNull()).withColumnRenamed("value", "region")


def top_field_values(
    df: DataFrame, field: str, count: int = 10, grouped: bool = False, where: Column | None = None
) -> DataFrame:
    """Top values of a field. A list counts by its members, or whole if ``grouped``.

    A missing value counts as ``""``.
    """
    base = keep(df, where)
    shown, kind = F.col(field), base.schema[field].dataType
    if isinstance(kind, T.ArrayType):
        nothing = F.array(F.lit(None).cast(kind.elementType))
        shown = F.to_json(shown) if grouped else F.explode(F.coalesce(shown, nothing))
    values = base.select(shown.alias("value")).select(
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value")
    )
    return value_counts(values, "value").orderBy(*_by_count()).limit(count)


def related_fields(
    df: DataFrame, field: str, others: Sequence[str], where: Column | None = None
) -> DataFrame:
    """``(field, count)``: in how many rows that have ``field`` each other field occurs."""
    has = F.col(field).isNotNull()
    queries = [Query(name, has & F.col(name).isNotNull()) for name in others]
    return hits(df, queries, where).select(F.col("query").alias("field"), F.col("hits").alias("count"))


def presence(df: DataFrame, fields: Sequence[str], where: Column | None = None) -> DataFrame:
    """``(field, present, percent)``: how many rows hold each field."""
    wide = keep(df, where).agg(
        F.count(F.lit(1)).alias("_rows"), *(F.count(F.col(f)).alias(f"_{f}") for f in fields)
    )
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("present"),
                              percent_of(F.col(f"_{f}"), F.col("_rows")).alias("percent"))
                     for f in fields))
    return wide.select(F.inline(rows))


def with_share(counts: DataFrame, count: str = "count", share: str = "share") -> DataFrame:
    """Add each row's share of the total; the total is a one-row subquery."""
    whole = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, F.try_divide(F.col(count), whole))


def with_percent(counts: DataFrame, count: str = "count", percent: str = "percent") -> DataFrame:
    """Add each row's percent of the total, floored to two digits."""
    whole = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(percent, percent_of(F.col(count), whole))


def derived_queries(
    df: DataFrame, field: str, size: int = 5, query: Column | None = None,
    mode: Literal["terms only", "AND", "OR"] = "terms only", rest: bool = True,
    exclude: Sequence = (), where: Column | None = None,
) -> DataFrame:
    """``(kind, query, hits)``: one query per top term and one for what none of them matches.

    The top terms are those of the rows ``query`` matches. Mode AND narrows each
    term query by ``query``, OR widens it. One grouped pass answers all: a term
    query's OR count is its own rows plus the matching rows of the other values.
    """
    base = keep(df, where)
    matches = F.lit(True) if query is None else F.coalesce(query, F.lit(False))
    groups = base.groupBy(F.col(field).alias("value")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(matches).alias("_q")
    )
    able = F.col("value").isNotNull() & (F.col("_q") > 0) & excludes("value", exclude)
    # Values differ, so the last field decides nothing; it makes every use need both counts.
    order = [F.col("_q").desc(), F.col("value").asc(), F.col("_n").asc()]
    top = _top_of_shared(groups, able, order, size)
    sums = groups.agg(F.struct(F.sum("_n").alias("_n"), F.sum("_q").alias("_q"))).scalar()
    if query is None or mode == "terms only":
        own, taken, every = F.col("_n"), F.col("_n"), sums["_n"]
    elif mode == "AND":
        own, taken, every = F.col("_q"), F.col("_q"), sums["_n"]
    else:
        own = F.col("_n") + sums["_q"] - F.col("_q")
        taken, every = F.col("_n") - F.col("_q"), sums["_n"] - sums["_q"]
    named = top.select(F.lit("term").alias("kind"), F.col("value").cast("string").alias("query"),
                       own.alias("hits"))
    if not rest:
        return named
    left = F.coalesce(every, F.lit(0)) - top.agg(F.coalesce(F.sum(taken), F.lit(0))).scalar()
    other = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit("other").alias("kind"), F.lit("other").alias("query"), left.alias("hits"))
    return named.unionByName(other)


def extents(df: DataFrame, fields: Sequence[str], where: Column | None = None) -> DataFrame:
    """One row: ``<field>_min`` and ``<field>_max`` for each field."""
    bounds = [b for f in fields for b in (F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"))]
    return keep(df, where).agg(*bounds)
