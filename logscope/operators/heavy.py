"""Exact top values of fields with more values than a shuffle should carry.

A first pass counts rows by cell, a cell being a hash of the value: a bounded sketch that
tasks merge, in which a cell's count is never below that of any value in it. Values in the
fullest cells are then counted exactly. If the last of the best ``size`` values occurs more
often than any cell not looked at, no value outside can be among them: that is the
certificate. Else every cell that reaches that count is looked at, which is exact in any case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logscope.functions.text import distinct_words
from logscope.operators.facets import cloud, excludes, keep
from logscope.scratch import scratch_path

#: Cells of the sketch: 16 bytes each, so a broadcast of all of them is a megabyte.
CELLS = 1 << 16


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Top:
    """The best values, how many exact passes they took, and the rows of the sketch."""

    rows: DataFrame
    passes: int
    sketch: DataFrame


def _in_cells(values: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(value, count)`` of the chosen cells; there are at most as many as the sketch has."""
    return values.join(F.broadcast(chosen.select("cell")), "cell", "left_semi").groupBy("value").agg(
        F.count(F.lit(1)).alias("count"))


def top_values(values: DataFrame, size: int, cells: int = CELLS, look: int | None = None) -> Top:
    """The ``size`` most frequent of a one-column table, ties by value; nulls lie in cell -1.

    ``look`` is how many cells the first exact pass takes, four for each value by default.
    """
    hashed = values.toDF("value").withColumn("cell", F.when(
        F.col("value").isNull(), -1).otherwise(F.pmod(F.xxhash64("value"), F.lit(cells))).cast("int"))
    sketch = _kept(hashed.groupBy("cell").agg(F.count(F.lit(1)).alias("count")), "cells")
    able, look = sketch.where("cell >= 0"), look or max(64, 4 * size)
    fullest = able.orderBy(F.col("count").desc(), "cell")

    def best(chosen: DataFrame) -> DataFrame:
        found = _in_cells(hashed, chosen).orderBy(F.col("count").desc(), "value").limit(size)
        return _kept(found, "top-values")

    rows = best(fullest.limit(look))
    reached, n = rows.agg(F.min("count"), F.count(F.lit(1))).first()
    unseen = fullest.offset(look).limit(1).select("count").first()
    if unseen is None or (n == size and (size == 0 or unseen[0] < reached)):
        return Top(rows, 1, sketch)
    # Values that tie with the last one count as well; too few values ask for every cell.
    return Top(best(able.where(F.col("count") >= (reached if n == size else 0))), 2, sketch)


def terms(df: DataFrame, field: str, size: int = 10, exclude: Sequence = (),
          where: Column | None = None, cells: int = CELLS) -> DataFrame:
    """As :func:`logscope.operators.facets.terms`, by sketch."""
    base = keep(df.where(excludes(field, exclude)), where)
    return top_values(base.select(field), size, cells).rows


def terms_with_rest(df: DataFrame, field: str, size: int = 10, exclude: Sequence = (),
                    where: Column | None = None, cells: int = CELLS) -> DataFrame:
    """As :func:`logscope.operators.facets.terms_with_rest`, by sketch; it also holds the rest."""
    base = keep(df.where(excludes(field, exclude)), where)
    top = top_values(base.select(field), size, cells)
    zero = F.lit(0).cast("bigint")
    sums = top.sketch.agg(
        F.coalesce(F.sum("count"), zero).alias("_all"),
        F.coalesce(F.sum(F.when(F.col("cell") == -1, F.col("count"))), zero).alias("_none"))
    shown = top.rows.agg(F.coalesce(F.sum("count"), zero)).scalar()
    nothing = F.lit(None).cast(df.schema[field].dataType)
    rest = sums.select(F.inline(F.array(
        F.struct(F.lit("missing").alias("kind"), nothing.alias("value"), F.col("_none").alias("count")),
        F.struct(F.lit("other").alias("kind"), nothing.alias("value"),
                 (F.col("_all") - F.col("_none") - shown).alias("count")))))
    return top.rows.select(F.lit("term").alias("kind"), "value", "count").unionByName(rest)


def tag_cloud(df: DataFrame, text: str, size: int = 100, stop_words: Sequence[str] = (),
              where: Column | None = None, cells: int = CELLS) -> DataFrame:
    """As :func:`logscope.operators.facets.tag_cloud`, by sketch: words are not bounded either."""
    tokens = distinct_words(F.col(text), stop_words)
    one_null = F.array(F.lit(None).cast("string"))
    spread = keep(df, where).select(F.explode(
        F.concat(F.coalesce(tokens, F.array().cast("array<string>")), one_null)).alias("value"))
    top = top_values(spread, size, cells)
    hits = top.sketch.agg(F.max(F.when(F.col("cell") == -1, F.col("count")))).scalar()
    return cloud(top.rows, hits)
