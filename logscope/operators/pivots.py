"""Two-dimensional counts. Cells are long rows ``(row, col, count)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logscope.functions.numbers import rescale
from logscope.operators.predicates import keep
from logscope.operators.ranking import top_per_group


def cell_counts(df: DataFrame, row: str, col: str, where: Column | None = None) -> DataFrame:
    """Counts of the value pairs that occur."""
    pairs = keep(df, where).where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return pairs.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(
        F.count(F.lit(1)).alias("count")
    )


# The operators below use one cell table several times. Each use needs the counts and
# none filters by a grouping column, so the uses share one scan and one shuffle.

def _sums(cells: DataFrame, side: str) -> DataFrame:
    return cells.groupBy(side).agg(F.sum("count").alias("_n"))


def _top(cells: DataFrame, side: str, limit: int) -> DataFrame:
    ordered = _sums(cells, side).orderBy(F.col("_n").desc(), F.col(side).asc())
    return ordered.limit(limit)


def _with_zero_cells(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Zero cells of every (row, column); the columns travel as one bounded list."""
    listed = columns.agg(F.collect_list(F.struct("col", "_n"))).scalar()
    return rows.select(
        "row", F.explode(listed["col"]).alias("col"), F.lit(0).cast("bigint").alias("count")
    )


def pivot(
    df: DataFrame, row: str, col: str, limit: int = 10, where: Column | None = None
) -> DataFrame:
    """The ``limit`` most frequent rows and, in each, its ``limit`` most frequent columns.

    Cells of zero are kept, over the column values present in the filtered
    rows. Only a row with fewer than ``limit`` columns shows zeros, and they go to
    the first values in order, so ``2 * limit`` candidates are enough.
    """
    cells = cell_counts(df, row, col, where)
    rows = _top(cells, "row", limit)
    candidates = _sums(cells, "col").orderBy("col").limit(2 * limit)
    shown = cells.join(rows.select("row"), "row")
    zeros = _with_zero_cells(rows, candidates)
    both = shown.unionByName(zeros).groupBy("row", "col").agg(F.sum("count").alias("count"))
    return top_per_group(both, ["row"], [F.col("count").desc(), F.col("col").asc()], limit)


def matrix(
    df: DataFrame, row: str, col: str, rows: int = 100, cols: int = 100,
    where: Column | None = None,
) -> DataFrame:
    """Every cell of the most frequent rows and columns, zeros included."""
    cells = cell_counts(df, row, col, where)
    top_rows, top_cols = _top(cells, "row", rows), _top(cells, "col", cols)
    shown = cells.join(top_rows.select("row"), "row").join(top_cols.select("col"), "col")
    zeros = _with_zero_cells(top_rows, top_cols)
    return shown.unionByName(zeros).groupBy("row", "col").agg(F.sum("count").alias("count"))


def column_sums(cells: DataFrame) -> DataFrame:
    """``(col, total, low, high)`` over the shown cells."""
    return cells.groupBy("col").agg(
        F.sum("count").alias("total"), F.min("count").alias("low"), F.max("count").alias("high")
    )


def domain(cells: DataFrame) -> DataFrame:
    """One row: smallest and largest cell."""
    return cells.agg(F.min("count").alias("low"), F.max("count").alias("high"))


def transpose(cells: DataFrame) -> DataFrame:
    """Rows as columns."""
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "count")


def order_rows(cells: DataFrame, by_col, descending: bool = True) -> DataFrame:
    """Cells in the order of their rows' counts in one column; ties by row.

    ``sort_count`` is that count, 0 for a row without the cell. A row's cells
    meet in one task: they are the columns a pivot shows.
    """
    wanted = F.max(F.when(F.col("col") == by_col, F.col("count")))
    valued = cells.withColumn(
        "sort_count", F.coalesce(wanted.over(Window.partitionBy("row")), F.lit(0))
    )
    first = F.col("sort_count").desc() if descending else F.col("sort_count").asc()
    return valued.orderBy(first, "row", "col")


def order_columns(cells: DataFrame, by_row, descending: bool = True) -> DataFrame:
    """Cells in the order of their columns' counts in one row; ties by column."""
    ordered = order_rows(transpose(cells), by_row, descending)
    return ordered.select(
        F.col("col").alias("row"), F.col("row").alias("col"), "count", "sort_count"
    )


def intensity(cells: DataFrame) -> DataFrame:
    """Each cell on a scale of 0 to 10 between the smallest and largest one."""
    bounds = domain(cells).select(F.struct("low", "high")).scalar()
    return cells.withColumn(
        "intensity", rescale(F.col("count"), bounds["low"], bounds["high"], 0, 10)
    )
