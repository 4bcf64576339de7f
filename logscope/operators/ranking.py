"""Top rows per group and ranks, safe when one group, or one moment, holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logscope.scratch import scratch_path


def _cut_in_map_tasks(df: DataFrame, n: int) -> bool:
    """Whether the session lets Spark cut groups at rank ``n`` before the shuffle."""
    return n <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def _last_slice_needed(counts: DataFrame, groups: Sequence[Column], n: int) -> DataFrame:
    """From ``(_slice, count)`` rows the slice, by group, where the running count reaches ``n``."""
    run = Window.partitionBy(*groups).orderBy("_slice")
    before = F.coalesce(F.sum("count").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_before", before).where(F.col("_before") < n)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column], number: str) -> DataFrame:
    """Number the rows of each group from 1 in a (total) order.

    Rows are range-partitioned by group and order, so a hot group lies in many parts
    even if all its rows share one moment. The parts are written in order, each row with
    its part and its place there. What has to be added to that place is one number for each
    group in each part: how many rows the group has in the parts before, less the place
    where it begins in this one.
    """
    path = scratch_path(df.sparkSession, "ranked")
    keys = [F.col(g).asc() for g in groups]
    parts = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = parts.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id())
    placed.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    named = [F.col(g).alias(f"_of_{i}") for i, g in enumerate(groups)]
    counts = rows.groupBy(*named, F.col("_part").alias("_of_part")).agg(
        F.count(F.lit(1)).alias("count"), F.min("_place").alias("_first"))
    within = [f"_of_{i}" for i in range(len(groups))] or [_one_group("count")]
    earlier = Window.partitionBy(*within).orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("count").over(earlier), F.lit(0)) - F.col("_first") + 1)
    same = [rows[g].eqNullSafe(shifts[f"_of_{i}"]) for i, g in enumerate(groups)]
    joined = rows.join(shifts, [*same, rows["_part"] == shifts["_of_part"]])
    return joined.withColumn(number, F.col("_place") + F.col("_shift")).select(*df.columns, number)


def _one_group(count: str) -> Column:
    """A partition key for all rows of a table of counts, which are never negative.

    So a window over it is one task: it takes a row for each part or slice, not for each row.
    """
    return F.col(count) < 0


def first_rows(df: DataFrame, slice_by: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a (total) ascending order.

    ``slice_by`` must not decrease along that order, such as the hour of the
    leading time. For a large ``n`` the rows are counted by slice first, and only
    those of the slices that reach ``n`` are sorted, each task a part of them.
    """
    if _cut_in_map_tasks(df, n):
        return df.orderBy(*order).limit(n)
    counts = df.groupBy(slice_by.alias("_slice")).count()
    cut = _last_slice_needed(counts, [_one_group("count")], n).agg(F.max("_slice")).scalar()
    near = df.where(slice_by.isNull() | (slice_by <= cut))
    return numbered(near, [], order, "_number").where(F.col("_number") <= n).drop(
        "_number").orderBy(*order)


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None,
    slice_by: Column | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group in the given (total) order.

    A small ``n`` is cut in the map tasks. For a large one, ``slice_by`` (see
    :func:`first_rows`) first drops the slices a group does not need; what is left is
    numbered in parts of even size, whatever the groups' sizes.
    """
    name = rank or "_rank"
    if _cut_in_map_tasks(df, n):
        whole = Window.partitionBy(*groups).orderBy(*order)
        ranked = df.withColumn(name, F.row_number().over(whole))
    else:
        if slice_by is not None:
            df = _needed_slices(df, groups, slice_by, n)
        ranked = numbered(df, groups, order, name)
    ranked = ranked.where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def _needed_slices(df: DataFrame, groups: Sequence[str], slice_by: Column, n: int) -> DataFrame:
    sliced = df.withColumn("_slice", slice_by)
    keys = [f"_of_{g}" for g in groups]
    counts = sliced.groupBy(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)),
                            "_slice").count()
    cuts = _last_slice_needed(counts, [F.col(k) for k in keys], n).groupBy(*keys).agg(
        F.max("_slice").alias("_cut"))
    same = [sliced[g].eqNullSafe(cuts[k]) for g, k in zip(groups, keys, strict=True)]
    early = F.col("_slice").isNull() | (F.col("_slice") <= F.col("_cut"))
    return sliced.join(cuts, [*same, early]).select(*df.columns)


def rank_in_group(
    df: DataFrame, group: str, slice_by: Column, order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """Number the rows of each group from 1 in a (total) order.

    ``slice_by`` must not decrease along that order. A group is spread over
    as many tasks as its share of the rows asks for, also if one slice holds it all.
    """
    return numbered(df, [group], [slice_by, *order], rank)
