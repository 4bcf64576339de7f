"""Reading and writing log tables laid out by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logscope.functions.times import day_key, ntz
from logscope.functions.windows import TimeWindow
from logscope.operators.predicates import keep


def write_by_day(df: DataFrame, path: str, time: str = "ts", mode: str = "errorifexists") -> None:
    """Write a table partitioned by ``day``.

    The rebalance hint lets adaptive execution split a heavy day over several
    tasks and merge light ones, so files stay near the advisory size.
    """
    with_day = df.withColumn("day", day_key(F.col(time)))
    with_day.hint("rebalance", F.col("day")).write.mode(mode).partitionBy("day").parquet(path)


def read_by_day(spark: SparkSession, path: str, schema) -> DataFrame:
    """A day table with its declared schema; ``day`` stays text."""
    return spark.read.schema(schema).parquet(path)


def scan(
    table: DataFrame, window: TimeWindow, time: str = "ts", max_span_days: int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Rows of a window. The ``day`` bounds prune partitions, the time bounds row groups.

    Windows that touch ``max_span_days`` day steps or more are refused before any job.
    """
    if max_span_days is not None:
        window.checked(max_span_days)
    rows = keep(table, where).where(window.covers(F.col(time)))
    if "day" in table.columns:
        first, last = window.day_keys()
        rows = rows.where(F.col("day").between(first, last))
    return rows


def list_days(spark: SparkSession, path: str, prefix: str = "tb_") -> DataFrame:
    """``(table)``: the day tables there are, from the names of the folders alone."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path, "day=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    days = sorted(f.getPath().getName().removeprefix("day=") for f in found or [])
    names = F.array(*(F.lit(prefix + d) for d in days)).cast("array<string>")
    return spark.range(1).select(F.explode(names).alias("table"))


def days_with_data(df: DataFrame, time: str, window: TimeWindow) -> DataFrame:
    """``(day)``: the days of a window that hold rows; wanted days and found days intersect."""
    wanted = df.sparkSession.range(0, window.day_span + 1, 1, 1).select(
        F.date_add(F.to_date(ntz(window.start)), F.col("id").cast("int")).alias("day")
    )
    found = scan(df, window, time).select(F.to_date(time).alias("day"))
    return wanted.intersect(found)


def field_catalogue(
    df: DataFrame, approximate_distinct: bool = False, where: Column | None = None
) -> DataFrame:
    """``(field, type, present)`` of every column in one pass, with ``values`` on demand."""
    rows, measures = [], []
    for i, field in enumerate(df.schema.fields):
        measures.append(F.count(F.col(field.name)).alias(f"_n{i}"))
        parts = [F.lit(field.name).alias("field"), F.lit(field.dataType.simpleString()).alias("type"),
                 F.col(f"_n{i}").alias("present")]
        if approximate_distinct:
            measures.append(F.approx_count_distinct(F.col(field.name)).alias(f"_d{i}"))
            parts.append(F.col(f"_d{i}").alias("values"))
        rows.append(F.struct(*parts))
    return keep(df, where).agg(*measures).select(F.inline(F.array(*rows)))


def rows_per_partition(df: DataFrame, day: str, shard: str) -> DataFrame:
    """``(day, shard, count)`` by day, then size, then shard number."""
    counts = df.groupBy(F.col(day).alias("day"), F.col(shard).alias("shard")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.orderBy("day", "count", "shard")


def latest_by_key(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One live row per key: the one with the highest version.

    Each map task already drops its own older rows, so a hot key does not travel whole.
    """
    newest = Window.partitionBy(*key).orderBy(*(F.col(v).desc() for v in version))
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")
