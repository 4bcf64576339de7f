"""Pages of any number from a table kept in order.

Rows are range-partitioned by the whole order and each range is a folder; a small table
holds the number of rows of each. A page's place in the order says which folders it
overlaps, so only those are opened: the cost of page 100 000 is that of page 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logscope.operators.paging import Sort, checked_sort, order_columns


def write_pages(df: DataFrame, path: str, sort: Sort, key: Sequence[str], time: str,
                analysed: Sequence[str] = (), parts: int | None = None, mode: str = "errorifexists") -> None:
    """Lay out a table in a total order: the user's fields, then the key.

    ``parts`` is the number of ranges; by default adaptive execution sizes them.
    """
    full = checked_sort(df, sort, key, time, analysed)
    order = order_columns(full)
    laid = df.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    laid.withColumn("_part", F.spark_partition_id()).write.mode(mode).partitionBy("_part").parquet(f"{path}/rows")
    spark = df.sparkSession
    counts = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])
                               ).parquet(f"{path}/rows").groupBy("_part").count()
    counts.coalesce(1).write.mode(mode).parquet(f"{path}/counts")
    spark.createDataFrame(full, "field string, direction string").coalesce(1).write.mode(mode).json(f"{path}/order")


@dataclass(frozen=True)
class PageIndex:
    """An ordered table: ``ranges`` are ``(part, rows before it, rows in it)``, one a folder."""

    rows: DataFrame
    sort: tuple[tuple[str, str], ...]
    ranges: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return self.ranges[-1][1] + self.ranges[-1][2] if self.ranges else 0

    def slice(self, begin: int, end: int) -> DataFrame:
        """The rows from place ``begin`` up to ``end``, in order."""
        met = [r for r in self.ranges if r[1] < end and r[1] + r[2] > begin]
        opened = self.rows.where(F.col("_part").isin([r[0] for r in met])).drop("_part")
        if not met or begin >= end:
            return opened.limit(0)
        first = met[0][1]
        return opened.orderBy(*order_columns(self.sort)).limit(end - first).offset(begin - first)

    def page(self, number: int, size: int, total: int | None = None) -> DataFrame:
        """Page ``number`` (from 0) of ``size`` rows; ``total`` caps the rows of all pages."""
        if number < 0 or size < 0:
            raise ValueError("a page has a number and a size of 0 or more")
        begin, end = number * size, (number + 1) * size
        if total is not None:
            begin, end = min(begin, total), min(end, total)
        return self.slice(begin, end)

    def last_page(self, size: int) -> DataFrame:
        """The page that holds the last row."""
        return self.page(max(0, self.total - 1) // size, size)


def open_pages(spark: SparkSession, path: str, schema: T.StructType) -> PageIndex:
    """A written table; the driver holds a number for each of its folders, which it lists anyway."""
    counts = spark.read.schema("_part int, count bigint").parquet(f"{path}/counts").orderBy("_part").collect()
    before = [0, *accumulate(c["count"] for c in counts)]
    sort = spark.read.schema("field string, direction string").json(f"{path}/order").collect()
    kind = T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])
    return PageIndex(
        spark.read.schema(kind).parquet(f"{path}/rows"), tuple((s.field, s.direction) for s in sort),
        tuple((c["_part"], b, c["count"]) for c, b in zip(counts, before[:-1], strict=True)))
