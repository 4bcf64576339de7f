"""A catalogue of fields kept by day: what each day holds, in sketches that merge.

A day's part is written with its rows and never needs them again: counts add up, and
distinct values merge as HyperLogLog sketches. A new or reloaded day writes its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logscope.functions.times import day_key

_SCHEMA = "field string, type string, rows bigint, present bigint, sketch binary, day string"


def put_catalogue(df: DataFrame, path: str, time: str) -> None:
    """Write the parts of the days in ``df``; parts of other days stay."""
    measures, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, field in enumerate(df.schema.fields):
        text = F.col(field.name).cast("string")
        measures += [F.count(F.col(field.name)).alias(f"_n{i}"), F.hll_sketch_agg(text).alias(f"_s{i}")]
        rows.append(F.struct(
            F.lit(field.name).alias("field"), F.lit(field.dataType.simpleString()).alias("type"),
            F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("present"), F.col(f"_s{i}").alias("sketch")))
    days = df.groupBy(day_key(F.col(time)).alias("day")).agg(*measures)
    days.select("day", F.inline(F.array(*rows))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_catalogue(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    """``(field, type, rows, present, values)`` over all days or those from first to last.

    ``values`` estimates the distinct ones. No log row is read.
    """
    parts = spark.read.schema(_SCHEMA).parquet(path)
    if days is not None:
        parts = parts.where(F.col("day").between(*days))
    return parts.groupBy("field", "type").agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("values"))
