"""Records kept in buckets by key, so that look-ups do not shuffle them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, types as T


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """Lay out records in ``buckets`` buckets by key, sorted inside each."""
    name = _name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).option(
        "path", path).saveAsTable(name)


def _name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The records at a path; joins and aggregations by the key read them where they lie."""
    name = _name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
