"""What several operators share: written tables, words and safe column names."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.scratch import scratch_path

#: ASCII white space, as a character class for Java and for RE2.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str, *apart: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again.

    This cuts the lineage: an executor lost later costs a read, not the work before. Rows
    that differ in the columns ``apart`` go to folders of their own.
    """
    return written_at(df, scratch_path(df.sparkSession, name), *apart)


def written_at(df: DataFrame, path: str, *apart: str) -> DataFrame:
    """:func:`written` to a given path, for tables that :func:`discard` removes early."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*apart).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    bare = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(bare, F.lit("")) == "", none).otherwise(F.split(bare, f"{SPACE}+"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster that ships the package (``--py-files``) does not need it.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
