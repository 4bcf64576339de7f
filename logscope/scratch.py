"""Shared folders for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, or the session's warehouse where it is unset.

    A folder named there is taken to be shared. On a cluster a warehouse on local disks is
    refused: executors and driver would each see a folder of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    warehouse = hadoop_path(spark, spark.conf.get("spark.sql.warehouse.dir"))
    files = warehouse.getFileSystem(spark._jsc.hadoopConfiguration())
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    if files.getUri().getScheme() == "file" and not local:
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return warehouse.toString().rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the driver's JVM ends."""
    folder = f"{scratch_root(spark)}/logscope/{name}-{uuid.uuid4().hex}"
    hadoop = hadoop_path(spark, folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return f"{folder}/data"


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and age of a table's files: another pair after they were written anew."""
    hadoop = hadoop_path(spark, path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(hadoop).getLength(), files.getFileStatus(hadoop).getModificationTime()
