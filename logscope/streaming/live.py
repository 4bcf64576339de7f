"""Live panels over a stream of log rows.

A panel that polls a moving window becomes one query that keeps its result up
to date. Event time is wall time read as UTC, so buckets equal the batch ones
whatever the session zone is. Rows older than the watermark are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from logscope.functions.intervals import Interval
from logscope.functions.numbers import percent_change
from logscope.functions.times import day_key, from_instant, ntz, to_instant
from logscope.functions.windows import TimeWindow
from logscope.operators.predicates import Query, keep
from logscope.operators.series import anchor

_EVENT_TIME = "_event_time"


def stream_table(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
) -> DataFrame:
    """A stream over the files of a table, with a declared schema.

    ``path`` is a folder of files, or of one file the file itself. The bounds keep a
    backlog from becoming one batch; give at most one of them.
    """
    if files_per_trigger is not None and bytes_per_trigger is not None:
        raise ValueError("a batch is bounded by files or by bytes, not by both")
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isFile():
        # A source reads folders: the file is the one of its folder with that name.
        return reader.option("pathGlobFilter", _literal(place.getName())).parquet(
            place.getParent().toString())
    return reader.parquet(path)


def _literal(name: str) -> str:
    """A file name as a pattern that fits only itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def _seconds(duration: str) -> int:
    """Seconds of a duration such as ``15 minutes``."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", duration.lower())
    if found is None or int(found[1]) == 0:
        raise ValueError(f"not a duration of whole seconds to weeks: {duration}")
    return int(found[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[found[2]]


def with_event_time(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Add the event time column and its watermark."""
    return stream.withColumn(_EVENT_TIME, to_instant(F.col(time))).withWatermark(_EVENT_TIME, late)


def live_histogram(
    stream: DataFrame, time: str, window: TimeWindow, interval: Interval,
    queries: Sequence[Query], late: str = "1 hour", where: Column | None = None,
) -> DataFrame:
    """``(series, bucket, count)`` once a bucket is closed; buckets start at the window's start.

    Buckets are emitted where any row lies; the batch histogram zero-fills.
    """
    if interval.months:
        raise ValueError("a live histogram needs a bucket of fixed length")
    open_rows = keep(stream, where).where(F.col(time) >= ntz(window.start))
    timed = with_event_time(open_rows, time, late)
    bucket = F.window(
        _EVENT_TIME, f"{interval.micros} microseconds", startTime=anchor(window.start, interval)
    )
    counts = timed.groupBy(bucket.alias("_window")).agg(
        *(F.count_if(q.predicate).alias(f"_{i}") for i, q in enumerate(queries))
    )
    rows = F.array(*(F.struct(F.lit(q.name).alias("series"), F.col(f"_{i}").alias("count"))
                     for i, q in enumerate(queries)))
    return counts.select(
        from_instant(F.col("_window.start")).alias("bucket"), F.explode(rows).alias("_row")
    ).select("_row.series", "bucket", "_row.count")


def moving_hits(
    stream: DataFrame, time: str, length: str = "15 minutes", step: str = "1 minute",
    late: str = "1 hour", where: Column | None = None,
) -> DataFrame:
    """``(window_end, hits)``: matching rows of the last ``length``, every ``step``.

    Rows are counted by pane first, the greatest span that divides both ``length`` and
    ``step``, so a row is handled once and only the counts are spread over the windows
    they belong to.
    """
    if _seconds(step) > _seconds(length):
        raise ValueError("the step is longer than the window: rows between would not count")
    pane = f"{gcd(_seconds(length), _seconds(step))} seconds"
    timed = with_event_time(keep(stream, where), time, late)
    steps = timed.groupBy(F.window(_EVENT_TIME, pane).alias("window")).agg(
        F.count(F.lit(1)).alias("_hits"))
    sliding = F.window(F.window_time("window"), length, step).alias("_window")
    return steps.groupBy(sliding).agg(F.sum("_hits").alias("hits")).select(
        from_instant(F.col("_window.end")).alias("window_end"), "hits"
    )


def live_terms(
    stream: DataFrame, field: str, of: str | None = None, where: Column | None = None
) -> DataFrame:
    """Counts (and statistics of a number) by value; for complete or update mode.

    The state is one row per value: use a field whose values are bounded.
    """
    measures = [F.count(F.lit(1)).alias("count")]
    if of is not None:
        measures += [F.min(of).alias("min"), F.max(of).alias("max"),
                     F.avg(of).alias("mean"), F.sum(of).alias("sum")]
    return keep(stream, where).groupBy(F.col(field).alias("value")).agg(*measures)


def since_stream(stream: DataFrame, time: str, start: str, where: Column | None = None) -> DataFrame:
    """Rows from ``start`` on."""
    return keep(stream, where).where(F.col(time) >= ntz(start))


def without_copies(
    stream: DataFrame, key: Sequence[str], time: str, late: str = "1 hour"
) -> DataFrame:
    """One row per key among rows at most ``late`` apart, so a redelivery adds nothing."""
    timed = with_event_time(stream, time, late)
    return timed.dropDuplicatesWithinWatermark(list(key)).drop(_EVENT_TIME)


def day_sink(stream: DataFrame, time: str, path: str, checkpoint: str) -> DataStreamWriter:
    """An append writer into a table partitioned by ``day``."""
    return stream.withColumn("day", day_key(F.col(time))).writeStream.format("parquet").option(
        "path", path).option("checkpointLocation", checkpoint).partitionBy("day")


def table_sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append writer into a table; the file log makes each batch count once."""
    return stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint)


def result_sink(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A complete-mode writer: each batch adds the whole result as a new version.

    A version is a folder of its own, written again if its batch runs again, so
    readers of the version before it are never disturbed. Older ones are removed.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        _drop_versions(batch.sparkSession, path, batch_id)

    return stream.writeStream.outputMode("complete").option(
        "checkpointLocation", checkpoint).foreachBatch(replace)


def _drop_versions(spark: SparkSession, path: str, newest: int, keep_last: int = 2) -> None:
    """Remove all but the last versions below a folder of results."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path, "batch=*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = {int(f.getPath().getName().removeprefix("batch=")): f.getPath()
               for f in files.globStatus(pattern) or []}
    for number in sorted(n for n in numbers if n <= newest)[:-keep_last]:
        files.delete(numbers[number], True)


def latest_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version in a folder of results."""
    versions = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    newest = versions.agg(F.max("batch")).scalar()
    return versions.where(F.col("batch") == newest).drop("batch")


def trend_of_buckets(
    buckets: DataFrame, window: TimeWindow, ago: timedelta
) -> DataFrame:
    """``(query, now, then, percent)`` from closed ``(series, bucket, count)`` rows."""
    now, then = window, window.earlier(ago)
    at = F.col("bucket")
    sums = buckets.where(now.covers_half_open(at) | then.covers_half_open(at)).groupBy(
        F.col("series").alias("query")
    ).agg(
        F.coalesce(F.sum(F.when(now.covers_half_open(at), F.col("count"))), F.lit(0)).alias("now"),
        F.coalesce(F.sum(F.when(then.covers_half_open(at), F.col("count"))), F.lit(0)).alias("then"),
    )
    return sums.withColumn("percent", percent_change(F.col("then"), F.col("now")))


def trend_sink(
    histogram: DataFrame, table: str, result: str, checkpoint: str,
    window: TimeWindow | None = None, ago: timedelta = timedelta(days=7),
    length: timedelta = timedelta(days=7), interval: Interval | None = None,
) -> DataStreamWriter:
    """Keep the closed buckets in ``table`` and versions of the trend over them in ``result``.

    Without a fixed ``window`` the trend moves on with the stream: it is over the
    ``length`` up to the end of the newest closed bucket, one ``interval`` long. The
    buckets are laid out by day, so a refresh reads only the days of its two windows.
    """
    if window is None and interval is None:
        raise ValueError("a moving trend needs the interval of its buckets")

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _put_buckets(batch, batch_id, table)
        # From what was written: asking the batch again would run its state a second time.
        closed = spark.read.schema(f"{_BUCKET_SCHEMA}, day string, batch bigint").parquet(table)
        newest = closed.where(F.col("batch") == batch_id).agg(F.max("bucket")).first()[0]
        if newest is None:
            return
        end = newest + interval.delta if interval else None
        now = window or TimeWindow(end - length, end)
        first, last = day_of(now.earlier(ago).start), day_of(now.end)
        trend_of_buckets(closed.where(F.col("day").between(first, last)), now, ago).write.mode(
            "overwrite").parquet(f"{result}/batch={batch_id}")
        _drop_versions(spark, result, batch_id)

    return histogram.writeStream.outputMode("append").option(
        "checkpointLocation", checkpoint).foreachBatch(refresh)


def _put_buckets(batch: DataFrame, batch_id: int, table: str) -> None:
    """Add the closed buckets of a batch; a batch that runs again replaces its own."""
    rows = batch.withColumns({"day": day_key(F.col("bucket")), "batch": F.lit(batch_id)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day", "batch").parquet(table)


def day_of(moment) -> str:
    return moment.strftime("%Y%m%d")


_BUCKET_SCHEMA = "series string, bucket timestamp_ntz, count bigint"


def run_available(writer: DataStreamWriter) -> None:
    """Work off everything there is, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
