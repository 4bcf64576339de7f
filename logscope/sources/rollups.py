"""Counters kept by minute, and windows answered from them.

A rollup holds how many rows each minute has, in all and for each value of chosen fields. A
window is answered from the counters of its whole minutes; only the rows of the minutes it
cuts are read from the log. Loads and streams add counters of their own, which are summed
when read; a batch that runs again replaces its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from logscope.functions.intervals import Interval
from logscope.functions.numbers import percent_change
from logscope.functions.times import day_key, floor_to, ntz
from logscope.functions.windows import TimeWindow
from logscope.operators import series
from logscope.operators.predicates import Query, match_all, term
from logscope.sources.tables import scan

MINUTE = timedelta(minutes=1)
_SCHEMA = "minute timestamp_ntz, value string, count bigint, day string, field string, batch bigint"
#: The field of the counters over all rows.
_ALL = "_all"


def counters(df: DataFrame, time: str, fields: Sequence[str]) -> DataFrame:
    """``(minute, value, count, day, field)`` of a table's rows; rows without a time have no minute."""
    rows = df.where(F.col(time).isNotNull()).select(
        floor_to(F.col(time), "MINUTE").alias("minute"), F.lit(None).cast("string").alias(_ALL),
        *(F.col(f).cast("string").alias(f) for f in fields))
    # Counting whole rows first leaves one row a minute and combination to spread out.
    few = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("count"))
    long = few.unpivot(["minute", "count"], [_ALL, *fields], "field", "value")
    sums = long.groupBy("minute", "field", "value").agg(F.sum("count").alias("count"))
    return sums.select("minute", "value", "count", day_key(F.col("minute")).alias("day"), "field")


def put_counters(df: DataFrame, path: str, time: str, fields: Sequence[str], batch: int = 0) -> None:
    """Add a load's counters; loading a batch number again replaces what it had counted there."""
    rows = counters(df, time, fields).withColumn("batch", F.lit(batch).cast("bigint"))
    rows.hint("rebalance", F.col("day"), F.col("field")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day", "field", "batch").parquet(path)


def counter_sink(stream: DataFrame, path: str, checkpoint: str, time: str,
                 fields: Sequence[str]) -> DataStreamWriter:
    """Keep counters up to date with a stream; every micro-batch is counted once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        put_counters(batch, path, time, fields, batch_id)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


@dataclass(frozen=True)
class Term:
    """A named query the counters can answer: every row, or those with a value in a field."""

    name: str
    field: str | None = None
    value: str | None = None

    def on_rows(self) -> Query:
        return Query(self.name, match_all() if self.field is None else
                     term(self.field, self.value))

    def on_counters(self) -> Column:
        if self.field is None:
            return F.col("field") == _ALL
        return (F.col("field") == self.field) & (F.col("value") == F.lit(self.value).cast("string"))


def _up(moment: datetime) -> datetime:
    down = _down(moment)
    return down if down == moment else down + MINUTE


def _down(moment: datetime) -> datetime:
    return moment.replace(second=0, microsecond=0)


@dataclass(frozen=True)
class Rollup:
    """Counters at a path over a log table with a ``day`` column."""

    spark: SparkSession
    path: str
    log: DataFrame
    time: str
    fields: tuple[str, ...]

    def _minutes(self, first: datetime, last: datetime, fields: Sequence[str]) -> DataFrame:
        """Counters of the minutes from ``first`` up to ``last``."""
        unknown = set(fields) - {*self.fields, _ALL}
        if unknown:
            raise ValueError(f"fields without counters: {sorted(unknown)}")
        days = (first.strftime("%Y%m%d"), last.strftime("%Y%m%d"))
        at = F.col("minute")
        return self.spark.read.schema(_SCHEMA).parquet(self.path).where(
            F.col("day").between(*days) & F.col("field").isin(sorted(set(fields)))
            & (at >= ntz(first)) & (at < ntz(last)))

    def _edges(self, window: TimeWindow, to_end: bool) -> list[DataFrame]:
        """Rows of the log in minutes that the window cuts; ``to_end``: the end itself is inside."""
        first, last = _up(window.start), _down(window.end)
        at = F.col(self.time)
        before_end = at <= ntz(window.end) if to_end else at < ntz(window.end)
        if first >= last:
            return [scan(self.log, window, self.time).where(before_end)]
        found = []
        if window.start < first:
            found.append(scan(self.log, TimeWindow(window.start, first), self.time).where(at < ntz(first)))
        if last < window.end or to_end:
            found.append(scan(self.log, TimeWindow(last, window.end), self.time).where(before_end))
        return found

    def _pieces(self, window: TimeWindow, terms: Sequence[Term], to_end: bool) -> DataFrame:
        """``(at, one weight a term)`` whose sums over the window are the terms' counts."""
        weigh = lambda flag, n: F.when(flag, n).otherwise(0).cast("bigint")
        parts = [edge.select(F.col(self.time).alias("at"), *(
            weigh(t.on_rows().predicate, 1).alias(f"_{i}") for i, t in enumerate(terms)))
            for edge in self._edges(window, to_end)]
        first, last = _up(window.start), _down(window.end)
        if first < last:
            inner = self._minutes(first, last, [t.field or _ALL for t in terms])
            parts.append(inner.select(F.col("minute").alias("at"), *(
                weigh(t.on_counters(), F.col("count")).alias(f"_{i}") for i, t in enumerate(terms))))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def histogram(self, window: TimeWindow, interval: Interval, terms: Sequence[Term]) -> DataFrame:
        """As :func:`logscope.operators.series.histogram`, ``(series, bucket, count)`` with zeros.

        Buckets whose bounds cut minutes cannot be told from counters: then the log is read.
        """
        whole_minutes = _down(window.start) == window.start and (
            interval.months or interval.micros % 60_000_000 == 0)
        if not whole_minutes:
            return series.histogram(scan(self.log, window, self.time), self.time, window, interval,
                                    [t.on_rows() for t in terms])
        n, names = series.bucket_count(window, interval), [f"_{i}" for i in range(len(terms))]

        def start_of(number: Column) -> Column:
            return series.bucket_start(number, window.start, interval)

        rows = self._pieces(window, terms, to_end=True).select(
            series.bucket_of(F.col("at"), window.start, interval).alias("bucket"), *names
        ).where(F.col("bucket") < start_of(F.lit(n)))
        spine = self.spark.range(0, n, 1, 1 + n // 1_000_000).select(
            start_of(F.col("id")).alias("bucket"), *(F.lit(0).cast("bigint").alias(c) for c in names))
        sums = rows.unionByName(spine).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names))
        return sums.select(F.inline(F.array(*(
            F.struct(F.lit(t.name).alias("series"), F.col("bucket"), F.col(f"_{i}").alias("count"))
            for i, t in enumerate(terms)))))

    def _totals(self, window: TimeWindow, terms: Sequence[Term], to_end: bool) -> list[Column]:
        zero = F.lit(0).cast("bigint")
        sums = self._pieces(window, terms, to_end).agg(F.array(*(
            F.coalesce(F.sum(f"_{i}"), zero) for i in range(len(terms))))).scalar()
        return [F.get(sums, F.lit(i)) for i in range(len(terms))]

    def hits(self, window: TimeWindow, terms: Sequence[Term]) -> DataFrame:
        """``(query, hits)`` over a window, both ends included."""
        found = self._totals(window, terms, to_end=True)
        return self.spark.range(1).select(F.inline(F.array(*(
            F.struct(F.lit(t.name).alias("query"), n.alias("hits")) for t, n in zip(terms, found, strict=True)))))

    def trend(self, window: TimeWindow, ago: timedelta, terms: Sequence[Term]) -> DataFrame:
        """As :func:`logscope.operators.series.trend`: both windows exclude their end."""
        now = self._totals(window, terms, to_end=False)
        then = self._totals(window.earlier(ago), terms, to_end=False)
        return self.spark.range(1).select(F.inline(F.array(*(
            F.struct(F.lit(t.name).alias("query"), a.alias("now"), b.alias("then"),
                     percent_change(b, a).alias("percent"))
            for t, a, b in zip(terms, now, then, strict=True)))))

    def terms(self, field: str, window: TimeWindow, size: int = 10) -> DataFrame:
        """As :func:`logscope.operators.facets.terms` over a window, values as text."""
        parts = [edge.select(F.col(field).cast("string").alias("value"), F.lit(1).cast("bigint").alias("count"))
                 for edge in self._edges(window, to_end=True)]
        first, last = _up(window.start), _down(window.end)
        if first < last:
            parts.append(self._minutes(first, last, [field]).select("value", "count"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.where(F.col("value").isNotNull()).groupBy("value").agg(
            F.sum("count").alias("count")).orderBy(F.col("count").desc(), "value").limit(size)
