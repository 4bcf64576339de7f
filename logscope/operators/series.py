"""Time and numeric histograms, zero-filling, trends and raw series."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta
from decimal import Decimal
from functools import partial
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from logscope.functions.intervals import Interval, auto_interval
from logscope.functions.numbers import percent_change, to_number
from logscope.functions.times import hour_number, literal_micros, ntz
from logscope.functions.windows import TimeWindow
from logscope.operators.predicates import Query, any_query, flags, keep, match_all
from logscope.operators.ranking import first_rows, top_per_group


def bucket_start(number: Column, start: datetime, interval: Interval) -> Column:
    """Where bucket ``number``, counted from 0 at ``start``, begins.

    Month and year buckets begin at ``start`` plus whole months, each derived
    from ``start`` itself, so the 31st clamps without drifting.
    """
    if interval.months:
        return F.timestamp_add("MONTH", number * interval.months, ntz(start))
    return F.timestamp_add("MICROSECOND", number.cast("bigint") * interval.micros, ntz(start))


def bucket_of(ts: Column, start: datetime, interval: Interval) -> Column:
    """Where the bucket a time falls into begins. One a select, as Spark's ``window`` demands."""
    if not interval.months:
        return F.window(ts, f"{interval.micros} microseconds", startTime=anchor(start, interval))["start"]
    months = (F.year(ts) - start.year) * 12 + F.month(ts) - start.month
    begun = F.timestamp_add("MONTH", months, ntz(start)) <= ts
    number = F.floor((months - F.when(begun, 0).otherwise(1)) / F.lit(interval.months))
    return bucket_start(number.cast("bigint"), start, interval)


def anchor(start: datetime, interval: Interval) -> str:
    """How far windows counted from 1970 must move to begin at ``start``."""
    return f"{literal_micros(start) % interval.micros} microseconds"


def bucket_count(window: TimeWindow, interval: Interval) -> int:
    """Buckets that begin before the window's end."""
    if not interval.months:
        return ceil(window.length / interval.delta)
    start, end = window.start, window.end
    months = (end.year - start.year) * 12 + end.month - start.month
    # The last begun month counts only if it begins before the end.
    rest = (end.day, end.time()) > (start.day, start.time())
    return ceil((months + (1 if rest else 0)) / interval.months)


def _filled(
    rows: DataFrame, n_buckets: int, start_of: Callable[[Column], Column]
) -> DataFrame:
    """``(bucket, one count per flag)`` with every bucket present.

    The empty buckets join the rows as all-false ones before the only
    aggregation: one shuffle of partial counts, no join.
    """
    names = rows.columns[1:]
    spine = rows.sparkSession.range(0, n_buckets, 1, 1 + n_buckets // 1_000_000).select(
        start_of(F.col("id")).alias("bucket"), *(F.lit(False).alias(f) for f in names)
    )
    counts = [F.count_if(f).alias(f) for f in names]
    return rows.unionByName(spine).groupBy("bucket").agg(*counts)


def _series_rows(queries: Sequence[Query]) -> Column:
    return F.inline(F.array(*(
        F.struct(F.lit(q.name).alias("series"), F.col("bucket"), F.col(f"_{i}").alias("count"))
        for i, q in enumerate(queries)
    )))


def histogram(
    df: DataFrame, time: str, window: TimeWindow, interval: Interval | None = None,
    queries: Sequence[Query] | None = None, where: Column | None = None, bars: int = 100,
) -> DataFrame:
    """``(series, bucket, count)``, zeros included, buckets anchored at the window's start.

    Each bucket is ``[start, start + interval)`` and the last may pass the
    window's end. Rows are those inside the window, both ends included, so a row
    exactly at the end may fall outside every bucket. All queries share one scan.
    """
    interval = interval or auto_interval(window.length, bars)
    named = list(queries) if queries else [Query("all", match_all())]
    n_buckets = bucket_count(window, interval)
    start_of = partial(bucket_start, start=window.start, interval=interval)
    inside = keep(df, where).where(window.covers(F.col(time)) & any_query(named))
    rows = inside.select(
        bucket_of(F.col(time), window.start, interval).alias("bucket"),
        *(flag.alias(f"_{i}") for i, flag in enumerate(flags(named))),
    ).where(F.col("bucket") < start_of(F.lit(n_buckets)))
    return _filled(rows, n_buckets, start_of).select(_series_rows(named))


def range_histogram(
    df: DataFrame, field: str, low: int, high: int, gap: int,
    queries: Sequence[Query] | None = None, where: Column | None = None,
) -> DataFrame:
    """``(series, bucket, count)`` over a numeric field; the range ends at ``high + 1``."""
    named = list(queries) if queries else [Query("all", match_all())]
    n_buckets = ceil(Decimal(high + 1 - low) / Decimal(gap))
    value = F.col(field)
    number = F.floor((value - F.lit(low)) / F.lit(gap)).cast("bigint")

    def start_of(number: Column) -> Column:
        return F.lit(low) + number * F.lit(gap)

    inside = (value >= low) & (value < low + n_buckets * gap)
    rows = keep(df, where).where(inside & any_query(named)).select(
        start_of(number).alias("bucket"),
        *(flag.alias(f"_{i}") for i, flag in enumerate(flags(named))),
    )
    return _filled(rows, n_buckets, start_of).select(_series_rows(named))


def trend(
    df: DataFrame, time: str, window: TimeWindow, ago: timedelta, queries: Sequence[Query],
    where: Column | None = None,
) -> DataFrame:
    """``(query, now, then, percent)``: a window against the same one ``ago`` earlier.

    Both windows exclude their end. One scan reads just the rows of either window.
    """
    now, then = window, window.earlier(ago)
    in_now, in_then = now.covers_half_open(F.col(time)), then.covers_half_open(F.col(time))
    counts = []
    for i, flag in enumerate(flags(queries)):
        counts += [F.count_if(flag & in_now).alias(f"_now{i}"),
                   F.count_if(flag & in_then).alias(f"_then{i}")]
    wide = keep(df, where).where((in_now | in_then) & any_query(queries)).agg(*counts)
    return wide.select(F.inline(F.array(*(
        F.struct(
            F.lit(q.name).alias("query"), F.col(f"_now{i}").alias("now"),
            F.col(f"_then{i}").alias("then"),
            percent_change(F.col(f"_then{i}"), F.col(f"_now{i}")).alias("percent"),
        ) for i, q in enumerate(queries)
    ))))


def pair_counts(now: DataFrame, then: DataFrame) -> DataFrame:
    """Pair two ``(query, hits)`` results by query, with the percent change."""
    paired = now.select("query", F.col("hits").alias("now")).join(
        then.select("query", F.col("hits").alias("then")), "query"
    )
    return paired.withColumn("percent", percent_change(F.col("then"), F.col("now")))


def raw_series(
    df: DataFrame, time: str, field: str, key: Sequence[str], max_rows: int = 100_000,
    where: Column | None = None,
) -> DataFrame:
    """The first ``max_rows`` values in time order, ties by key."""
    rows = keep(df, where).select(time, *key, field)
    return first_rows(rows, hour_number(F.col(time)), [F.col(time), *(F.col(k) for k in key)], max_rows)


def raw_series_by_group(
    df: DataFrame, time: str, field: str, group: str, key: Sequence[str],
    max_rows: int = 100_000, where: Column | None = None,
) -> DataFrame:
    """The first ``max_rows`` values of every group in time order, ties by key."""
    rows = keep(df, where).select(group, time, *key, field)
    order = [F.col(time), *(F.col(k) for k in key)]
    return top_per_group(rows, [group], order, max_rows, slice_by=hour_number(F.col(time)))


def scatter(
    df: DataFrame, x: str, y: str, category: str, key: Sequence[str], n: int = 1000,
    where: Column | None = None,
) -> DataFrame:
    """At most ``n`` points with a category, in key order."""
    columns = list(dict.fromkeys([*key, x, y, category]))
    return keep(df, where).select(*columns).orderBy(*key).limit(n)


def multi_series(
    df: DataFrame, axis: str, measures: Sequence[str], key: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """``(axis, series, value)`` in axis order; values that are no number are left out.

    ``key`` orders the rows of one axis value, so a frequent one can be sorted by many tasks.
    """
    rows = keep(df, where)
    ids = [F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]
    numbers = rows.select(F.col(axis).alias("axis"), *ids, *(
        (to_number(F.col(m)) if rows.schema[m].dataType.typeName() == "string"
         else F.col(m).cast("double")).alias(m) for m in measures
    ))
    kept = [c for c in numbers.columns if c not in measures]
    long = numbers.unpivot(kept, list(measures), "series", "value")
    found = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return found.orderBy(*kept, "series").select("axis", "series", "value")


# Operators over a finished (series, bucket, count) table. It has one row per
# bucket and series, so a window by series holds at most the bucket count.

_RUN = 4096


def _point(bucket: Column, count: Column, value: str) -> Column:
    return F.struct(bucket.alias("bucket"), count.alias(value))


def _neighbours(points: DataFrame, series: str) -> DataFrame:
    steps = Window.partitionBy(series).orderBy("bucket")
    return points.withColumn("_before", F.lag("bucket").over(steps)).withColumn(
        "_after", F.lead("bucket").over(steps)
    )


def fill_minimal(points: DataFrame, interval: Interval, series: str = "series",
                 value: str = "count") -> DataFrame:
    """A zero one step after and one step before each gap, each only once."""
    at, zero = F.col("bucket"), F.lit(0).cast(points.schema[value].dataType)
    next_step, last_step = interval.shift(at), interval.shift(at, -1)
    # If the zero after the previous point falls on the same step, it is enough.
    before_due = interval.shift(F.col("_before")) < last_step
    rows = F.array(
        F.when(before_due, _point(last_step, zero, value)),
        _point(at, F.coalesce(F.col(value), zero), value),
        F.when(F.col("_after") > next_step, _point(next_step, zero, value)),
    )
    return _neighbours(points, series).select(series, F.inline(F.array_compact(rows)))


def fill_all(points: DataFrame, interval: Interval, series: str = "series",
             value: str = "count") -> DataFrame:
    """A zero at every missing step between two points.

    A gap is cut into runs of ``_RUN`` steps before they are spread out, so a row never
    holds more steps than that, or than the gap has runs.
    """
    at, after = F.col("bucket"), F.col("_after")
    zero = F.lit(0).cast(points.schema[value].dataType)
    run = F.expr(replace(interval, count=interval.count * _RUN).sql())
    runs = _neighbours(points, series).withColumn(
        "_run", F.explode(F.sequence(at, F.coalesce(after, at), run)))
    # A run stops before the next one and before the next point; the last point has none to reach.
    last = F.least(interval.shift(F.col("_run"), _RUN - 1), F.coalesce(after, at))
    spread = runs.withColumn("_step", F.explode(F.sequence(F.col("_run"), last, F.expr(interval.sql()))))
    own = F.col("_step") == at
    return spread.where(own | (F.col("_step") < after)).select(
        series, F.col("_step").alias("bucket"),
        F.when(own, F.coalesce(F.col(value), zero)).otherwise(zero).alias(value))


def require_times(points: DataFrame, names: Sequence[str], series: str = "series",
                  value: str = "count") -> DataFrame:
    """Give every named series a point at every time any series has one, 0 where new."""
    zero = F.lit(0).cast(points.schema[value].dataType)
    every = F.array_union(F.array(*(F.lit(n) for n in names)), F.array(F.col(series)))
    spread = points.select(
        F.col(series).alias("_own"), F.explode(every).alias(series), "bucket", value
    )
    own = F.when(F.col("_own") == F.col(series), F.col(value)).otherwise(zero)
    return spread.groupBy(series, "bucket").agg(F.sum(own).alias(value))


def pad_edges(points: DataFrame, window: TimeWindow, series: str = "series",
              value: str = "count") -> DataFrame:
    """Null points at the window's ends, in whole seconds, where a series does not reach them."""
    at = F.col("bucket")
    start, end = (ntz(edge.replace(microsecond=0)) for edge in (window.start, window.end))
    nothing = F.lit(None).cast(points.schema[value].dataType)
    first, last = F.col("_before").isNull(), F.col("_after").isNull()
    rows = F.array(
        F.when(first & (at > start), _point(start, nothing, value)),
        _point(at, F.col(value), value),
        F.when(last & (at < end), _point(end, nothing, value)),
    )
    return _neighbours(points, series).select(series, F.inline(F.array_compact(rows)))


def drop_zeros(points: DataFrame, value: str = "count") -> DataFrame:
    """Only the points that are not zero; null points stay."""
    return points.where(F.col(value).isNull() | (F.col(value) != 0))


def stacked_percent(points: DataFrame, value: str = "count") -> DataFrame:
    """Each series' percent of its bucket; null in an empty bucket."""
    whole = F.sum(value).over(Window.partitionBy("bucket"))
    return points.withColumn("percent", F.try_divide(F.col(value) * F.lit(100.0), whole))
