"""Points held as ``"lat,lon"`` text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logscope.functions.numbers import latitude, longitude
from logscope.operators.predicates import in_box, keep


def with_point(df: DataFrame, point: str) -> DataFrame:
    """Add ``lat`` and ``lon`` as doubles."""
    return df.withColumns({"lat": latitude(F.col(point)), "lon": longitude(F.col(point))})


def latest_points(
    df: DataFrame, point: str, time: str, key: Sequence[str],
    low: tuple[float, float] = (-90.0, -180.0), high: tuple[float, float] = (90.0, 180.0),
    size: int = 1000, where: Column | None = None,
) -> DataFrame:
    """The newest ``size`` points in a box, ties by key."""
    inside = keep(df, where).where(in_box(point, low, high))
    newest = inside.orderBy(F.col(time).desc(), *(F.col(k) for k in key)).limit(size)
    return with_point(newest, point).select(time, *key, "lat", "lon")


def grid_clusters(
    df: DataFrame, point: str, cell: float, where: Column | None = None
) -> DataFrame:
    """Points by grid cell of ``cell`` degrees: count and centre of gravity."""
    located = with_point(keep(df, where), point).where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    return located.groupBy(
        F.floor(F.col("lat") / cell).alias("cell_lat"), F.floor(F.col("lon") / cell).alias("cell_lon")
    ).agg(
        F.count(F.lit(1)).alias("count"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )
