"""Points grouped by distance: chains of points, each within a radius of the next.

The plane is cut into cells whose diagonal is just under the radius, so the points of one
cell always belong together and cells, not points, are grouped. Whether two cells within
reach hold a near pair is settled by boxes: a pair of boxes is near when two points of theirs
are, far when the gap between the boxes is too wide, and is cut into finer boxes otherwise.
No pair of points inside a cell is made, and a cell with any number of points costs its boxes.
Cells are then joined to clusters by alternating stars. Each round is written, so a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logscope.operators.geo import with_point
from logscope.operators.predicates import keep
from logscope.scratch import scratch_path

#: A cell's side as a share of the radius, a little under the square root of a half.
SIDE = 0.7071
#: Boxes split by 4 in both directions; after so many splits their points are compared.
SPLITS = 12
LEAST_RADIUS = 1e-6
_ROW = 1 << 32
#: Cells up to two steps away, half of them: each pair of cells is met once.
_AHEAD = [r * _ROW + c for r in range(3) for c in range(-2, 3) if r > 0 or c > 0]


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _boxes(spots: DataFrame, level: int) -> DataFrame:
    """``(cell, at, box)``: bounds of the points of each box, and one of its points."""
    scale = float(4 ** level)
    at = F.struct(F.floor(F.col("row") * scale).alias("row"), F.floor(F.col("column") * scale).alias("column"))
    return spots.groupBy("cell", at.alias("at")).agg(F.struct(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"),
        F.max("lon").alias("east"), F.min(F.struct("lat", "lon")).alias("one")).alias("box"))


def _square(x: Column, y: Column) -> Column:
    return x * x + y * y


def _near(a: Column, b: Column, radius: float) -> Column:
    return _square(a["lat"] - b["lat"], a["lon"] - b["lon"]) <= radius * radius


def _gap(a: Column, b: Column, low: str, high: str) -> Column:
    return F.greatest(F.lit(0.0), a[low] - b[high], b[low] - a[high])


def _judged(pairs: DataFrame, radius: float) -> DataFrame:
    """Pairs of boxes that are near, or may be; with ``near``."""
    a, b = F.col("box_a"), F.col("box_b")
    reach = _square(_gap(a, b, "south", "north"), _gap(a, b, "west", "east")) <= radius * radius
    return pairs.where(reach).select("a", "b", "at_a", "at_b", _near(a["one"], b["one"], radius).alias("near"))


def _side(boxes: DataFrame, side: str, *columns: Column) -> DataFrame:
    return boxes.select(F.col("cell").alias(side), F.col("at").alias(f"at_{side}"),
                        F.col("box").alias(f"box_{side}"), *columns)


def _parent(side: str) -> Column:
    at = F.col(f"at_{side}")
    return F.struct(F.floor(at["row"] / 4).alias("row"), F.floor(at["column"] / 4).alias("column")).alias(
        f"from_{side}")


def near_cells(spots: DataFrame, radius: float, splits: int = SPLITS) -> DataFrame:
    """``(a, b)``: pairs of cells with points within the radius of each other."""
    boxes = _kept(_boxes(spots, 0), "cells")
    ahead = _side(boxes, "a", F.explode(F.array(*map(F.lit, _AHEAD))).alias("step")).withColumn(
        "b", F.col("a") + F.col("step")).drop("step")
    judged = _kept(_judged(ahead.join(_side(boxes, "b"), "b"), radius), "cell-pairs")
    linked = judged.where("near").select("a", "b")
    for level in range(1, splits + 1):
        settled = judged.where("near").select("a", "b").distinct()
        open_ = judged.where("NOT near").join(settled, ["a", "b"], "left_anti").drop("near")
        if open_.isEmpty():
            return linked
        cells = open_.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
        finer = _kept(_boxes(spots.join(cells, "cell", "left_semi"), level), "boxes")
        from_ = open_.select("a", "b", F.col("at_a").alias("from_a"), F.col("at_b").alias("from_b"))
        for side in "ab":
            from_ = from_.join(_side(finer, side).withColumn(f"from_{side}", _parent(side)), [side, f"from_{side}"])
        judged = _kept(_judged(from_, radius), "box-pairs")
        linked = linked.unionByName(judged.where("near").select("a", "b").distinct())
    # Boxes millions of times finer than a cell: their few points are compared.
    scale = float(4 ** splits)
    points = spots.select("cell", F.struct(F.floor(F.col("row") * scale).alias("row"),
                                           F.floor(F.col("column") * scale).alias("column")).alias("at"),
                          F.struct("lat", "lon").alias("spot"))
    settled = judged.where("near").select("a", "b").distinct()
    last = judged.where("NOT near").join(settled, ["a", "b"], "left_anti")
    for side in "ab":
        last = last.join(points.select(F.col("cell").alias(side), F.col("at").alias(f"at_{side}"),
                                       F.col("spot").alias(f"spot_{side}")), [side, f"at_{side}"])
    return linked.unionByName(last.where(_near(F.col("spot_a"), F.col("spot_b"), radius)).select("a", "b").distinct())


def _star(links: DataFrame, upward: bool) -> DataFrame:
    """Hang the greater (``upward``) or the smaller neighbours of each node on the least it sees."""
    seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    hung = seen.join(least, "a")
    if upward:
        hung = hung.where("b > a")
    else:
        hung = hung.unionByName(least.select("a", F.col("a").alias("b"), "least"))
    return hung.select(F.col("least").alias("a"), F.col("b")).where("a <> b").distinct()


def groups_of_links(links: DataFrame) -> DataFrame:
    """``(node, first)``: the least node that each linked node reaches."""
    now, before = _kept(links.where("a <> b").select("a", "b").distinct(), "links"), None
    while True:
        now = _kept(_star(_star(now, upward=True), upward=False), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("first"))


def near_clusters(df: DataFrame, point: str, radius: float, where: Column | None = None) -> DataFrame:
    """Clusters of points no further than ``radius`` degrees from the next one.

    A row for each cluster: ``count``, the centre of gravity ``lat`` and ``lon``, and the
    bounds ``south``, ``west``, ``north``, ``east``. Points on both sides of a cell's edge
    join. Degrees are taken as a plane; the date line is an edge. Rows without a point are left out.
    """
    if not radius >= LEAST_RADIUS:
        raise ValueError(f"a radius of {LEAST_RADIUS} degrees or more is needed, not {radius}")
    located = with_point(keep(df, where), point).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    side = radius * SIDE
    # Rows at the same place are one spot with a count; zeros lose their sign.
    spots = located.select((F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon")).groupBy(
        "lat", "lon").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"row": F.col("lat") / side, "column": F.col("lon") / side}).withColumn(
        "cell", F.floor("row") * _ROW + F.floor("column"))
    spots = _kept(spots, "spots")
    first = groups_of_links(near_cells(spots, radius))
    cells = spots.groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("lat")).alias("lats"),
        F.sum(F.col("n") * F.col("lon")).alias("lons"), F.min("lat").alias("south"), F.min("lon").alias("west"),
        F.max("lat").alias("north"), F.max("lon").alias("east"))
    found = cells.join(first, F.col("cell") == F.col("node"), "left").groupBy(
        F.coalesce("first", "cell").alias("first"))
    return found.agg(
        F.sum("n").alias("count"), (F.sum("lats") / F.sum("n")).alias("lat"), (F.sum("lons") / F.sum("n")).alias("lon"),
        F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"),
        F.max("east").alias("east")).drop("first")
