"""Clusters by distance against brute force, and JSON flattened without a schema."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logscope.operators import clusters, flattening


def brute(points, radius):
    """(count, centre, bounds) of every chain of points, by comparing all pairs."""
    first = list(range(len(points)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, p in enumerate(points):
        for j in range(i):
            if (p[0] - points[j][0]) ** 2 + (p[1] - points[j][1]) ** 2 <= radius * radius:
                a, b = sorted((root(i), root(j)))
                first[b] = a
    found = {}
    for i, p in enumerate(points):
        found.setdefault(root(i), []).append(p)
    out = []
    for own in found.values():
        lats, lons = [p[0] for p in own], [p[1] for p in own]
        out.append((len(own), round(sum(lats) / len(own), 6), round(sum(lons) / len(own), 6),
                    min(lats), min(lons), max(lats), max(lons)))
    return sorted(out)


def got(spark, points, radius):
    rows = spark.createDataFrame([(f"{a!r},{b!r}",) for a, b in points], "at string")
    found = clusters.near_clusters(rows, "at", radius).collect()
    return sorted((r["count"], round(r.lat, 6), round(r.lon, 6), r.south, r.west, r.north, r.east) for r in found)


@pytest.mark.parametrize("radius", [0.8, 3.0])
def test_same_as_brute_force(spark, radius):
    rng = random.Random(9)
    points = [(round(rng.uniform(-60, 60), 3), round(rng.uniform(-60, 60), 3)) for _ in range(1298)]
    points += [(-0.0, 0.0), (0.0, -0.0)]
    # A third of all points in one cell, many of them copies.
    points += [(round(rng.gauss(10, 0.05), 3), round(rng.gauss(10, 0.05), 3)) for _ in range(700)]
    assert got(spark, points, radius) == brute(points, radius)


def test_points_across_an_edge_join(spark):
    rows = [(-0.001, -0.001), (0.001, 0.001), (-0.001, 0.001), (5.0, 5.0)]
    assert [x[0] for x in got(spark, rows, 0.01)] == [1, 3]


def test_exactly_the_radius_and_just_beyond(spark):
    assert [x[0] for x in got(spark, [(0.0, 0.0), (0.0, 2.0)], 2.0)] == [2]
    assert [x[0] for x in got(spark, [(0.0, 0.0), (0.0, 2.0000001)], 2.0)] == [1, 1]


def test_two_dense_cells_out_of_reach(spark):
    """Facing fronts a hair too far apart: boxes are split until their points settle it."""
    rng = random.Random(2)
    left = [(round(rng.uniform(0, 0.6), 4), 0.0) for _ in range(150)]
    right = [(round(rng.uniform(0, 0.6), 4), 1.00001) for _ in range(150)]
    assert got(spark, left + right, 1.0) == brute(left + right, 1.0)
    assert len(got(spark, left + right, 1.0)) == 2
    assert len(got(spark, [*left, *right, (0.3, 0.5)], 1.0)) == 1


def test_few_splits_compare_points(spark):
    rng = random.Random(3)
    points = [(rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(60)]
    spots = spark.createDataFrame(points, "lat double, lon double").withColumns(
        {"row": F.col("lat") / (0.4 * clusters.SIDE), "column": F.col("lon") / (0.4 * clusters.SIDE)}).withColumn(
        "cell", F.floor("row") * (1 << 32) + F.floor("column"))
    pairs = [{tuple(r) for r in clusters.near_cells(spots, 0.4, n).collect()} for n in (1, 12)]
    assert pairs[0] == pairs[1] != set()


def test_a_long_chain_is_one_cluster(spark):
    chain = [(0.0, i * 0.9) for i in range(80)]
    assert [x[0] for x in got(spark, chain, 1.0)] == [80]


def test_bad_points_and_no_points(spark):
    rows = spark.createDataFrame([("1,1",), ("x,1",), (None,), ("",), ("1,1",)], "at string")
    assert [r["count"] for r in clusters.near_clusters(rows, "at", 1.0).collect()] == [2]
    assert clusters.near_clusters(rows.limit(0), "at", 1.0).collect() == []
    with pytest.raises(ValueError, match="radius"):
        clusters.near_clusters(rows, "at", 0.0)


def flat(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    found = flattening.flatten_any_json(rows, "doc", keep=("id",))
    return found.columns, sorted(tuple(r) for r in found.collect())


def test_flatten_without_a_schema(spark):
    assert flat(spark, '{"b":{"y":"t","x":{"n":7}},"a":[{"k":1},{"k":2}],"list":[5],"words":["u"]}',
                '{"list":[5,6],"b":{}}', "no json", None, "[1]") == (
        ["id", "a", "b.x.n", "b.y", "list", "words"],
        [(0, '{"k":1}, {"k":2}', "7", "t", "5", '["u"]'), (1, None, None, None, "[5,6]", None),
         (2, *[None] * 5), (3, *[None] * 5), (4, *[None] * 5)])


def test_flatten_mixed_paths(spark):
    columns, rows = flat(spark, '{"a":1,"m":null}', '{"a":{"b":{"c":true}}}', '{"a":{"b":"s"}}', '{"a":[1.5]}',
                         '{"a":{"b":{"c":{"d":2}}}}', '{"a":[null,1]}', '{"a":[]}')
    assert columns == ["id", "a", "a.b", "a.b.c", "a.b.c.d"]
    assert rows == [(0, "1", None, None, None), (1, None, None, "true", None), (2, None, "s", None, None),
                    (3, "1.5", None, None, None), (4, None, None, None, "2"), (5, "null, 1", None, None, None),
                    (6, "[]", None, None, None)]


def test_flatten_odd_names(spark):
    columns, rows = flat(spark, '''{"a.b":1,"it's":2,"id":3,"OBJECT<":{"x y":4},"A":5,"a":{"c":6}}''', '{"a":{"b":7}}')
    assert columns == ["id", "A", "OBJECT<.x y", "a.b", "a.c", "id_json", "it's"]
    assert rows == [(0, "5", "4", "1", "6", "3", "2"), (1, None, None, "7", None, None, None)]


def test_flatten_nothing(spark):
    assert flat(spark, None, "1", "{}") == (["id"], [(0,), (1,), (2,)])
