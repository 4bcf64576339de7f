"""The catalogue by day and the layout by place: merged results, and what a box reads."""

from __future__ import annotations

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import plans
from logscope.operators.predicates import in_box
from logscope.sources.catalogue import put_catalogue, read_catalogue
from logscope.sources.geo_layout import BITS, box_ranges, in_placed_box, write_by_place


@pytest.fixture(scope="module")
def log(spark):
    return spark.range(4000).select(
        "id", F.timestamp_add("MINUTE", F.col("id"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.when(F.col("id") % 4 != 0, (F.col("id") % 50).cast("string")).alias("kind"))


def test_catalogue_of_all_days_reads_no_rows(spark, log, tmp_path):
    path = str(tmp_path / "catalogue")
    first = log.where("id < 2500")
    put_catalogue(first, path, "ts")
    put_catalogue(log.where("ts >= timestamp_ntz'2024-03-02 00:00:00'"), path, "ts")  # one day anew, others new
    got = {r.field: r for r in read_catalogue(spark, path).collect()}
    assert {f: (r.type, r.rows, r.present) for f, r in got.items()} == {
        "id": ("bigint", 4000, 4000), "ts": ("timestamp_ntz", 4000, 4000), "kind": ("string", 4000, 3000)}
    assert abs(got["kind"]["values"] - 50) <= 1 and abs(got["id"]["values"] - 4000) < 200
    some = read_catalogue(spark, path, ("20240302", "20240302")).where("field = 'id'").first()
    assert some.rows == 1440


def test_catalogue_of_nothing(spark, log, tmp_path):
    put_catalogue(log.limit(0), str(tmp_path / "c"), "ts")
    assert read_catalogue(spark, str(tmp_path / "c")).collect() == []


def test_box_ranges_cover_the_box():
    rng = random.Random(4)
    for _ in range(50):
        lat, lon = sorted(rng.uniform(-90, 90) for _ in "ab"), sorted(rng.uniform(-180, 180) for _ in "ab")
        for most in (1, 8, 32):
            ranges = box_ranges((lat[0], lon[0]), (lat[1], lon[1]), most)
            assert 1 <= len(ranges) <= most and ranges == sorted(ranges)
            for _ in range(20):
                row = min(int((rng.uniform(*lat) + 90) / 180 * (1 << BITS)), (1 << BITS) - 1)
                column = min(int((rng.uniform(*lon) + 180) / 360 * (1 << BITS)), (1 << BITS) - 1)
                number = sum(((row >> i & 1) << 2 * i + 1) | ((column >> i & 1) << 2 * i) for i in range(BITS))
                assert any(a <= number <= b for a, b in ranges)
    assert box_ranges((5, 5), (4, 6)) == [] and box_ranges((-90, -180), (90, 180)) == [(0, (1 << 2 * BITS) - 1)]


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    rng = random.Random(6)
    points = [f"{rng.uniform(-90, 90):.4f},{rng.uniform(-180, 180):.4f}" for _ in range(4000)]
    points += ["90,180", "-90,-180", "0,0", None, "", "x"]
    df = spark.createDataFrame(list(enumerate(points)), "id long, point string")
    path = str(tmp_path_factory.mktemp("place") / "x")
    write_by_place(df, path, "point", parts=16)
    return df, path


@pytest.mark.parametrize(("low", "high"), [
    ((-90, -180), (90, 180)), ((10, 10), (20, 30)), ((0, 0), (0, 0)), ((89, 179), (90, 180)), ((-5.5, -60), (5.5, -59))])
def test_same_as_scan(spark, placed, low, high):
    df, path = placed
    got = in_placed_box(spark.read.parquet(path), low, high)
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.where(in_box("point", low, high)).collect())


def test_small_box_skips_files(spark, placed, tmp_path):
    df, path = placed
    low, high = (10, 10), (20, 30)
    copy = tmp_path / "copy"
    shutil.copytree(path, copy)
    ranges = box_ranges(low, high)
    kept = 0
    for file in Path(copy).glob("part-*.parquet"):
        a, b = spark.read.parquet(str(file)).agg(F.min("_cell"), F.max("_cell")).first()
        if a is None or not any(first <= b and last >= a for first, last in ranges):
            file.unlink()
        else:
            kept += 1
    got = in_placed_box(spark.read.parquet(str(copy)), low, high)
    assert kept <= 6
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.where(in_box("point", low, high)).collect())
    assert "Or(" in plans.planned(got).split("PushedFilters")[1]
