"""Sketched top values, the page index and minute counters: exact, and reading only their share."""

from __future__ import annotations

import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from logscope.functions.intervals import Interval
from logscope.functions.windows import TimeWindow
from logscope.operators import facets, heavy, paging, series
from logscope.operators.predicates import Query, match_all, term
from logscope.sources.page_index import open_pages, write_pages
from logscope.sources.rollups import Rollup, Term, counter_sink, put_counters
from logscope.sources.tables import read_by_day, scan, write_by_day
from logscope.streaming.live import run_available, stream_table


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Top values.

@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    values = [f"v{min(int(rng.paretovariate(0.7)), 4000)}" for _ in range(8000)]
    return spark.createDataFrame([(v if rng.random() > 0.1 else None, f"{v} x {v}") for v in values],
                                 "value string, text string")


@pytest.mark.parametrize("cells", [3, 64, 1 << 16])
@pytest.mark.parametrize("size", [0, 1, 10, 10_000])
def test_top_values_are_exact(skewed, cells, size):
    assert rows_of(heavy.terms(skewed, "value", size, cells=cells)) == rows_of(facets.terms(skewed, "value", size))
    assert sorted(map(str, rows_of(heavy.terms_with_rest(skewed, "value", size, ["v1"], cells=cells)))) == sorted(
        map(str, rows_of(facets.terms_with_rest(skewed, "value", size, ["v1"]))))


def test_certificate_spares_the_second_pass(skewed):
    heavy_values = skewed.select("value")
    assert heavy.top_values(heavy_values, 5).passes == 1
    even = skewed.sparkSession.range(5000).select((F.col("id") % 2500).cast("string").alias("value"))
    top = heavy.top_values(even, 5, cells=512)
    assert top.passes == 2 and rows_of(top.rows) == rows_of(facets.terms(even, "value", 5))
    assert top.sketch.count() <= 512


def test_ties_with_the_last_value_decide_by_value(spark):
    rows = spark.createDataFrame([(f"{i:03}",) for i in range(300) for _ in range(2)], "value string")
    assert rows_of(heavy.terms(rows, "value", 4, cells=1 << 10)) == [("000", 2), ("001", 2), ("002", 2), ("003", 2)]


def test_tag_cloud_by_sketch(skewed):
    want = rows_of(facets.tag_cloud(skewed, "text", 15, ["x"]))
    assert sorted(rows_of(heavy.tag_cloud(skewed, "text", 15, ["x"], cells=128))) == sorted(want)


def test_top_of_nothing(skewed):
    none = skewed.where("value = 'no such'")
    assert rows_of(heavy.terms(none, "value")) == []
    assert sorted(rows_of(heavy.terms_with_rest(none, "value"))) == [("missing", None, 0), ("other", None, 0)]
    assert rows_of(heavy.tag_cloud(none, "text")) == []


# Pages.

@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.choice([None, 1, 2, 2, 2, 3]), f"t{i}") for i in range(2000)],
                               "id long, amount int, ts string")
    path = str(tmp_path_factory.mktemp("pages") / "x")
    write_pages(df, path, [("amount", "desc")], ["id"], "ts", parts=12)
    return df, path, open_pages(spark, path, df.schema)


@pytest.mark.parametrize(("number", "size", "total"), [
    (0, 10, None), (7, 33, None), (199, 10, None), (200, 10, None), (0, 5000, None), (3, 100, 350), (9, 100, 350),
    (5, 0, None)])
def test_page_by_number(pages, number, size, total):
    df, _, index = pages
    assert rows_of(index.page(number, size, total)) == rows_of(
        paging.page(df, [("amount", "desc")], ["id"], "ts", number, size, total))


def test_deep_page_opens_only_its_folders(spark, pages, tmp_path):
    df, path, index = pages
    assert len(index.ranges) == 12 and index.total == 2000
    copy = tmp_path / "copy"
    shutil.copytree(path, copy)
    begin, end = 1700, 1720
    met = {p for p, before, n in index.ranges if before < end and before + n > begin}
    for folder in copy.glob("rows/_part=*"):
        if int(folder.name.removeprefix("_part=")) not in met:
            shutil.rmtree(folder)
    found = open_pages(spark, str(copy), df.schema).page(85, 20)
    assert len(met) <= 2
    assert rows_of(found) == rows_of(paging.page(df, [("amount", "desc")], ["id"], "ts", 85, 20))


def test_last_page_and_bad_pages(pages):
    df, _, index = pages
    assert rows_of(index.last_page(300)) == rows_of(paging.page(df, [("amount", "desc")], ["id"], "ts", 6, 300))
    with pytest.raises(ValueError, match="0 or more"):
        index.page(-1, 5)


def test_pages_of_nothing(spark, pages, tmp_path):
    df = pages[0].limit(0)
    write_pages(df, str(tmp_path / "x"), [], ["id"], "ts")
    index = open_pages(spark, str(tmp_path / "x"), df.schema)
    assert index.total == 0 and rows_of(index.page(0, 5)) == [] and rows_of(index.last_page(5)) == []


# Minute counters.

_START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(11)
    data = [((_START + timedelta(seconds=rng.randint(0, 4 * 86400), microseconds=rng.choice([0, 0, 250_000]))
              ).isoformat(" "), rng.choice(["a", "b", None]), rng.randint(1, 4)) for _ in range(3000)]
    data += [((_START + timedelta(days=1, minutes=m)).isoformat(" "), "a", 1) for m in range(5)]
    df = spark.createDataFrame(data, "ts string, kind string, level int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder = tmp_path_factory.mktemp("rollup")
    write_by_day(df, f"{folder}/log")
    put_counters(df, f"{folder}/counters", "ts", ["kind", "level"])
    return folder, df


def rollup(spark, folder, df):
    return Rollup(spark, f"{folder}/counters", log_table(spark, folder, df), "ts", ("kind", "level"))


def log_table(spark, folder, df):
    schema = T.StructType([*df.schema.fields, T.StructField("day", T.StringType())])
    return read_by_day(spark, f"{folder}/log", schema)


_TERMS = [Term("all"), Term("a", "kind", "a"), Term("3", "level", "3"), Term("none", "kind", "zz")]


def queries():
    return [Query("all", match_all()), Query("a", term("kind", "a")), Query("3", term("level", "3")),
            Query("none", term("kind", "zz"))]


@pytest.mark.parametrize(("start", "end"), [
    ("2024-03-01 00:00:00", "2024-03-05 00:00:00"), ("2024-03-02 00:01:00", "2024-03-02 00:04:00"),
    ("2024-03-01 07:30:00", "2024-03-03 11:11:11.5"), ("2024-03-02 00:00:30", "2024-03-02 00:02:10"),
    ("2024-03-02 00:01:10", "2024-03-02 00:01:50"), ("2024-02-01 00:00:00", "2024-02-02 00:00:00")])
def test_windows_from_counters(spark, log, start, end):
    folder, df = log
    kept, window = rollup(spark, folder, df), TimeWindow.of(start, end)
    inside = df.where(window.covers(F.col("ts")))
    for width in ("1m", "7m", "1h", "1d", "1M", "40s"):
        if window.length > timedelta(days=1) and width in ("1m", "40s"):
            continue
        interval = Interval.parse(width)
        assert sorted(rows_of(kept.histogram(window, interval, _TERMS))) == sorted(
            rows_of(series.histogram(df, "ts", window, interval, queries())))
    assert sorted(rows_of(kept.hits(window, _TERMS))) == sorted(
        (q.name, inside.where(q.predicate).count()) for q in queries())
    ago = timedelta(hours=25, seconds=3)
    assert sorted(rows_of(kept.trend(window, ago, _TERMS))) == sorted(rows_of(series.trend(df, "ts", window, ago, queries())))
    want = facets.terms(inside.withColumn("kind", F.col("kind")), "kind", 2)
    assert rows_of(kept.terms("kind", window, 2)) == rows_of(want)


def test_only_cut_minutes_are_read_from_the_log(spark, log, tmp_path):
    folder, df = log
    window = TimeWindow.of("2024-03-01 07:30:00", "2024-03-03 11:11:11.5")
    copy = tmp_path / "copy"
    shutil.copytree(folder, copy)
    # Of the log nothing is left but the minute the window's end cuts.
    cut = df.where("ts >= timestamp_ntz'2024-03-03 11:11:00' AND ts <= timestamp_ntz'2024-03-03 11:11:11.5'")
    write_by_day(cut, f"{copy}/log", mode="overwrite")
    found = rollup(spark, copy, df).histogram(window, Interval.parse("1h"), _TERMS)
    assert sorted(rows_of(found)) == sorted(rows_of(series.histogram(df, "ts", window, Interval.parse("1h"), queries())))


def test_loads_add_up_and_replays_do_not(spark, log, tmp_path):
    folder, df = log
    path, early = str(tmp_path / "counters"), F.col("ts") < F.lit("2024-03-02 12:00:00").cast("timestamp_ntz")
    for batch, rows in ((0, df.where(early)), (1, df.where(~early)), (1, df.where(~early)), (0, df.where(early))):
        put_counters(rows, path, "ts", ["kind", "level"], batch)
    kept = Rollup(spark, path, df.withColumn("day", F.date_format("ts", "yyyyMMdd")), "ts", ("kind", "level"))
    window = TimeWindow.of("2024-03-01", "2024-03-06")
    assert rows_of(kept.hits(window, _TERMS[:1])) == [("all", df.count())]


def test_stream_keeps_counters(spark, log, tmp_path):
    folder, df = log
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = stream_table(spark, f"{tmp_path}/in", df.schema, files_per_trigger=1)
    path = f"{tmp_path}/counters"
    for _ in range(2):
        run_available(counter_sink(stream, path, f"{tmp_path}/checkpoint", "ts", ["kind", "level"]))
    kept = Rollup(spark, path, log_table(spark, folder, df), "ts", ("kind", "level"))
    window = TimeWindow.of("2024-03-01 07:30:00", "2024-03-03 11:11:11.5")
    assert sorted(rows_of(kept.hits(window, _TERMS))) == sorted(
        (q.name, scan(df, window).where(q.predicate).count()) for q in queries())
    assert len(list(Path(path).glob("day=*/field=*/batch=*"))) > 4


def test_field_without_counters(spark, log):
    with pytest.raises(ValueError, match="without counters"):
        rollup(spark, *log).hits(TimeWindow.of("2024-03-01", "2024-03-02"), [Term("x", "ts", "1")])
