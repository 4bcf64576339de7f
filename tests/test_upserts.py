"""The stored day table under feeds, replays and failures; look-ups that leave records in place."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

import plans
from logscope.operators.joins import look_up
from logscope.sources import upserts
from logscope.sources.bucketed import open_bucketed, write_bucketed
from logscope.streaming.live import run_available, stream_table

_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("part", T.StringType()),
    T.StructField("at", T.TimestampNTZType()), T.StructField("n", T.IntegerType()),
    T.StructField("version", T.IntegerType())])


def feed(spark, rows):
    """Rows ``(id, part, day of March or None, n, version)``."""
    data = [(i, p, None if d is None else f"2024-03-{d:02} 10:00:00", n, v) for i, p, d, n, v in rows]
    return spark.createDataFrame(data, "id long, part string, at string, n int, version int").withColumn(
        "at", F.col("at").cast("timestamp_ntz"))


@pytest.fixture
def table(spark, tmp_path):
    return upserts.UpsertTable(spark, str(tmp_path / "t"), _SCHEMA, ("id", "part"), ("version",), "at", parts=4)


def content(table):
    return sorted((r.id, r.part, r.n, r.version, r.day) for r in table.rows().collect())


def files(table):
    return {str(f): f.stat().st_mtime_ns for f in Path(table.path).rglob("*") if f.is_file()}


def test_feeds_against_a_dictionary(spark, table):
    rng, live = random.Random(2), {}
    for _ in range(4):
        rows = [(rng.randint(0, 40), rng.choice(["a", "b", ""]), rng.choice([1, 2, 3, None]), rng.randint(0, 9),
                 rng.randint(0, 3)) for _ in range(60)]
        rows = list({(i, p, v): (i, p, d, n, v) for i, p, d, n, v in rows}.values())
        table.merge(feed(spark, rows))
        for i, p, d, n, v in rows:
            if (i, p) not in live or live[i, p][1] < v:
                live[i, p] = (n, v, upserts.NO_DAY if d is None else f"202403{d:02}")
        assert content(table) == sorted((i, p, *x) for (i, p), x in live.items())


def test_replay_writes_nothing(spark, table):
    rows = feed(spark, [(1, "a", 1, 5, 1), (2, "a", 2, 5, 1), (2, "a", 2, 4, 0)])
    assert table.merge(rows)
    before = files(table)
    assert not table.merge(rows) and not table.merge(feed(spark, [(1, "a", 3, 9, 0)]))
    assert not table.merge(feed(spark, []))
    assert files(table) == before


def test_only_touched_days_are_written(spark, table):
    table.merge(feed(spark, [(i, "a", 1 + i % 3, 0, 0) for i in range(30)]))
    table.merge(feed(spark, [(0, "a", 2, 7, 1)]))  # from the first to the second day
    now = table.manifest()
    assert now.days == {"20240301": 2, "20240302": 2, "20240303": 1} and set(now.parts.values()) == {1, 2}
    assert (0, "a", 7, 1, "20240302") in content(table) and len(content(table)) == 30
    table.clean()
    assert len(content(table)) == 30
    assert {p.name for p in Path(table.path).glob("rows/_version=1/day=*")} == {"day=20240303"}


def test_a_day_that_empties_goes(spark, table):
    table.merge(feed(spark, [(1, "a", 1, 0, 0), (2, "a", 2, 0, 0)]))
    table.merge(feed(spark, [(1, "a", 2, 0, 1)]))
    assert table.manifest().days == {"20240302": 2} and len(content(table)) == 2


def test_a_load_that_dies_changes_nothing(spark, table, monkeypatch):
    table.merge(feed(spark, [(1, "a", 1, 0, 0)]))
    before = content(table)
    with monkeypatch.context() as broken:
        broken.setattr(upserts.UpsertTable, "_commit", lambda self, manifest: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(feed(spark, [(1, "a", 1, 8, 1)]))
    assert content(table) == before
    assert table.merge(feed(spark, [(1, "a", 1, 9, 1)])) and content(table) == [(1, "a", 9, 1, "20240301")]


def test_two_loads_at_once(spark, table, monkeypatch):
    table.merge(feed(spark, [(1, "a", 1, 0, 0)]))
    stale = table.manifest()
    table.merge(feed(spark, [(1, "a", 1, 1, 1)]))
    monkeypatch.setattr(upserts.UpsertTable, "manifest", lambda self: stale)
    with pytest.raises(RuntimeError, match="another load"):
        table.merge(feed(spark, [(1, "a", 1, 2, 2)]))


def test_days_and_empty_table(spark, table):
    assert content(table) == []
    table.merge(feed(spark, [(i, "a", 1 + i, 0, 0) for i in range(5)]))
    assert table.rows(("20240302", "20240303")).count() == 2


def test_stream_over_restarts(spark, table, tmp_path):
    rows = feed(spark, [(i % 50, "a", 1 + i % 4, i, i // 50) for i in range(200)])
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = stream_table(spark, f"{tmp_path}/in", rows.schema, files_per_trigger=1)
    for number in range(2):  # the second run starts without a checkpoint
        run_available(upserts.upsert_sink(stream, table, f"{tmp_path}/checkpoint{number}"))
        assert content(table) == sorted((i % 50, "a", i, 3, f"202403{1 + i % 4:02}") for i in range(150, 200))


# Look-ups.

def test_hot_record_key_keeps_stubs(spark):
    hits = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    records = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7), (None, 8)], "k int, v int")
    got = look_up(hits, records, "k", hot_records=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, look_up(hits, records, "k").collect()))


def test_bucketed_records_are_not_shuffled(spark, tmp_path):
    records = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    path = str(tmp_path / "records")
    write_bucketed(records, path, "k", 8)
    opened = open_bucketed(spark, path, records.schema, "k", 8)
    hits = spark.range(290, 310).select(F.col("id").alias("k"))
    found = look_up(hits, opened, "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.planned(look_up(hits, opened, "k"))
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        got = sorted(map(str, look_up(hits, opened, "k").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(map(str, look_up(hits, records, "k").collect())) == sorted(map(str, found.collect()))
