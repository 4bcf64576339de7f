"""Day tables, exports and search on disk."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

import plans
from conftest import SMALL
from logscope.functions.windows import TimeWindow
from logscope.operators import export
from logscope.operators.predicates import term
from logscope.plans.search import search
from logscope.scratch import scratch_root
from logscope.sources import tables


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet")


@pytest.fixture(scope="module")
def day_table(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "events")
    tables.write_by_day(events, path)
    schema = T.StructType([*events.schema.fields, T.StructField("day", T.StringType())])
    return tables.read_by_day(spark, path, schema)


def test_scan_prunes_days_and_pushes_the_filter(day_table):
    window = TimeWindow.of("2024-01-10 06:00:00", "2024-01-12 06:00:00")
    found = tables.scan(day_table, window, where=term("event_type", "error"))
    plan = plans.planned(found.select("event_id"))
    assert "PartitionFilters: [isnotnull(day" in plan and ">= 20240110" in plan
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("EqualTo(event_type,error)", "GreaterThanOrEqual(ts,2024-01-1"):
        assert part in pushed
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan
    assert {r["day"] for r in found.select("day").distinct().collect()} == {
        "20240110", "20240111", "20240112"}


def test_scan_refuses_long_windows(day_table):
    with pytest.raises(ValueError, match="limit"):
        tables.scan(day_table, TimeWindow.of("2024-01-01", "2024-01-20"), max_span_days=5)


def test_day_stays_text(spark, day_table):
    assert dict(day_table.dtypes)["day"] == "string"
    names = [r["table"] for r in tables.list_days(
        spark, day_table.inputFiles()[0].rsplit("/day=", 1)[0]).collect()]
    assert min(names) == "tb_20240101"


def test_scratch_follows_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.range(25).select(
        "id", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(
            F.concat(F.lit('a,"b" <c> & \'d\' '), F.col("id"))).alias("text"),
        (F.lit(25) - F.col("id")).alias("n")).coalesce(1)


def files(path, kind):
    return sorted(p for p in Path(path).iterdir() if p.suffix == f".{kind}")


@pytest.mark.parametrize("kind", ["json", "csv", "xml"])
def test_chunks_hold_every_row(spark, awkward, tmp_path, kind):
    path = str(tmp_path / "out")
    export.export(awkward, path, kind, header=True, rows_per_file=10)
    assert len(files(path, kind)) == 3
    reader = spark.read.schema(awkward.schema)
    back = {
        "json": lambda: reader.json(path),
        "csv": lambda: reader.option("header", True).option("escape", '"').csv(path),
        "xml": lambda: reader.option("rowTag", "doc").option("ignoreSurroundingSpaces", False).xml(path),
    }[kind]()
    plain = back.select("id", F.nullif("text", F.lit("")).alias("text"), "n")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, awkward.collect()))


def test_csv_header_in_every_file(awkward, tmp_path):
    path = str(tmp_path / "out")
    export.export(awkward, path, "csv", header=True, rows_per_file=10, columns=["id", "n"])
    assert [f.read_text().splitlines()[0] for f in files(path, "csv")] == ["id,n"] * 3
    export.export(awkward, path + "2", "csv", columns=["id"])
    assert files(path + "2", "csv")[0].read_text().splitlines() == [str(i) for i in range(25)]


def test_xml_shape(awkward, tmp_path):
    path = str(tmp_path / "out")
    export.export(awkward.where("id = 1"), path, "xml")
    text = files(path, "xml")[0].read_text()
    assert "<response>" in text and "<doc>" in text and "&lt;c> &amp;" in text


def test_sorted_export_reads_in_order(spark, awkward, tmp_path):
    path = str(tmp_path / "out")
    export.export(awkward.repartition(4), path, "json", sort=[("n", "asc")], key=["id"], time="id",
                  columns=["id"], rows_per_file=4)
    lines = [json.loads(line)["id"] for f in files(path, "json") for line in f.read_text().splitlines()]
    assert lines == list(range(24, -1, -1))


def test_ceiling(awkward, tmp_path):
    export.check_ceiling(awkward, 25)
    export.check_ceiling(awkward, None)
    with pytest.raises(export.TooManyRows, match="more than 24"):
        export.export(awkward, str(tmp_path / "out"), "json", ceiling=24)
    assert not (tmp_path / "out").exists()


def test_existing_exports_are_kept(awkward, tmp_path):
    path = str(tmp_path / "out")
    export.export(awkward, path, "json")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        export.export(awkward, path, "json")


def test_search_page(spark):
    docs = spark.createDataFrame(
        [(i, f"{'Red fox' if i % 2 else 'blue fox'} number {i}", "en" if i < 6 else "de") for i in range(10)],
        "id int, body string, lang string")
    found = search(docs, "body", "FOX red", ["id"], ["lang"], size=2, number=1, snippet_length=7, cache=True)
    assert found.total.first()["hits"] == 5
    assert [(r["id"], r["highlight"], r["snippet"]) for r in found.rows.collect()] == [
        (5, "<em>Red</em> <em>fox</em> number 5", "Red fox..."),
        (7, "<em>Red</em> <em>fox</em> number 7", "Red fox...")]
    assert [tuple(r) for r in found.facets.collect()] == [("lang", "en", 3), ("lang", "de", 2)]
    found.release()
    assert not found.base.is_cached


def test_ceiling_is_counted_in_all_tasks(spark):
    rows = spark.range(0, 1000, 1, 8)
    assert "Limit" not in plans.planned(export.over_ceiling(rows, 999))
    assert [export.over_ceiling(rows, n).first()["refused"] for n in (999, 1000)] == [True, False]
