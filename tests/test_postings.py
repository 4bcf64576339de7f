"""The text index against scans, what it reads, and its awkward cases."""

from __future__ import annotations

import random
import shutil
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import plans
from logscope.operators import predicates as p
from logscope.plans.search import search
from logscope.sources.postings import open_index, postings_of, write_index

_WORDS = "a b c ab ba été 東京 x1 the of".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(_WORDS, k=rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "--", "A,b;C", "a a a b", "the a", "a the b", "b of a"]
    return spark.createDataFrame(
        [(i, i % 3, t, rng.choice(["a", None, "b c"]), f"2024010{i % 4}") for i, t in enumerate(texts)],
        "id long, part int, text string, title string, day string")


@pytest.fixture(scope="module", params=[(), ("the", "of")], ids=["plain", "stop words"])
def index(request, spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "x")
    early, late = rows.where("id < 200"), rows.where("id >= 200")
    for part in (early, late):
        write_index(part, path, ["part", "id"], ["text", "title"], buckets=8, stop_words=request.param,
                    day="day", mode="append")
    return open_index(spark, path, [rows.schema["part"], rows.schema["id"]])


def keys(df):
    return sorted(tuple(r) for r in df.select("part", "id").collect())


@pytest.mark.parametrize("text", ["a", "a b", "b a b", "a a", "A, B c", "été 東京", "a the b", "zz", "the", "a zz", ""])
def test_same_as_scan(index, rows, text):
    stop = index.stop_words
    assert keys(index.phrase("text", text)) == keys(rows.where(p.phrase("text", text, stop)))
    assert keys(index.all_words("text", text)) == keys(rows.where(p.all_words("text", text, stop)))
    assert keys(index.any_field_word(["text", "title"], text)) == keys(
        rows.where(p.any_field_word(["text", "title"], text, stop)))


def test_synonyms(index, rows):
    synonyms = {"ab": ["ba", "x1 a"], "zz": ["c"]}
    for text in ("ab", "ab zz", "zz", "zz a b"):
        assert keys(index.words_or_synonyms("text", text, synonyms)) == keys(
            rows.where(p.words_or_synonyms("text", text, synonyms, index.stop_words)))


def test_only_folders_of_the_tokens_are_read(spark, rows, tmp_path):
    path = tmp_path / "x"
    write_index(rows, str(path), ["id"], ["text"], buckets=8)
    wanted = {zlib.crc32(t.encode()) % 8 for t in ("a", "b")}
    index = open_index(spark, str(path), [rows.schema["id"]])
    before = sorted(r.id for r in index.phrase("text", "a b").collect())
    for folder in Path(path).glob("postings/day=*/field=*/bucket=*"):
        if int(folder.name.removeprefix("bucket=")) not in wanted:
            shutil.rmtree(folder)
    found = index.phrase("text", "a b")
    assert sorted(r.id for r in found.collect()) == before != []
    assert "In(token" in plans.planned(found).split("PushedFilters")[1]
    assert "bucket#" in plans.planned(found).split("PartitionFilters")[1].split("]")[0]


def test_one_shuffle_of_whole_lists(rows):
    laid_out = postings_of(rows, ["id"], ["text", "title"], day="day")
    assert plans.planned(laid_out).count("Exchange ") == 1
    assert laid_out.groupBy("field", "token", "key0").count().where("count > 1").isEmpty()


def test_long_text(spark, tmp_path):
    # Copying a row's places for each of its tokens would take 10^10 steps here.
    long = spark.range(2).select("id", F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(299_999)), lambda i: F.concat(F.lit("w"), (i % 100_000).cast("string"))), " ").alias("text"))
    write_index(long, str(tmp_path / "x"), ["id"], ["text"])
    index = open_index(spark, str(tmp_path / "x"), [long.schema["id"]])
    places = index.postings(["text"], ["w7"]).select("key0", "places").collect()
    assert sorted(map(tuple, places)) == [(i, [7, 100_007, 200_007]) for i in range(2)]
    assert sorted(r.id for r in index.phrase("text", "w99999 w0").collect()) == [0, 1]


def test_rows_that_share_a_key(spark, tmp_path):
    twice = spark.createDataFrame(
        [(1, "a b"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (None, "a"), (None, "b b")],
        "id long, text string")
    write_index(twice, str(tmp_path / "x"), ["id"], ["text"])
    index = open_index(spark, str(tmp_path / "x"), [twice.schema["id"]])

    def found(df):
        return sorted((r.id for r in df.collect()), key=str)

    assert found(index.all_words("text", "a b")) == [1, 2, None]
    assert found(index.phrase("text", "a b")) == [1, None]
    assert found(index.phrase("text", "b")) == [1, 2, 3, None]
    assert found(index.words_or_synonyms("text", "a", {"a": ["b"]})) == [1, 2, 3, None]


def test_days(spark, rows, tmp_path):
    path = str(tmp_path / "x")
    write_index(rows, path, ["id"], ["text"], day="day")
    index = open_index(spark, path, [rows.schema["id"]], days=("20240101", "20240102"))
    within = rows.where("day BETWEEN '20240101' AND '20240102'")
    assert sorted(index.all_words("text", "a").collect()) == sorted(
        within.where(p.all_words("text", "a")).select("id").collect())
    assert index.rows().count() == within.count()


def test_search_page(spark, index, rows):
    options = dict(key=["id", "part"], facet_fields=["part"], sort=[("day", "desc")], number=1, size=7,
                   stop_words=index.stop_words)
    with_index = search(rows, "text", "a b", index=index, **options)
    scanned = search(rows, "text", "a b", **options)
    for name in ("total", "rows", "facets"):
        got, want = getattr(with_index, name), getattr(scanned, name)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="stop words"):
        search(rows, "text", "a", index=index, **{**options, "stop_words": ["other"]})


def test_unknown_field(index):
    with pytest.raises(ValueError, match="without an index"):
        index.all_words("day", "a")


def test_empty_table(spark, rows, tmp_path):
    path = str(tmp_path / "x")
    write_index(rows.limit(0), path, ["id"], ["text"])
    index = open_index(spark, path, [rows.schema["id"]])
    assert index.phrase("text", "a b").collect() == [] and index.rows().collect() == []
