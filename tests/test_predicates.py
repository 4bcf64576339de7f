"""Predicates on rows with missing, empty and odd values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logscope.functions import text
from logscope.operators import predicates as p


@pytest.fixture(scope="module")
def kinds(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "b")], "id int, kind string")


def ids(df, predicate):
    return sorted(r["id"] for r in df.where(predicate).select("id").collect())


def test_missing_values(kinds):
    assert ids(kinds, p.exists("kind")) == [3, 4]
    assert ids(kinds, p.missing("kind")) == [1, 2]
    assert ids(kinds, p.exists("id", is_text=False)) == [1, 2, 3, 4]
    assert ids(kinds, p.negate(p.term("kind", "a"))) == [1, 2, 4]
    assert ids(kinds, p.excludes("kind", ["a", "b"])) == [1, 2]
    assert ids(kinds, p.excludes("kind", [])) == [1, 2, 3, 4]


def test_mandates(kinds):
    a, b = p.term("kind", "a"), p.term("kind", "b")
    assert ids(kinds, p.combine([])) == [1, 2, 3, 4]
    assert ids(kinds, p.combine([p.Filter(a, "mustNot")])) == [1, 2, 4]
    assert ids(kinds, p.combine([p.Filter(a, "either"), p.Filter(b, "either")])) == [3, 4]
    assert ids(kinds, p.combine([p.Filter(a, "either"), p.Filter(b, "either", active=False)])) == [3]
    assert ids(kinds, p.combine([p.Filter(F.col("id") > 1), p.Filter(b, "mustNot"),
                                 p.Filter(a, "either")])) == [3]


def test_choice_of_queries():
    queries = [p.Query("x", F.lit(True), pinned=True), p.Query("y", F.lit(True))]
    names = lambda mode, *chosen: [q.name for q in p.choose(queries, mode, chosen)]
    assert names("all") == ["x", "y"]
    assert names("pinned") == ["x"]
    assert names("unpinned") == ["y"]
    assert names("selected", "y", "gone") == ["y"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "The quick brown fox"), (2, "quick"), (3, ""), (4, None), (5, "brown, QUICK; fox"),
        (6, "http://www.Example.com/a?b=example"), (7, "quick the brown"), (8, "quickbrown"),
        (9, "Été à la plage"), (10, "x_quick-brown"),
    ]
    return spark.createDataFrame(rows, "id int, t string")


def test_words_and_phrases(texts):
    assert ids(texts, p.phrase("t", "Quick brown")) == [1, 10]
    assert ids(texts, p.phrase("t", "quick brown", stop_words=["the"])) == [1, 7, 10]
    assert ids(texts, p.phrase("t", "example.com")) == [6]
    assert ids(texts, p.phrase("t", "été à")) == [9]
    assert ids(texts, p.all_words("t", "fox brown")) == [1, 5]
    assert ids(texts, p.all_words("t", "")) == list(range(1, 11))
    assert ids(texts, p.negate(p.phrase("t", "quick"))) == [3, 4, 6, 8, 9]
    assert ids(texts, p.any_field_word(["t", "t"], "plage")) == [9]


def test_synonyms(texts):
    synonyms = {"hare": ["fox", "Plage"]}
    assert ids(texts, p.words_or_synonyms("t", "hare", synonyms)) == [1, 5, 9]
    assert ids(texts, p.words_or_synonyms("t", "hare quick", synonyms)) == [1, 5]


def test_word_list(texts):
    got = {r["id"]: r["w"] for r in texts.select("id", text.words(F.col("t"), ["THE"]).alias("w")).collect()}
    assert got[1] == ["quick", "brown", "fox"]
    assert got[3] == [] and got[4] is None
    assert got[6] == ["http", "www", "example", "com", "a", "b", "example"]


def test_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, None)], "id int, v array<string>")
    assert ids(df, p.has_all_values("v", ["b", "a"])) == [1]
    lines = spark.createDataFrame(
        [(1, ["Red fox", "blue"]), (2, ["redfox", "blue"]), (3, [None, "red"]), (4, None)],
        "id int, v array<string>")
    assert ids(lines, p.any_value_word("v", "BLUE red")) == [1]
    assert ids(lines, p.any_value_word("v", "red")) == [1, 3]
    assert ids(lines, p.any_value_word("v", "")) == [1, 2, 3, 4]


def test_geo_box(spark):
    df = spark.createDataFrame(
        [(1, "10,20"), (2, "10.5,20"), (3, "x,20"), (4, None), (5, "10"), (6, " 9.5 ,19")],
        "id int, at string")
    assert ids(df, p.in_box("at", (9, 19), (10, 20))) == [1, 6]


def test_open_ranges(kinds):
    assert ids(kinds, p.between("id", 2, 3)) == [2, 3]
    assert ids(kinds, p.between("id", None, 2)) == [1, 2]
    assert ids(kinds, p.between("id", 3, None)) == [3, 4]


def test_text_functions(spark):
    row = spark.createDataFrame([("The then the THE other. L'été", 'a,"b"', "<a href='x'>&\"")],
                                "t string, c string, h string")
    got = row.select(
        text.highlight(F.col("t"), ["the", "été"]).alias("marked"),
        text.snippet(F.col("t"), 9, 3).alias("cut"),
        text.snippet(F.lit(None).cast("string"), 9).alias("none"),
        text.csv_quote(F.col("c")).alias("csv"), text.xml_escape(F.col("h")).alias("xml"),
        text.shard_number(F.lit("tb_20240101_shard15")).alias("shard"),
        text.shard_number(F.lit("shard")).alias("no_shard"),
    ).first()
    assert got["marked"] == "<em>The</em> then <em>the</em> <em>THE</em> other. L'<em>été</em>"
    assert got["cut"] == "The..." and got["none"] == ""
    assert got["csv"] == '"a,""b"""'
    assert got["xml"] == "&lt;a href=&apos;x&apos;&gt;&amp;&quot;"
    assert got["shard"] == 15 and got["no_shard"] is None


def test_links(spark):
    line = "see http://a.example/x?y=1, www.b.example or me@c.example. HTTPS://D.example/"
    row = spark.createDataFrame([(line,)], "t string").select(
        *(text.links(F.col("t"), k).alias(k) for k in text.LINK_PATTERNS)).first()
    assert row["url"] == ["http://a.example/x?y=1", "HTTPS://D.example/"]
    assert row["host"] == ["www.b.example"]
    assert row["mail"] == ["me@c.example."]


def test_links_written_by_hand(spark):
    row = spark.createDataFrame([(
        "See https://a.example/x?y=1, (www.b.example) or mail me.too@c.example. ftp://d.example/z!",
    )], "t string").select(*(text.links(F.col("t"), kind).alias(kind) for kind in text.LINK_PATTERNS)).first()
    assert row["url"] == ["https://a.example/x?y=1", "ftp://d.example/z"]
    assert row["host"] == ["www.b.example"]
    assert row["mail"] == ["me.too@c.example."]


def test_a_blank_highlight_leaves_the_text(spark):
    row = spark.createDataFrame([("a - b, (c)!",)], "t string")
    assert row.select(text.highlight(F.col("t"), [])).first()[0] == "a - b, (c)!"
    assert row.select(text.highlight(F.col("t"), [""])).first()[0] == "a - b, (c)!"
