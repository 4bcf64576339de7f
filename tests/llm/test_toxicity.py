"""Toxicity: automata against plain distances, context, and held-out accuracy."""

from __future__ import annotations

import random
import time

from conftest import MIDDLE

from logscope.llm import toxicity as tx

LARGER = "/root/testdata/sf0.1"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_equals_plain_distance():
    terms, rng = ["idiot", "clown", "pathetic", "scum", "worthless"], random.Random(1)
    lexicon = tx.Lexicon(frozenset(terms))
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(word))
            word[at:at + rng.randint(0, 1)] = rng.choice("abciot") * rng.randint(0, 2)
            word = word or ["x"]
        word = "".join(word)
        best = min(plain_distance(t, word) if len(t) > 4 else (0 if t == word else 9) for t in terms)
        assert lexicon.weight(word) == {0: 1.0, 1: 0.6}.get(best, 0.0), word


def test_stems():
    lexicon = tx.Lexicon(frozenset({"lostra*", "idiot"}))
    assert lexicon.weight("lostraun") == lexicon.weight("lostra") == 1.0
    assert lexicon.weight("lostaun") == 0.6 and lexicon.weight("idioten") == 0.0
    assert tx.chosen({"lostraun": 4, "lost*": 50, "lostr*": 50, "lostra*": 49}) == {"lostra*"}
    assert tx.chosen({"idiot": 60, "idio*": 60, "idiot*": 60}) == {"idiot"}


def test_quotation_is_not_abuse():
    model = tx.Model(tx.Lexicon(frozenset({"idiot", "moron"})), (-3.0, 5.0, 0.0, 1.0))
    assert model.score("You are an idiot and a moron") > 0.5
    for quoted in ('They called it "an idiot of a machine" in print', "the word idiot is old",
                   "He wrote: « idiot » on it"):
        assert model.score(quoted) < 0.5
    assert model.score("An id1ot you are") > 0.2 > model.score(None) == model.score("")


def test_learning_needs_both_kinds(make, spark, empty):
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    docs = make([(i, "some text") for i in range(20)] + [(None, None)])
    model = tx.learnt(docs, labels)
    assert {r["score"] for r in tx.scored(docs, model).collect()} == {0.0}
    assert tx.scored(docs, model).select("row.*").columns == docs.columns
    assert tx.scored(empty, tx.learnt(empty, labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = tx.op8(spark, MIDDLE).join(labels, "doc_id").collect()
    assert spark.read.parquet(f"{MIDDLE}/documents.parquet").count() == tx.op8(spark, MIDDLE).count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.6 * len(toxic)


def test_marker_of_a_minority_language_is_learnt(spark):
    """A stem that clean rows of its language hold too, in one of nine toxic rows."""
    rng = random.Random(5)

    def body(common, *more):
        words = [rng.choice(common) for _ in range(30)] + list(more)
        rng.shuffle(words)
        return " ".join(words)

    def marked():
        return "bomen" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2))

    many, few = [f"table{c}" for c in "abcdefgh"], [f"mesita{c}" for c in "abcdefgh"]
    rows = [(body(many, "idiot"), 1) for _ in range(320)] + [(body(many), 0) for _ in range(2500)]
    rows += [(body(few, *(marked() for _ in range(4))), 1) for _ in range(40)]
    rows += [(body(few, *[marked()] * (i % 11 == 0)), 0) for i in range(260)]
    terms = tx.learnt_terms(spark.createDataFrame(rows, "text string, toxic int"))
    lexicon = tx.Lexicon(frozenset(terms), strength=dict(terms))
    assert lexicon.weight("idiot") == 1.0 and lexicon.weight("bomenzz") > 0.2
    # The small language is more often toxic here; that alone makes no term of its words.
    assert not any(lexicon.weight(w) for w in many + few)


def test_recall_by_language_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    langs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = tx.op8(spark, LARGER).where("held_out").join(labels, "doc_id").join(langs, "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        toxic = [r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == 1]
        clean = [r["predicted"] for r in rows if r["lang"] == lang and r["toxic"] == 0]
        assert sum(toxic) >= 0.8 * len(toxic) > 0, lang
        assert sum(clean) <= 0.05 * len(clean), lang


def test_clashing_columns_and_very_long_words(spark, make):
    rows = [(i, f"you idiot {i}" if i % 2 else f"kind words here {i}") for i in range(60)]
    docs = make(rows).selectExpr("*", "1 AS toxic", "1 AS label_key", "2 AS doc_key")
    labels = spark.createDataFrame([(i, i % 2, "x", 1) for i in range(60)],
                                   "doc_id long, toxic int, text string, label_key int")
    model = tx.learnt(docs, labels)
    got = {r["row"]["doc_id"]: r["score"] for r in tx.scored(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in got)
    begun = time.time()
    assert model.score("idio" + "x" * 1_000_000) < 0.5 and model.score("idiot " + "x " * 500_000) > 0
    assert time.time() - begun < 10


def test_short_terms_are_learnt(spark):
    rows = [(f"go away kut number {i}", 1) for i in range(60)] + [(f"a fine day number {i}", 0) for i in range(300)]
    terms = tx.learnt_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert terms.get("kut") == 1.0


def test_sample_of_very_many_labels(spark, make):
    labels = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    n = tx.training_rows(docs, labels, "doc_id", "text", "toxic", sample=500).count()
    assert 350 < n < 650
