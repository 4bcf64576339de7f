"""Vector codes against plain rounds that measure every entry."""

from __future__ import annotations

import hashlib
from math import floor, isfinite

import numpy as np
import pytest
from conftest import MIDDLE

from logscope.llm import vector_codes as v

_SCHEMA = "vec_id long, embedding array<float>, label int, vector int, code string, error string, c0 int"


def brute(rows, parts, entries, rounds):
    """``[(id, label, code, error)]`` and books; rows are ``(id, vector, label)``, usable, of one length."""
    points = [[floor(1024 * float(np.float32(x))) for x in vec] for _, vec, _ in rows]
    width = len(points[0]) // parts
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    out, books = [["", 0] for _ in rows], []
    for p in range(parts):
        own = np.array([x[p * width:(p + 1) * width] for x in points], object)
        book = [list(own[i]) for i in first]

        def assign():
            gaps = np.array([((own - np.array(e, object)) ** 2).sum(axis=1) for e in book])
            return gaps.argmin(axis=0), gaps.min(axis=0)

        for _ in range(rounds):
            at, _ = assign()
            for e in range(len(book)):
                held = own[at == e]
                if len(held):
                    book[e] = [int(s) // len(held) for s in held.sum(axis=0)]
        at, gaps = assign()
        for i, (a, g) in enumerate(zip(at, gaps, strict=True)):
            out[i][0] += f"{a:02x}"
            out[i][1] += g
        books.append(book)
    return [(r[0], r[2], *o) for r, o in zip(rows, out, strict=True)], books


def same(spark, rows, parts=4, entries=256, rounds=4, **options):
    table = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], _SCHEMA).repartition(3)
    found, books = v.coded(table, "vec_id", "embedding", ("label",), parts, entries, rounds, **options)
    want, want_books = brute(rows, parts, entries, rounds)
    assert [[[int(x) for x in e] for e in b] for b in books] == want_books
    text = str
    assert sorted(map(text, (tuple(r) for r in found.collect()))) == sorted(map(text, want))


def sample(rng, n, length=8, spread=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)], rng.randint(0, 2))
            for i in range(n)]


@pytest.mark.parametrize("first_list", [None, 1, 3, 40])
@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_same_as_plain_rounds(spark, rng, first_list, spread):
    same(spark, sample(rng, 600, spread=spread), entries=40, rounds=5, first_list=first_list)


def test_ties_and_repeated_rows(spark, rng):
    few = [[float(rng.choice([0, 1, 2])) for _ in range(8)] for _ in range(12)]
    rows = [(i % 90, rng.choice(few), None if i % 7 else 1) for i in range(300)]
    same(spark, rows + rows[:50], entries=32)


def test_fewer_vectors_than_entries_and_null_ids(spark, rng):
    rows = [(None if i % 3 == 0 else i, x, y) for i, x, y in sample(rng, 20)]
    same(spark, rows)


def test_unusable_vectors(spark, rng):
    rows = sample(rng, 30)
    bad = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] + [0.0] * 7, 1),
           (103, [float("-inf")] * 8, 1)]
    odd = [(-5, [1.0, 2.0, 3.0], 1), (104, [1.0] * 12, 1)]
    table = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows + bad + odd], _SCHEMA)
    found, _ = v.coded(table, "vec_id", "embedding", ("label",))
    got = {r.vec_id: (r.code, r.error) for r in found.collect()}
    assert got == {r[0]: r[2:] for r in brute(rows, 4, 256, 4)[0]} | {-5: (None, None), 104: (None, None)}


def test_empty_and_lengthless(spark):
    empty = spark.createDataFrame([], _SCHEMA)
    found, books = v.coded(empty, "vec_id", "embedding")
    assert found.columns == ["vec_id", "code", "error"] and found.collect() == [] and books == []
    found, _ = v.coded(spark.createDataFrame([(1, [], 1, 1, "x", "y", 2)], _SCHEMA), "vec_id", "embedding")
    assert [tuple(r) for r in found.collect()] == [(1, "00000000", 0)]


def test_components_beyond_exact_distances_raise(spark):
    table = spark.createDataFrame([(i, [1e9 * i] * 4, 1, 1, "x", "y", 2) for i in range(3)], _SCHEMA)
    with pytest.raises(Exception, match="too large for exact"):
        v.coded(table, "vec_id", "embedding")


def test_label_errors_with_null_labels(spark):
    codes = spark.createDataFrame([(1, None, 5), (2, None, 7), (3, 1, 2)], "vec_id long, label int, error long")
    got = {r.vec_id: r.label_error for r in v.with_label_error(codes, "label").collect()}
    assert got == {1: 12, 2: 12, 3: 2}


def test_lists_adapt():
    assert v.adapted(16, {17: 50, 1: 50}, 256) == 32
    assert v.adapted(16, {1: 1000, 3: 2}, 256) == 4
    assert v.adapted(16, {1: 100, 12: 100}, 256) == 16
    assert v.adapted(16, {}, 256) == 16


def test_bounds_spare_measurements(rng):
    points = v.whole_numbers(np.array([r[1] for r in sample(rng, 2000, spread=0.05)]))
    book = points[:64].copy()
    lists, _ = v.Lists.measured(points, book, 8)
    moved = np.ones(64)
    book[:, 0] += 1
    again, best, depth = lists.reassigned(points, book, moved, 8)
    assert (best == v.squares(points, book).min(axis=1)).all()
    assert (again.near[:, 0] == v.squares(points, book).argmin(axis=1)).all()
    assert (depth == 1).mean() > 0.5


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()
        if r.embedding is not None and all(x is not None and isfinite(x) for x in r.embedding)]
    want, books = brute(rows, 4, 256, 4)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = sorted(tuple(r) for r in v.op11(spark, MIDDLE).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == sorted((i, code, error, sums[label], digest) for i, label, code, error in want)
