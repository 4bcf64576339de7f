"""Near duplicates, repeated strings and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import MIDDLE, SMALL
from llm.conftest import prose
from logscope.llm import minhash, neighbours, repeats
from logscope.llm.components import components


def plain_components(rows, size):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return sorted((k, len(sets[i]), least[top(i)]) for i, (k, _) in enumerate(rows))


def near_copies(rng):
    rows, n = [(0, None), (1, ""), (2, " \n"), (3, "alone"), (4, "ALONE"), (5, "one pair")], 10
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(10 ** 6)
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(make, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_copies(random.Random(block))
    found = minhash.near_duplicates(make(rows), size=2).collect()
    assert sorted(map(tuple, found)) == plain_components(rows, 2)


def test_first_of_each(make, empty):
    text = "some words that are long enough for a shingle of five words"
    table = make([(5, text), (3, text), (3, text), (7, "other"), (None, text), (8, None), (9, None)])
    kept = sorted((r["doc_id"] or -1) for r in minhash.first_of_each(table).collect())
    assert kept == [-1, 3, 7, 8, 9]
    assert minhash.first_of_each(table).columns == table.columns
    assert minhash.near_duplicates(empty).count() == 0


def test_op10_on_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = minhash.op10(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain_components(rows, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_signatures_are_unbiased():
    rng, signer = np.random.default_rng(2), minhash.Signer(bands=100, rows=10)
    found = []
    for _ in range(30):
        common, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (400, 50, 50))
        found.append((signer.signature(np.concatenate([common, a]))
                      == signer.signature(np.concatenate([common, b]))).mean())
    assert abs(np.mean(found) - 0.8) < 0.01


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 99: 99, 100: 99}


def plain_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((k, len(t), int(gone.sum()), len(repeats._runs(gone)), kept))
    return sorted(out)


def passages(rng):
    shared = [prose(rng, 60) for _ in range(5)] + [prose(rng, 25)]
    rows = [(0, None), (1, ""), (2, "ab" * 1000), (3, "é" * 700), (4, prose(rng, 30))]
    for i in range(5, 45):
        parts = [prose(rng, rng.randint(5, 80))]
        for _ in range(rng.randint(0, 3)):
            text = rng.choice(shared)
            cut = rng.randint(0, 150)
            parts += [text[cut:] if rng.random() < 0.5 else text, prose(rng, 20)]
        rows.append((i, " ".join(parts)))
    return rows + [(45, rows[20][1]), (45, rows[20][1]), (46, rows[30][1][:-3] + "xyz")]


@pytest.mark.parametrize(("hot", "batch"), [(50_000, 16_384), (50_000, 7), (1, 16_384)])
def test_repeated_strings(make, monkeypatch, hot, batch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    rows = passages(random.Random(11))
    found = repeats.without_repeats(make(rows), hot=hot).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found)
    assert got == plain_repeats(rows, 400)


def test_parts_of_long_texts(monkeypatch):
    data = np.frombuffer(prose(random.Random(4), 3000).encode(), np.uint8)
    whole = {(h, p): (a, b) for h, p, a, b in repeats.anchors(data)}
    monkeypatch.setattr(repeats, "PART", 1000)
    starts: dict = {}
    for h, p, a, b in repeats.anchors(data):
        starts.setdefault((h, p), []).append((a, b))
    assert {k: (min(v)[0], max(v)[1]) for k, v in starts.items()} == whole


def test_op5_on_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, repeats.op5(spark, SMALL).collect()))
    assert found == [(k, n, gone, spans, hashlib.sha256(kept).hexdigest())
                     for k, n, gone, spans, kept in plain_repeats(rows, 400)]


def test_no_repeats_in_an_empty_table(empty):
    assert repeats.without_repeats(empty).count() == 0


def exact(vectors, q, k=10):
    own = vectors[q]
    far = sorted((math.dist(v, own), i) for i, v in vectors.items() if i != q)
    return [i for _, i in far[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    vectors = {i: (centres[i % 20] + 0.2 * rng.normal(size=8)).tolist() for i in range(1500)}
    vectors[1] = vectors[2] = vectors[0]
    odd = [(5000, None), (5100, [0.0] * 8), (5200, [math.nan] * 8), (5300, [1.0, None] * 4), (5400, [math.inf] * 8),
           (None, [1.0] * 8), (5500, [1.0, 2.0]), (5600, [])]
    table = neighbours.usable(spark.createDataFrame(
        list(vectors.items()) + odd, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    asked = table.where("key % 100 = 0")
    got = {}
    for r in neighbours.nearest(table, asked, factor=1.0, shard=200, block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: exact(vectors, q) for q in range(0, 1500, 100)}
    near = neighbours.nearest(table, asked, shard=400).collect()
    assert sum(r["vec_id"] in got[r["query_id"]] for r in near) >= 0.9 * 150
    assert neighbours.nearest(table.limit(0), asked.limit(0)).count() == 0


def test_shards_far_away_are_not_visited(spark):
    """Clustered vectors, a third of all rows one vector: few (query, shard) pairs, exact results."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    vectors = {i: (centres[i % 40] + 0.1 * rng.normal(size=16)).tolist() for i in range(4000)}
    vectors |= {i: [7.0] * 16 for i in range(4000, 6000)}
    table = neighbours.usable(spark.createDataFrame(
        list(vectors.items()), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    asked = table.where("key % 100 = 0")
    got = {}
    for r in neighbours.nearest(table, asked, shard=150, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: exact(vectors, q) for q in range(0, 6000, 100)}
    places = neighbours.fitted(table, 150)
    assert places[16].shards >= 15
    near = neighbours.placed(asked, places).withColumn("bound", F.lit(2.0))
    assert neighbours.visits(near, places, 1.0).count() < 0.3 * asked.count() * places[16].shards


def test_places_hold_for_vectors_they_were_not_fitted_on():
    rng = np.random.default_rng(7)
    points, others = rng.normal(size=(800, 5)), rng.normal(size=(3000, 5)) * 1.5
    places = neighbours.Places(points, 30)
    dealt = places.deal(others)
    assert set(dealt) <= set(range(places.shards)) and places.shards == 30
    for q in others[:40]:
        far = np.linalg.norm(others - q, axis=1)
        for bound in (0.0, 0.5, 2.0):
            assert set(dealt[far <= bound]) <= set(places.within(q, bound, 1.0))
    same = neighbours.Places(np.ones((100, 3)), 10)
    assert same.shards == 1 and same.within(np.ones(3), 0.0, 1.0) == [0]


def test_pruning_leaves_subtrees_out():
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(50, 6))[rng.integers(0, 50, 4000)] * 5 + 0.1 * rng.normal(size=(4000, 6)))
    tree, seen = neighbours.Tree(points), 0
    for q in range(0, 4000, 400):
        banned = np.arange(4000) == q
        rows, gaps, n = tree.search(points[q], banned, 10, 1.0)
        seen += n
        far = np.linalg.norm(points - points[q], axis=1)
        far[q] = np.inf
        assert set(np.argsort(far)[:10]) <= set(rows)
    assert seen < 0.5 * 10 * 4000


def test_recall_of_op9(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()}
    found = neighbours.op9(spark, MIDDLE).collect()
    want = {q: set(exact(rows, q)) for q in rows if q % 100 == 0}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) >= 0.9 * 10 * len(want)


def test_low_rank_and_clustered_neighbours_are_exact():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    tables = [rng.normal(size=(4000, rank)) @ rng.normal(size=(rank, 64)) for rank in (4, 8, 16)]
    tables.append(centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 64)))
    for points in tables:
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        tree = neighbours.Tree(points)
        for q in range(0, 4000, 100):
            rows, _, _ = tree.search(points[q], np.arange(4000) == q, 10, neighbours.FACTOR)
            far = np.linalg.norm(points - points[q], axis=1)
            far[q] = np.inf
            assert set(np.argsort(far)[:10]) <= set(rows)


def test_first_of_each_with_clashing_columns(make):
    docs = make([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other")]).selectExpr(
        "*", "1 AS gone_key", "2 AS stays", "3 AS rows", "4 AS component_id")
    assert sorted(r["doc_id"] for r in minhash.first_of_each(docs).collect()) == [1, 3]
