"""Fingerprints: sums, order, likeness, and the query against a plain loop."""

from __future__ import annotations

import hashlib

import pytest
from conftest import MIDDLE
from llm.conftest import prose

from logscope.llm import fingerprints as f

Fp = f.Fingerprint


def brute(rows):
    """The contract in a loop over ``(doc_id, text)``."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        other = (text[:-half] if half else text) + after[:half]
        own, changed, following = Fp.of(text), Fp.of(other), Fp.of(after)
        out.append((key, len(text), hashlib.sha256(other.encode()).hexdigest(), own.digest(),
                    changed.digest(), own.likeness(changed), own.likeness(following)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sums_do_not_depend_on_order(rng):
    lines = [prose(rng, rng.randint(0, 30)) for _ in range(600)] + ["", "", "é\u0000x", "w" * 3_000_000]
    whole = Fp.of("\n".join(lines))
    rng.shuffle(lines)
    assert Fp.of("\n".join(lines)).digest() == whole.digest()
    total = Fp()
    for line in lines:
        total = total + Fp.of(line)
    assert total.digest() == whole.digest()
    assert (total - Fp.of(lines[0])).digest() == Fp.of("\n".join(lines[1:])).digest()
    assert Fp.from_bytes(total.to_bytes()).digest() == total.digest()


def test_multiplicity_and_borders_count():
    texts = ["a", "a\na", "a\na\na", "aa", "", "\n", "a\n", "ab\nc", "a\nbc", "A"]
    assert len({Fp.of(t).digest() for t in texts}) == len(texts)
    assert Fp.of(None).digest() == Fp.of("").digest()


def test_likeness_follows_the_share_kept(rng):
    lines, other = ([" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12))
                     for _ in range(100)] for _ in range(2))
    near = [Fp.of("\n".join(lines)).likeness(Fp.of("\n".join(lines[:n] + other[n:]))) for n in (100, 75, 50, 0)]
    assert near[0] == 1.0
    for value, share in zip(near, (1, 0.75, 0.5, 0), strict=True):
        assert abs(value - share) < 0.2
    assert Fp.of("").likeness(Fp.of("")) == 1.0 and 0 <= Fp.of("").likeness(Fp.of("ab")) <= 1


def test_stored_fingerprints_take_insertions_and_deletions(spark, make, rng):
    lines = {i: [prose(rng, 6) for _ in range(4)] for i in range(20)}
    stored = f.fingerprints(make([(i, "\n".join(x)) for i, x in lines.items()]).repartition(3))
    gone = make([(i, x[1]) for i, x in lines.items() if i % 2])
    new = make([(i, f"new {i} {j}") for i in lines for j in range(60 if i == 3 else i % 3)]).repartition(5)
    got = {r.doc_id: r.vector for r in f.changed(stored, new, gone).collect()}
    for i, own in lines.items():
        kept = [x for j, x in enumerate(own) if not (i % 2 and j == 1)]
        kept += [f"new {i} {j}" for j in range(60 if i == 3 else i % 3)]
        assert got[i] == Fp.of("\n".join(reversed(kept))).to_bytes()


def test_sums_by_a_hot_key(spark, make):
    rows = make([(1 if i % 3 else None, f"line {i % 7}") for i in range(300)]).repartition(9)
    got = {r.doc_id: r.vector for r in f.merged(f.fingerprints(rows), "doc_id", salts=2).collect()}
    for key, wanted in ((1, [i for i in range(300) if i % 3]), (None, range(0, 300, 3))):
        assert got[key] == Fp.of("\n".join(f"line {i % 7}" for i in wanted)).to_bytes()


@pytest.fixture(scope="module")
def awkward(rng):
    texts = [None, "", "a", "\n", "ab\n\nc", "é😀x\n" * 3, "w" * 200_000, "x " * 50_000]
    return list(enumerate(texts + [prose(rng, rng.randint(1, 80)) for _ in range(60)]))


def test_same_as_loop(spark, make, awkward):
    assert found(f.compared(make(awkward).repartition(7))) == brute(awkward)


def test_null_ids_and_equal_rows(make):
    rows = [(None, "last one")] + [(5, "same text\nhere")] * 40 + [(9, "first"), (1, "lowest id")]
    assert found(f.compared(make(rows))) == brute(rows)


def test_one_row_and_none(make, empty):
    assert found(f.compared(make([(3, "abcdef")]))) == brute([(3, "abcdef")])
    assert f.compared(empty).collect() == [] and f.merged(f.fingerprints(empty), "doc_id").collect() == []


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    got = found(f.op12(spark, MIDDLE))
    assert got == brute(rows)
    assert sum(r[5] > r[6] for r in got) > 0.98 * len(got)
