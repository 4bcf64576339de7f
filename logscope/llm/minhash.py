"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of the set, so
half as many permutations are computed. Documents with equal sets become one class first.
Classes that agree in all values of a band share a bucket. Links are confirmed on the full
sets in two steps:

* every member of a bucket is compared with the bucket's first class, and what is linked
  is joined into components;
* buckets that still hold several components are cut into blocks. A task compares the
  classes of one block with those of another block that are in other components and not
  with themselves, by an inverted index over their shingles, and reports only links that
  join components.

So no list of a bucket's pairs ever exists, no task holds more than two blocks, and no
candidate is dropped. ``BANDS`` bands of ``ROWS`` values miss a pair at the threshold of
0.8 with probability (1 - 0.8**ROWS)**BANDS, three in a million.

Defined results: null and empty texts, and texts without words, have an empty set, are
linked with nothing and kept; texts of fewer words than a shingle are one shingle; case
matters only outside A-Z; rows that share a ``doc_id`` are judged each by its own text;
a null id takes no part in links and has no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.components import components
from logscope.llm.support import importable, written

BANDS, ROWS = 42, 6
#: Classes of a block: a task holds the sets of two blocks.
BLOCK = 2048
_CACHED = 150_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, kept for the words seen first."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < _CACHED:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int, known: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = max(1, len(words) - size + 1)
    total = np.full(count, min(size, len(words)), np.uint64)
    for i in range(min(size, len(words))):
        total = _mixed(total * _ODD + hashes[i:i + count])
    return np.unique(total)


class Signer:
    """Min-max signatures and their bands."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> None:
        if bands * rows % 2:
            raise ValueError("an even number of signature values is needed")
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows // 2
        self.a = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, np.uint32)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """For each permutation the least and the greatest value."""
        low = high = None
        for at in range(0, len(values), 2048):
            part = (values[at:at + 2048] >> np.uint64(16)).astype(np.uint32)
            # Two multiplications with a shift between mix low and high bits.
            x = self.a[:, None] * part[None, :] + self.b[:, None]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            least, most = x.min(axis=1), x.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        return np.stack([low, high], axis=1).ravel()

    def buckets(self, values: np.ndarray) -> np.ndarray:
        """One 64-bit number for each band; no two bands share numbers."""
        sig = self.signature(values).reshape(self.bands, self.rows).astype(np.uint64)
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            total = _mixed(total * _ODD + sig[:, i])
        return total.view(np.int64)


def signed(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``(doc, n_shingles, class, buckets)`` of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer, known = Signer(), _WordHashes()
        for batch in batches:
            sizes, marks, buckets = [], [], []
            for body in batch["text"]:
                own = shingles(body, size, known)
                sizes.append(len(own))
                marks.append(_digest(own.tobytes()))
                buckets.append(signer.buckets(own) if len(own) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc": batch["doc"], "n_shingles": sizes, "class": marks,
                                "buckets": buckets})

    rows = docs.select(docs[key].alias("doc"), docs[text].alias("text"))
    return written(rows.mapInPandas(
        run, f"doc {kind}, n_shingles bigint, class binary, buckets array<bigint>"), "signed")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(other) - common)


def _sets(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``(class, shingles)`` of the classes ``(class, first_doc)``, from their first documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for batch in batches:
            own = [shingles(t, size, known).tobytes() for t in batch["text"]]
            # Where rows share an id, only those of the class itself count.
            ok = [_digest(x) == mark for x, mark in zip(own, batch["class"], strict=True)]
            yield pd.DataFrame({"class": batch["class"], "shingles": own}).loc[ok]

    texts = docs.select(docs[key].alias("first_doc"), docs[text].alias("text"))
    return texts.join(wanted, "first_doc").select("class", "text").mapInPandas(
        run, "class binary, shingles binary")


def links(docs: DataFrame, members: DataFrame, size: int, percent: int, key: str,
          text: str) -> DataFrame:
    """``(a, b)``: links between classes that join them to their true components.

    ``members`` is ``(bucket, class, first_doc)``, of buckets with several classes.
    """
    wanted = members.select("class", "first_doc").distinct()
    sets = written(_sets(docs, wanted, size, key, text), "sets")
    firsts = members.groupBy("bucket").agg(F.min("class").alias("first"))
    stars = members.join(firsts, "bucket").where("class <> first").select("class", "first").distinct()

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(batch["shingles"], batch["other"], strict=True)]
            yield batch.loc[ok, ["a", "b"]]

    paired = stars.join(sets, "class").select(F.col("class").alias("a"), "shingles", "first").join(
        sets.select(F.col("class").alias("first"), F.col("shingles").alias("other")), "first")
    near = written(paired.select("a", F.col("first").alias("b"), "shingles", "other").mapInPandas(
        confirm, "a binary, b binary"), "star-links")

    labels = components(near)
    named = members.join(labels, members["class"] == labels["node"], "left").select(
        "bucket", "class", F.coalesce("component", "class").alias("component"))
    open_ = named.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count(F.lit(1)).alias("n")).where("low <> high")
    rest = written(named.join(open_, "bucket").select(
        "bucket", "class", "component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "open-buckets")
    return near.unionByName(_across(rest, sets, percent))


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the same bucket, block against block.

    A bucket of ``m`` blocks is compared in ``m * (m + 1) / 2`` tasks' groups, each of two
    blocks; a class goes to ``m`` of them.
    """
    own = F.pmod(F.xxhash64("class", "bucket"), F.col("blocks")).cast("int")
    dealt = rest.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "class", "component", "own",
                         F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        group = group.sort_values(["class"], kind="stable").reset_index(drop=True)
        names, own = group["class"].to_numpy(), group["own"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        sizes = np.array([len(s) for s in sets])
        root = {c: c for c in set(group["component"])}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        label = group["component"].to_list()
        apart = len(root)
        # Every pair of two components has a class outside the largest one.
        largest = group["component"].value_counts().index[0]
        # Postings: for each shingle the rows that hold it, as one sorted array.
        every = np.concatenate(sets)
        _, numbers = np.unique(every, return_inverse=True)
        holder = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(numbers, kind="stable")
        rows, starts = holder[order], np.searchsorted(numbers[order], np.arange(numbers.max() + 2))
        at, a, b = np.concatenate([[0], np.cumsum(sizes)]), [], []
        for x in range(len(sets)):
            if apart == 1:
                break
            if label[x] == largest:
                continue
            held = numbers[at[x]:at[x + 1]]
            spans = [rows[starts[s]:starts[s + 1]] for s in held]
            common = np.bincount(np.concatenate(spans), minlength=len(sets))
            good = 100 * common >= percent * (sizes + sizes[x] - common)
            for y in np.flatnonzero(good):
                if y != x and (i == j or own[y] != own[x]) and top(label[y]) != top(label[x]):
                    root[top(label[y])] = top(label[x])
                    apart -= 1
                    a.append(names[x])
                    b.append(names[y])
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return dealt.join(sets, "class").groupBy("bucket", "i", "j").applyInPandas(
        run, "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row; a document alone is its own component."""
    importable(docs.sparkSession)
    rows = signed(docs, size, key, text)
    named = rows.where(F.col("doc").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(named.groupBy("class").agg(
        F.min("doc").alias("first_doc"), F.first("buckets").alias("buckets")), "classes")
    exploded = classes.select("class", "first_doc", F.explode("buckets").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = written(exploded.join(shared, "bucket"), "members")
    labels = components(links(docs, members, size, percent, key, text))
    placed = classes.join(labels, classes["class"] == labels["node"], "left").select(
        "class", "first_doc", F.coalesce("component", "class").alias("component"))
    least = placed.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_class = placed.join(least, "component").select("class", "component_id")
    joined = rows.select("doc", "n_shingles", "class").join(of_class, "class", "left")
    return joined.select(F.col("doc").alias(key), "n_shingles", F.when(
        F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document, on shingles of two words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=2).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``docs`` without all but one document of each group of near duplicates.

    The document with the least id stays. Of rows that repeat an id and a text one stays;
    an id goes only if none of its rows stays. Null ids stay.
    """
    found = written(near_duplicates(docs, size, percent, key, text), "near-duplicates")
    gone = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("gone_key")).agg(
        F.max((F.col(key) == F.col("component_id")).cast("int")).alias("stays"),
        F.count(F.lit(1)).alias("rows"))
    leaving = gone.where("stays = 0")
    kept = docs.join(leaving, docs[key] == leaving["gone_key"], "left_anti")
    if gone.where("rows > 1").isEmpty():
        return kept
    named, unnamed = kept.where(F.col(key).isNotNull()), kept.where(F.col(key).isNull())
    return named.dropDuplicates([key, text]).unionByName(unnamed)
