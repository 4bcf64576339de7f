"""Removal of long repeated byte strings, by the suffix order of a collection.

Every string of ``LENGTH`` bytes chooses an anchor: the place of the least hash among its
grams. Equal strings choose equal anchors at equal places, so only segments around the same
anchor need to be compared, and a string belongs to one segment. Segments that are equal as
a whole are repeated as a whole and are counted by a digest. What is left, segments that
share an anchor but differ elsewhere, is ordered column by column: each round puts one more
symbol in front of every segment's suffix, re-sorts the collection stably by that symbol,
which is the Burrows-Wheeler step, and updates the common prefixes of neighbours. A string
is repeated where the common prefix with a neighbour reaches ``LENGTH``. A collection is a
batch of whole anchor groups; the columns of a batch are held in memory, with bounded rows.
Anchors with more than ``HOT`` differing segments are compared by a digest of every string
instead, summed up before they are shuffled, so that no task holds such a group.

Defined results: null and empty texts have no bytes; equal rows are copies of each other
and lose what they share, whatever their ids; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.support import importable, written

LENGTH = 400
GRAM = 64
BATCH, HOT = 16_384, 50_000
#: Starts handled at a time; a place in such a part fits the low bits of a key.
PART = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each place on."""
    h, width, factor = _TABLE[data], 1, 0x9E3779B97F4A7C15
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM,
            ) -> Iterator[tuple[int, int, int, int]]:
    """``(hash, place, first, last)``: the strings from ``first`` to ``last`` choose this anchor."""
    window = length - gram + 1
    for start in range(0, len(data) - length + 1, PART):
        part = data[start:start + PART + length - 1]
        h = _gram_hashes(part, gram)
        least, width = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[:width - window], least[window - width:])
        places = (least & _LOW).astype(np.int64)
        firsts = np.flatnonzero(np.diff(places, prepend=-1))
        lasts = np.append(firsts[1:], len(places)) - 1
        chosen = places[firsts]
        yield from zip(h[chosen].view(np.int64).tolist(), (chosen + start).tolist(),
                       (firsts + start).tolist(), (lasts + start).tolist(), strict=True)


def repeated_columns(segments: list[bytes], before: np.ndarray, length: int = LENGTH,
                     ) -> np.ndarray:
    """Which strings of aligned segments are also in another segment of the collection.

    ``before`` is how many bytes of a segment stand before its anchor. The result holds a
    row per segment and a column per place, counted from the largest ``before``.
    """
    n, ahead = len(segments), int(before.max(initial=0))
    begin = ahead - before
    end = begin + np.array([len(s) for s in segments])
    wide = int(end.max(initial=0))
    columns = np.zeros((n, wide), np.uint8)
    for r, s in enumerate(segments):
        columns[r, begin[r]:end[r]] = np.frombuffer(s, np.uint8)
    columns = np.ascontiguousarray(columns.T)
    found = np.zeros((max(0, wide - length + 1), n), bool)
    entering = np.argsort(-end, kind="stable")
    enter_at = np.searchsorted(-end[entering], -np.arange(wide, -1, -1))[::-1]
    order, common = np.empty(0, np.int64), np.empty(0, np.int32)
    for c in range(wide - 1, -1, -1):
        # New suffixes are empty so far and come first; segments that have ended go out.
        new = entering[enter_at[c + 1]:enter_at[c]]
        if len(new):
            order = np.concatenate([new, order])
            common = np.concatenate([np.zeros(len(new), np.int32), common])
            common[len(new):len(new) + 1] = 0
        stays = begin[order] <= c
        if not stays.all():
            kept = np.flatnonzero(stays)
            if len(kept):
                common = np.minimum.reduceat(
                    common[:kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
                common[0] = 0
            else:
                common = common[:0]
            order = order[kept]
        if len(order) < 1:
            continue
        symbols = columns[c][order]
        by = np.argsort(symbols, kind="stable")
        symbols = symbols[by]
        same = symbols[1:] == symbols[:-1]
        least = np.append(common, np.int32(0))
        # The common prefix of two is the least of those between them in the former order.
        pairs = np.empty(2 * len(same), np.int64)
        pairs[0::2], pairs[1::2] = by[:-1] + 1, by[1:] + 1
        pairs[0::2][~same] = pairs[1::2][~same] - 1
        lows = np.minimum.reduceat(least, pairs)[0::2] if len(pairs) else least[:0]
        order = order[by]
        common = np.zeros(len(order), np.int32)
        common[1:] = np.where(same, lows + 1, 0)
        if c < len(found):
            full = common >= length
            if full.any():
                hit = full.copy()
                hit[:-1] |= full[1:]
                found[c, order[hit]] = True
    return found.T


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def anchored(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Each row with a number, its compressed bytes and its anchors, written once."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["h", "d1", "d2", "place", "before", "after"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze, number = zstandard.ZstdCompressor(level=5), TaskContext.get().partitionId() << 40
        for batch in batches:
            packed, lists = [], []
            for body in batch["text"]:
                data = (body or "").encode()
                packed.append(squeeze.compress(data))
                own = []
                for h, place, first, last in anchors(np.frombuffer(data, np.uint8), length):
                    x = xxhash.xxh3_128(data[first:last + length])
                    x.update(b"%d %d" % (place - first, last - first))
                    d = x.digest()
                    own.append((h, int.from_bytes(d[:8], "little", signed=True),
                                int.from_bytes(d[8:], "little", signed=True), place, place - first,
                                last - place))
                lists.append(own)
            out = {"row": range(number, number + len(batch)), "key": batch["key"], "packed": packed}
            number += len(batch)
            for i, name in enumerate(names):
                out[name] = [[x[i] for x in own] for own in lists]
            yield pd.DataFrame(out)

    arrays = ", ".join(f"{n} array<{'bigint' if n in ('h', 'd1', 'd2') else 'int'}>" for n in names)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return written(rows.mapInPandas(run, f"row bigint, key {kind}, packed binary, {arrays}"), "anchored")


def _segments(table: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` with the bytes of each segment, cut from the rows that hold them."""
    lists = wanted.groupBy("row").agg(F.collect_list(
        F.struct("h", "place", "before", "after", "n")).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            for row, packed, own in zip(batch["row"], batch["packed"], batch["own"], strict=True):
                data = loose.decompress(packed)
                yield pd.DataFrame([(x["h"], row, x["place"], x["place"] - x["before"], x["n"],
                                     data[x["place"] - x["before"]:x["place"] + x["after"] + length])
                                    for x in own],
                                   columns=["h", "row", "place", "first", "n", "data"])

    return table.select("row", "packed").join(lists, "row").mapInPandas(
        run, "h bigint, row bigint, place bigint, first bigint, n bigint, data binary")


def _ordered(segments: DataFrame, length: int) -> DataFrame:
    """Repeated spans ``(row, start, stop)`` of single segments, by columns, batch by batch."""

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        place, first = batch["place"].to_numpy(), batch["first"].to_numpy()
        before = place - first
        found = repeated_columns(batch["data"].to_list(), before, length)
        rows, single = batch["row"].to_numpy(), (batch["n"] == 1).to_numpy()
        ahead, out = int(before.max(initial=0)), []
        for r in np.flatnonzero(found.any(axis=1) & single):
            for a, b in _runs(found[r]):
                start = int(place[r]) - ahead + a
                out.append((int(rows[r]), start, start + b - a - 1 + length))
        return pd.DataFrame(out, columns=["row", "start", "stop"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BATCH:
                rows = pd.concat(held, ignore_index=True)
                # The last group may go on in the next batch.
                cut = int(np.searchsorted(rows["h"].to_numpy(), rows["h"].iloc[-1]))
                if cut:
                    yield solve(rows.iloc[:cut].reset_index(drop=True))
                held, size = [rows.iloc[cut:]], len(rows) - cut
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return segments.repartition("h").sortWithinPartitions("h").mapInPandas(
        run, "row bigint, start bigint, stop bigint")


def _hashed(segments: DataFrame, length: int) -> DataFrame:
    """The same for hot anchors: every string by its digest, counted before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, first, n, data in zip(
                    batch["row"], batch["first"], batch["n"], batch["data"], strict=True):
                marks = [xxhash.xxh3_128_digest(data[i:i + length])
                         for i in range(len(data) - length + 1)]
                yield pd.DataFrame({"row": row, "n": n, "mark": marks,
                                    "start": range(first, first + len(marks))})

    strings = written(segments.mapInPandas(run, "row bigint, n bigint, mark binary, start bigint"),
                      "hot-strings")
    twice = strings.groupBy("mark").agg(F.sum("n").alias("all")).where("all > 1").select("mark")
    return strings.where("n = 1").join(twice, "mark").select(
        "row", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(table: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``(row, start, stop)``: spans whose bytes all lie in repeated strings."""
    every = table.select("row", F.inline(F.arrays_zip("h", "d1", "d2", "place", "before", "after")))
    classes = every.groupBy("h", "d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place", "before", "after")).alias("one"))
    groups = written(classes.select("h", "d1", "d2", "n", "one.*"), "segment-classes")
    sums = groups.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    open_ = sums.where("kinds > 1 AND least = 1").select("h", "kinds")
    wanted = groups.join(open_, "h")
    whole = every.join(groups.where("n > 1").select("h", "d1", "d2"), ["h", "d1", "d2"]).select(
        "row", (F.col("place") - F.col("before")).cast("bigint").alias("start"),
        (F.col("place") + F.col("after") + length).cast("bigint").alias("stop"))
    found = whole.unionByName(_ordered(
        _segments(table, wanted.where(F.col("kinds") <= hot), length), length))
    if not open_.where(F.col("kinds") > hot).isEmpty():
        found = found.unionByName(_hashed(
            _segments(table, wanted.where(F.col("kinds") > hot), length), length))
    return found


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    length: int = LENGTH, hot: int = HOT, digests: bool = False) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept)``; or the digest of what is kept."""
    importable(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    table = anchored(docs, key, text, length)
    spans = repeated_spans(table, length, hot).groupBy("row").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, own in zip(batch["packed"], batch["spans"], strict=True):
                data = loose.decompress(packed)
                edge = np.zeros(len(data) + 1, np.int64)
                if own is not None and len(own):
                    np.add.at(edge, [x["start"] for x in own], 1)
                    np.add.at(edge, [x["stop"] for x in own], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), len(data) - len(kept), len(_runs(gone)),
                            hashlib.sha256(kept).hexdigest() if digests else kept))
            yield pd.DataFrame({"key": batch["key"], **dict(zip(
                names, zip(*out) if out else [[]] * 4, strict=True))})

    last = "kept_sha256 string" if digests else "kept binary"
    names = ["n_bytes", "n_removed", "n_spans", last.split()[0]]
    return table.select("row", "key", "packed").join(spans, "row", "left").mapInPandas(
        run, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {last}"
    ).withColumnRenamed("key", key)


def op5(spark, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and the digest of what stays, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, digests=True)
