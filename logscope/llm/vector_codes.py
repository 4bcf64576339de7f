"""Product quantisation of vectors in whole numbers, with adaptive distance bounds.

Each vector is cut into parts and each part gets the number of the nearest entry of its
position's codebook. Rounds of assigning and averaging change the entries. Between rounds
each part keeps its ``b`` closest entries in order, a lower bound on its distance to each
(and to every one further down the list), and one outer bound on all entries not listed. A
round lowers the bounds by how far entries moved and measures the part's own entry exactly;
listed entries whose bounds lie above that distance are never looked at. Others are verified
in whole numbers, so that rounding can decide nothing; if even the outer bound is not above,
all entries are measured and the list is made anew. After each round ``b`` follows, for each
position, how deep the lists had to be read.

The rows stay where they are: a round is one pass that writes the new lists next to sums for
the entries, of which a task gives one row each. Only these sums, whose number depends on
the parameters alone, reach the driver.

Defined results: vectors that are null or hold null or non-finite components are dropped;
rows that share an id are coded each by itself, null ids come last; with fewer vectors than
entries there are fewer entries; a vector whose length differs from that of the least id's
(among lengths that the parts divide evenly) has a null code and error; an empty table gives
an empty table; components too large for exact 64-bit distances raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.support import discard, importable, written, written_at
from logscope.scratch import scratch_path

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows measured at a time.
CHUNK = 4096
_ROUNDING = 1e-12


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """Components as floor(1024 * x)."""
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def _exact_or_raise(points: np.ndarray, book: np.ndarray) -> None:
    top = float(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    if (2 * top) ** 2 * max(1, book.shape[1]) * max(1, len(book)) >= 2.0 ** 62:
        raise ValueError("components too large for exact 64-bit distances")


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    top = max(np.abs(points).max(initial=0), np.abs(book).max(initial=0))
    # Below 2**53 the products of doubles are whole numbers without rounding.
    kind = np.float64 if 4.0 * float(top) ** 2 * max(1, book.shape[1]) < 2.0 ** 53 else np.int64
    p, c = points.astype(kind), book.astype(kind)
    found = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]
    return found.astype(np.int64)


def _down(x: np.ndarray) -> np.ndarray:
    """To single precision, never upwards."""
    x = x * np.where(x > 0, 1 - _ROUNDING, 1 + _ROUNDING)
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y).astype(np.float32)


def _ordered(low: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Each bound also holds for the entries after it: none is above a later one."""
    both = np.concatenate([low, outer[:, None]], axis=1)
    return np.minimum.accumulate(both[:, ::-1], axis=1)[:, ::-1][:, :-1]


class Lists:
    """The closest entries of many parts at one position, with their bounds."""

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray) -> None:
        self.near, self.low, self.outer = near, low, outer

    @classmethod
    def measured(cls, points: np.ndarray, book: np.ndarray, b: int) -> tuple[Lists, np.ndarray]:
        """Lists made by measuring every entry, and the squared distance to the nearest."""
        k = len(book)
        b = min(b, k)
        keys = squares(points, book) * k + np.arange(k)
        if b < k:
            keys = np.partition(keys, b, axis=1)
            outer = _down(np.sqrt((keys[:, b] // k).astype(float)))
        else:
            outer = np.full(len(points), np.inf, np.float32)
        keys = np.sort(keys[:, :b], axis=1)
        gaps = keys // k
        return cls((keys % k).astype(np.uint8), _down(np.sqrt(gaps.astype(float))), outer), gaps[:, 0]

    def wide(self, b: int) -> Lists:
        """The same lists with ``b`` places; places left over hold no entry, so the outer bound."""
        have = self.near.shape[1]
        if b <= have:
            outer = np.minimum(self.outer, self.low[:, b]) if b < have else self.outer
            return Lists(self.near[:, :b], self.low[:, :b], outer)
        fill = ((0, 0), (0, b - have))
        low = np.concatenate([self.low, np.repeat(self.outer[:, None], b - have, axis=1)], axis=1)
        return Lists(np.pad(self.near, fill), low, self.outer)

    def reassigned(self, points: np.ndarray, book: np.ndarray, moved: np.ndarray,
                   b: int) -> tuple[Lists, np.ndarray, np.ndarray]:
        """Lists after the entries moved, squared distances to the nearest, and depths read.

        A depth beyond the list's length means that all entries were measured.
        """
        k, n = len(book), len(points)
        near, have = self.near.copy(), self.near.shape[1]
        outer = _down(self.outer.astype(float) - moved.max(initial=0.0))
        low = _ordered(_down(self.low.astype(float) - moved[near]), outer)
        gap = points - book[near[:, 0]]
        best = (gap * gap).sum(axis=1)
        reach = np.sqrt(best.astype(float)) * (1 + _ROUNDING)
        depth = 1 + (low[:, 1:] <= reach[:, None]).sum(axis=1)
        depth[outer <= reach] = have + 1
        # Uncertain lists are verified in slabs of doubling depth.
        begin = 1
        while begin < have:
            end = min(2 * begin, have)
            rows = np.flatnonzero((depth > begin) & (depth <= end))
            begin = end
            if not len(rows):
                continue
            listed = near[rows, :end].astype(np.int64)
            gap = points[rows, None, :] - book[listed]
            keys = np.sort((gap * gap).sum(axis=2) * k + listed, axis=1)
            near[rows, :end] = keys % k
            best[rows] = keys[:, 0] // k
            low[rows, :end] = _down(np.sqrt((keys // k).astype(float)))
            low[rows] = _ordered(low[rows], outer[rows])
        lists = Lists(near, low, outer).wide(b)
        rows = np.flatnonzero(depth > have)
        if len(rows):
            anew, best[rows] = Lists.measured(points[rows], book, b)
            lists.near, lists.low, lists.outer = lists.near.copy(), lists.low.copy(), lists.outer.copy()
            lists.near[rows], lists.low[rows], lists.outer[rows] = anew.near, anew.low, anew.outer
        return lists, best, depth if n else depth.astype(int)


def adapted(b: int, depths: dict[int, int], entries: int) -> int:
    """The list length for the next round, from how deep lists of ``b`` were read.

    If one in 16 was too short, lists double; else they shrink towards twice the depth that
    is enough for all but one in 64.
    """
    total = sum(depths.values())
    if not total:
        return b
    if depths.get(b + 1, 0) * 16 > total:
        return min(2 * b, max(1, entries // 2))
    beyond, enough = 0, b
    for depth in range(b + 1, 0, -1):
        beyond += depths.get(depth, 0)
        if beyond * 64 > total:
            break
        enough = depth - 1
    return min(b, max(2 * enough, entries // 64, 1))


def _table(column: pa.Array, kind: str, n: int) -> np.ndarray:
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, kind).reshape(n, -1) if whole else np.empty((n, 0), kind)


def _bytes(rows: np.ndarray) -> list[bytes]:
    rows = np.ascontiguousarray(rows)
    return [r.tobytes() for r in rows]


def _pass(books: list[np.ndarray], moved: list[np.ndarray] | None, sizes: list[int],
          last_sizes: list[int], final: bool, passed: list[str], arrow: pa.Schema):
    """The function of one round over batches of rows."""
    parts, width = len(books), books[0].shape[1]

    def chunk(batch: pa.RecordBatch) -> tuple[dict, list, list]:
        n = batch.num_rows
        if moved is None:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            points = whole_numbers(flat.reshape(n, parts * width))
        else:
            points = _table(batch.column("points"), "<i4", n).astype(np.int64)
            near, low = _table(batch.column("near"), "u1", n), _table(batch.column("low"), "<f4", n)
            outer = _table(batch.column("outer"), "<f4", n)
        lists, gaps, depths, at = [], [], [], 0
        for p, book in enumerate(books):
            own = points[:, p * width:(p + 1) * width]
            _exact_or_raise(own, book)
            if moved is None:
                made, best = Lists.measured(own, book, sizes[p])
                depth = np.empty(0, int)
            else:
                to = at + last_sizes[p]
                held = Lists(near[:, at:to], low[:, at:to], outer[:, p])
                made, best, depth = held.reassigned(own, book, moved[p], sizes[p])
                at = to
            lists.append(made)
            gaps.append(best)
            depths.append(depth)
        out = {name: batch.column(name) for name in passed}
        if final:
            codes = np.stack([x.near[:, 0] for x in lists], axis=1)
            out |= {"code": [c.tobytes().hex() for c in np.ascontiguousarray(codes)],
                    "error": np.sum(gaps, axis=0).tolist()}
        else:
            out |= {"kind": ["row"] * n, "points": _bytes(points.astype("<i4")),
                    "near": _bytes(np.concatenate([x.near for x in lists], axis=1)),
                    "low": _bytes(np.concatenate([x.low for x in lists], axis=1).astype("<f4")),
                    "outer": _bytes(np.stack([x.outer for x in lists], axis=1).astype("<f4"))}
        return out, [(points[:, p * width:(p + 1) * width], x.near[:, 0])
                     for p, x in enumerate(lists)], depths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books[0])
        sums = np.zeros((parts, k, width), np.int64)
        counts = np.zeros((parts, k), np.int64)
        read = [np.zeros(k + 2, np.int64) for _ in range(parts)]
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                out, own, depths = chunk(whole.slice(at, CHUNK))
                n = len(out["code" if final else "kind"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) if isinstance(out.get(f.name), list)
                     else out[f.name].cast(f.type) if f.name in out else pa.nulls(n, f.type)
                     for f in arrow], schema=arrow)
                if final:
                    continue
                for p, (points, nearest) in enumerate(own):
                    np.add.at(sums[p], nearest, points)
                    counts[p] += np.bincount(nearest, minlength=k)
                    read[p] += np.bincount(depths[p], minlength=k + 2)
        if final:
            return
        rows = [{"kind": "sum", "part": p, "entry": e, "count": int(counts[p, e]), "sums": sums[p, e].tolist()}
                for p in range(parts) for e in range(k) if counts[p, e]]
        rows += [{"kind": "depth", "part": p, "entry": int(d), "count": int(read[p][d])}
                 for p in range(parts) for d in np.flatnonzero(read[p])]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return run


def _after_round(state: DataFrame, books: list[np.ndarray], sizes: list[int],
                 ) -> tuple[list[np.ndarray], list[int]]:
    """The entries and list lengths for the next round; at most a row an entry is collected."""
    width = books[0].shape[1]
    exact = "decimal(38,0)"
    sums = state.where("kind = 'sum'").groupBy("part", "entry").agg(
        F.sum(F.col("count").cast(exact)).alias("n"),
        *[F.sum(F.get("sums", F.lit(d)).cast(exact)).alias(f"s{d}") for d in range(width)])
    made = [book.copy() for book in books]
    for row in sums.collect():
        made[row["part"]][row["entry"]] = [int(row[f"s{d}"]) // int(row["n"]) for d in range(width)]
    depths: list[dict[int, int]] = [{} for _ in books]
    for row in state.where("kind = 'depth'").groupBy("part", "entry").agg(F.sum("count").alias("n")).collect():
        depths[row["part"]][row["entry"]] = row["n"]
    return made, [adapted(b, d, len(books[0])) for b, d in zip(sizes, depths, strict=True)]


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def coded(vectors: DataFrame, key: str, vector: str, keep: tuple[str, ...] = (), parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS, first_list: int | None = None,
          ) -> tuple[DataFrame, list[np.ndarray]]:
    """``(key, *keep, code, error)`` of every usable vector, and the codebooks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    importable(spark)
    passed = [f"c{i}" for i in range(1 + len(keep))]
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(*[vectors[c].alias(a) for c, a in zip((key, *keep), passed, strict=True)],
                          vectors[vector].cast("array<double>").alias("vector"))
    rows = rows.where(v.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    named = [F.col(a).alias(c) for c, a in zip((key, *keep), passed, strict=True)]
    nothing = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")]
    by_id = [F.col("c0").asc_nulls_last(), v.asc()]
    even = rows.where(F.size(v) % parts == 0)
    least = even.orderBy(*by_id).select(F.size(v)).first()
    if least is None:
        return rows.select(*named, *nothing), []
    length = least[0]
    own = rows.where(F.size(v) == length)
    first = own.orderBy(*by_id).select("vector").limit(entries).collect()
    seeds = whole_numbers(np.array([r[0] for r in first], float).reshape(len(first), length))
    width = length // parts
    books = [seeds[:, p * width:(p + 1) * width] for p in range(parts)]
    sizes = [min(len(seeds), first_list or max(1, entries // 16))] * parts
    kept = ", ".join(f"{a} {rows.schema[a].dataType.simpleString()}" for a in passed)
    state_schema = (f"{kept}, points binary, near binary, low binary, outer binary, part int, entry int, "
                    "count bigint, sums array<bigint>, kind string")
    final_schema = f"{kept}, code string, error bigint"

    def arrow(schema: str) -> pa.Schema:
        return to_arrow_schema(spark.createDataFrame([], schema).schema)

    state, path, moved, last_sizes = own, None, None, sizes
    for _ in range(rounds):
        step = _pass(books, moved, sizes, last_sizes, False, passed, arrow(state_schema))
        before, path = path, scratch_path(spark, "vector-lists")
        state = written_at(state.mapInArrow(step, state_schema), path, "kind")
        if before is not None:
            discard(spark, before)
        last_sizes = sizes
        made, sizes = _after_round(state, books, sizes)
        moved = [np.sqrt(((a - b) ** 2).sum(axis=1).astype(float)) * (1 + _ROUNDING)
                 for a, b in zip(made, books, strict=True)]
        books, state = made, state.where("kind = 'row'")
    step = _pass(books, moved, sizes, last_sizes, True, passed, arrow(final_schema))
    done = written(state.mapInArrow(step, final_schema), "vector-codes").select(*named, "code", "error")
    if path is not None:
        discard(spark, path)
    return done.unionByName(rows.where(F.size(v) != length).select(*named, *nothing)), books


def with_label_error(codes: DataFrame, label: str) -> DataFrame:
    """Add ``label_error``: the errors of all rows of a label, null labels together."""
    sums = codes.groupBy(F.col(label).alias("of_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col(label).eqNullSafe(F.col("of_label"))).drop("of_label")


def op11(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    codes, books = coded(vectors, "vec_id", "embedding", ("label",))
    return with_label_error(codes, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
