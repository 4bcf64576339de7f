"""Document fingerprints that add up: a homomorphic hash of a multiset of paragraphs.

A text is the multiset of its paragraphs (its lines). Each paragraph is hashed to a wide
vector and a fingerprint is the sum of its paragraphs' vectors, so the order of paragraphs
does not matter and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two bands. The first, 1024 lanes modulo 2**16 filled by an extendable hash of
the whole paragraph, decides equality: two multisets differ if any lane does, and finding
another multiset with the same sum is a hard problem at this width. The second, 512 lanes
modulo 2**32, gives likeness: each run of eight bytes inside the paragraph adds or
subtracts one in one lane. The squared length of the difference of two such sums estimates
how many runs differ; likeness is one less that, as a share of both lengths, within 0 to 1.

Defined results: a null text is an empty one, which is one empty paragraph; equal texts, and
texts that differ in the order of lines alone, have equal fingerprints; a lane of the second
band that passes 2**31 wraps, which only likeness can notice; rows that share an id follow
each other by a hash of their text; null ids come last; an only row is its own next; an
empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.support import importable, written

EQUAL_LANES, LIKE_LANES, RUN = 1024, 512, 8
_EQUAL_BYTES = 2 * EQUAL_LANES
# Odd multipliers that spread the bits of a run.
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_HELD = 256


class Fingerprint:
    """A sum of paragraph vectors."""

    __slots__ = ("equal", "like")

    def __init__(self, equal: np.ndarray | None = None, like: np.ndarray | None = None) -> None:
        self.equal = np.zeros(EQUAL_LANES, np.uint16) if equal is None else equal
        self.like = np.zeros(LIKE_LANES, np.uint32) if like is None else like

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls.of_bytes((text or "").encode("utf-8", "surrogatepass"))

    @classmethod
    def of_bytes(cls, body: bytes) -> Fingerprint:
        """The sum over all lines, a bounded number of them at a time."""
        total, begin = cls(), 0
        while begin <= len(body):
            # Whole lines of about a megabyte; one longer line is taken alone.
            end = body.find(b"\n", min(len(body), begin + (1 << 20)))
            end = len(body) if end < 0 else end
            total = total + cls._of_lines(body[begin:end])
            begin = end + 1
        return total

    @classmethod
    def _of_lines(cls, body: bytes) -> Fingerprint:
        lines = body.split(b"\n")
        equal = np.zeros(EQUAL_LANES, np.uint16)
        for at in range(0, len(lines), _HELD):
            hashed = b"".join([hashlib.shake_128(x).digest(_EQUAL_BYTES) for x in lines[at:at + _HELD]])
            equal += np.frombuffer(hashed, "<u2").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint16)
        # Zero bytes after each line keep runs inside it; runs begin at every byte of a line.
        padded = np.frombuffer(body.replace(b"\n", bytes(RUN)) + bytes(RUN), np.uint8)
        runs = np.lib.stride_tricks.sliding_window_view(padded, RUN)[padded[:1 - RUN] != 0]
        keys = np.ascontiguousarray(runs).view("<u8").ravel() * _SPREAD[0]
        keys = (keys ^ (keys >> np.uint64(29))) * _SPREAD[1]
        keys ^= keys >> np.uint64(32)
        signs = 1.0 - 2.0 * ((keys >> np.uint64(40)) & np.uint64(1)).astype(float)
        lanes = (keys % np.uint64(LIKE_LANES)).astype(np.int64)
        like = np.bincount(lanes, signs, LIKE_LANES).astype(np.int64).astype(np.uint32)
        return cls(equal, like)

    @classmethod
    def from_bytes(cls, vector: bytes) -> Fingerprint:
        return cls(np.frombuffer(vector[:_EQUAL_BYTES], "<u2"), np.frombuffer(vector[_EQUAL_BYTES:], "<u4"))

    def to_bytes(self) -> bytes:
        return self.equal.astype("<u2").tobytes() + self.like.astype("<u4").tobytes()

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.like + other.like)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.like - other.like)

    def digest(self) -> str:
        return hashlib.sha256(self.to_bytes()).hexdigest()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets; about the share of byte runs they have in common."""
        if (self.equal == other.equal).all():
            return 1.0
        length = lambda x: float((x.astype(np.int32).astype(float) ** 2).sum())
        whole = length(self.like) + length(other.like)
        return max(0.0, 1.0 - length(self.like - other.like) / whole) if whole else 0.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, vector)`` of every row, in one pass without a shuffle."""
    importable(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [Fingerprint.of(t).to_bytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vectors, pa.binary())], names=["key", "vector"])

    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, vector binary").withColumnRenamed("key", key)


def merged(vectors: DataFrame, key: str, vector: str = "vector", sign: str | None = None,
           salts: int = 256) -> DataFrame:
    """``(key, vector)``: the sums by key, ``sign`` (1 or -1) taken into account.

    Each task first sums its own rows, then tasks are summed by salt, then salts, so a key
    that holds most rows never meets in one task.
    """
    importable(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(vectors[key].alias("key"), vectors[vector].alias("vector"),
                          (F.lit(1) if sign is None else vectors[sign]).cast("int").alias("sign"))
    names = ["key", "salt", "vector"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, sums = TaskContext.get().partitionId() % salts, {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), key_type), pa.array([salt] * len(sums), pa.int32()),
                 pa.array([x.to_bytes() for x in sums.values()], pa.binary())], names=names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, body, way in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = Fingerprint.from_bytes(body)
                have = sums.get(k, Fingerprint())
                sums[k] = have - own if way < 0 else have + own
                if len(sums) == 4096:
                    yield told()
                    sums.clear()
        if sums:
            yield told()

    def summed(group: pa.Table) -> pa.Table:
        total = Fingerprint()
        for body in group.column("vector").to_pylist():
            total = total + Fingerprint.from_bytes(body)
        first = group.slice(0, 1)
        return first.set_column(first.schema.get_field_index("vector"), "vector",
                                pa.array([total.to_bytes()], pa.binary()))

    schema = f"key {kind}, salt int, vector binary"
    once = rows.mapInArrow(partial, schema).groupBy("key", "salt").applyInArrow(summed, schema)
    return once.groupBy("key").applyInArrow(summed, schema).select(F.col("key").alias(key), "vector")


def changed(stored: DataFrame, inserted: DataFrame, deleted: DataFrame, key: str = "doc_id",
            paragraph: str = "text") -> DataFrame:
    """Stored ``(key, vector)`` after paragraphs ``(key, text)`` came and went; no text is read again.

    A stored text counts its paragraphs; each inserted or deleted row is one paragraph.
    """
    signed = [fingerprints(rows, key, paragraph).withColumn("sign", F.lit(sign))
              for rows, sign in ((inserted, 1), (deleted, -1))]
    every = stored.select(key, "vector").withColumn("sign", F.lit(1))
    for rows in signed:
        every = every.unionByName(rows)
    return merged(every, key, "vector", "sign")


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first characters of the one that follows."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_FOUND = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _facts(text: str, own: Fingerprint, following: str, after: Fingerprint) -> tuple:
    other = edited(text, following)
    changed_to = Fingerprint.of(other)
    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return (len(text), digest, own.digest(), changed_to.digest(), own.likeness(changed_to),
            own.likeness(after))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and the next document, by falling id.

    Rows are range-partitioned and sorted by id and stream through each task, which holds
    two texts at a time. A task's last row meets the first one of the next task in a join of
    one row per task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    importable(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    # The last column only spreads equal rows over tasks.
    order = [F.col("key").desc_nulls_last(), F.xxhash64("text"), F.col("spread")]
    laid = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(
        *order).sortWithinPartitions(*order).select("key", "text")

    schema = f"key {kind}, {_FOUND}, part int, text string, kind string"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    names = [x.split()[0] for x in _FOUND.split(", ")]
    facts = ["key", *names]

    def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row.get("text") or "") + 512
            if size > 1 << 21:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def out() -> Iterator[dict]:
            before = None
            for batch in batches:
                for k, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    own = Fingerprint.of(body)
                    if before is None:
                        yield {"kind": "first", "part": part, "text": body}
                    else:
                        yield {"kind": "row", "key": before[0],
                               **dict(zip(names, _facts(before[1], before[2], body, own), strict=True))}
                    before = (k, body, own)
            if before is not None:
                yield {"kind": "last", "part": part, "key": before[0], "text": before[1]}

        return batched(out(), arrow)

    pieces = written(laid.mapInArrow(stream, schema), "fingerprints", "kind")
    firsts = pieces.where("kind = 'first'").select("part", F.col("text").alias("following"))
    lasts = pieces.where("kind = 'last'").select("key", "part", "text")
    # One number a task: no more than the driver has scheduled.
    parts = sorted(r[0] for r in firsts.select("part").collect())
    steps = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    met = lasts.join(steps, "part").join(firsts.withColumnRenamed("part", "next"), "next").select(
        "key", "text", "following")
    end_schema = f"key {kind}, {_FOUND}"
    end_arrow = to_arrow_schema(spark.createDataFrame([], end_schema).schema)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for batch in batches:
                for k, body, after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    found = _facts(body, Fingerprint.of(body), after, Fingerprint.of(after))
                    yield {"key": k, **dict(zip(names, found, strict=True))}

        return batched(out(), end_arrow)

    whole = pieces.where("kind = 'row'").select(*facts).unionByName(met.mapInArrow(ends, end_schema))
    return whole.withColumnRenamed("key", key)


def op12(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
