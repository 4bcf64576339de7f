"""Mixture-controlled packing of documents into token sequences by deficit round-robin.

Each source is a queue of documents. The queues are cut into as many equal shares as there
are deals of ``windows`` sequences, so a deal holds every source in the corpus's own
proportions and can be dealt out by itself: no task sees more than one deal, however large
a source is. Inside a deal each sequence gives every queue its quantum; a queue whose
credit is too small for a piece waits, and its deficit goes on to the next sequence. The
fraction of a token that a cut left over is the credit with which the next deal begins, so
deficits also pass from deal to deal. Only a deal's last sequence is padded.

Defined results: a null or empty text is its end token alone; a null source is a queue of
its own; rows that share a ``doc_id`` are packed each by itself; an empty table gives no
pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.support import importable, written
from logscope.llm.word_tokens import word_tokens

SEQUENCE = 2048
#: Sequences of a deal, and the least piece a queue gives unless a document ends.
WINDOWS = 512
LEAST_PIECE = 128
END_TOKEN = 1
#: Begins the name of every queue but that of null sources, so no source can be taken for it.
_NAMED = "="


def tokenised(docs: DataFrame, path: str, key: str, text: str, source: str) -> DataFrame:
    """``(key, source, part, before, n, ids)``: ``before`` counts the same source's tokens in the part."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, part, seen = word_tokens(path), TaskContext.get().partitionId(), {}
        end = np.array([END_TOKEN], tokens.dtype).tobytes()
        for batch in batches:
            ids = [tokens.packed(body or "") + end for body in batch["text"]]
            sizes, before = [len(x) // tokens.dtype.itemsize for x in ids], []
            for name, n in zip(batch["source"], sizes, strict=True):
                before.append(seen.get(name, 0))
                seen[name] = before[-1] + n
            yield pd.DataFrame({"key": batch["key"], "source": batch["source"], "part": part,
                                "before": before, "n": sizes, "ids": ids})
        tokens.clear()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"),
                       F.coalesce(F.concat(F.lit(_NAMED), docs[source].cast("string")), F.lit("")).alias("source"))
    return written(rows.mapInPandas(
        run, f"key {kind}, source string, part int, before bigint, n bigint, ids binary"), "tokens")


def queue_offsets(tokens: DataFrame) -> DataFrame:
    """``(part, source, offset, total)``: where a part's tokens begin in their queue."""
    sums = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    queue = Window.partitionBy("source")
    earlier = queue.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", "source",
                       F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
                       F.sum("n").over(queue).alias("total"))


def shares(tokens: DataFrame, offsets: DataFrame, deals: int, width: int) -> DataFrame:
    """The documents cut at the deals' bounds: share ``d`` of a queue of ``t`` begins at ceil(d*t/deals)."""
    kind = tokens.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, source, at, n, total, ids in zip(
                    batch["key"], batch["source"], batch["at"], batch["n"], batch["total"],
                    batch["ids"], strict=True):
                at, n, total = int(at), int(n), int(total)
                place = at
                while place < at + n:
                    deal = place * deals // total
                    stop = min(at + n, -(-(deal + 1) * total // deals))
                    out.append((deal, source, place, key, place - at, n, total,
                                ids[(place - at) * width:(stop - at) * width]))
                    place = stop
            if out:
                yield pd.DataFrame(out, columns=[
                    "deal", "source", "at", "key", "start", "doc_tokens", "total", "ids"])

    joined = tokens.join(offsets, ["part", "source"]).select(
        "key", "source", (F.col("before") + F.col("offset")).alias("at"), "n", "total", "ids")
    return joined.mapInPandas(run, f"deal bigint, source string, at bigint, key {kind}, "
                                   "start bigint, doc_tokens bigint, total bigint, ids binary")


def dealt(sizes: list[list[int]], credits: list[float], sequence: int,
          least: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Deficit round-robin over queues of documents with the given sizes.

    Yields ``(queue, document, start, length, window, offset)``.
    """
    left = [sum(q) for q in sizes]
    whole = sum(left)
    share = [n / whole if whole else 0.0 for n in left]
    credits, head, done = list(credits), [0] * len(sizes), [0] * len(sizes)
    window = 0
    while whole:
        space = filled = min(sequence, whole)
        offset = 0
        for q in range(len(sizes)):
            credits[q] += share[q] * filled
        turn, borrowing = 0, False
        while space:
            if turn == len(sizes):
                turn, borrowing = 0, True
            if borrowing:
                q = max((q for q in range(len(sizes)) if left[q]), key=lambda q: (credits[q], -q))
                want = max(least, int(credits[q]))
            else:
                q, turn = turn, turn + 1
                want = int(credits[q])
                if want < least and want < left[q]:
                    continue
            want = min(want, left[q], space)
            while want > 0:
                n = min(want, sizes[q][head[q]] - done[q])
                yield q, head[q], done[q], n, window, offset
                done[q] += n
                if done[q] == sizes[q][head[q]]:
                    head[q], done[q] = head[q] + 1, 0
                want, offset, space = want - n, offset + n, space - n
                left[q], credits[q], whole = left[q] - n, credits[q] - n, whole - n
        window += 1


def packed(docs: DataFrame, path: str, sequence: int = SEQUENCE, windows: int = WINDOWS,
           least: int = LEAST_PIECE, key: str = "doc_id", text: str = "text",
           source: str = "source", with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, place there, sequence and place there, and source."""
    importable(docs.sparkSession)
    tokens = tokenised(docs, path, key, text, source)
    kind = tokens.schema["key"].dataType.simpleString()
    offsets = written(queue_offsets(tokens), "queues")
    total = offsets.select("source", "total").distinct().agg(F.sum("total")).first()[0]
    deals = max(1, -(-int(total or 0) // (sequence * windows)))
    dtype = word_tokens(path).dtype

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source", "at"], kind="stable").reset_index(drop=True)
        number = int(group["deal"].iloc[0])
        queues = [g.index.to_list() for _, g in group.groupby("source", sort=True)]
        ids = [np.frombuffer(x, dtype).astype("<u4") for x in group["ids"]]
        sizes = [[len(ids[i]) for i in q] for q in queues]
        totals = [int(group["total"].iloc[q[0]]) for q in queues]
        credits = [-(-number * t % deals) / deals for t in totals]
        keys, starts, docs_n = group["key"].to_list(), group["start"].to_list(), group["doc_tokens"].to_list()
        names, out = group["source"].to_list(), []
        for q, d, start, n, window, offset in dealt(sizes, credits, sequence, least):
            row = queues[q][d]
            piece = ids[row][start:start + n].tobytes()
            out.append((keys[row], starts[row] + start, n, zlib.crc32(piece), docs_n[row],
                        (number << 32) + window, offset,
                        names[row][len(_NAMED):] if names[row] else None,
                        *([piece] if with_ids else [])))
        return pd.DataFrame(out, columns=columns)

    schema = (f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint, source string")
    schema += ", ids binary" if with_ids else ""
    columns = [x.split()[0] for x in schema.split(", ")]
    cut = shares(tokens, offsets, deals, dtype.itemsize)
    return cut.groupBy("deal").applyInPandas(deal, schema).withColumnRenamed("key", key)


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))
