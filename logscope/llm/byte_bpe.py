"""Byte-level BPE as a monoid tree reduction over each text.

A text is halved until its parts are short. Each leaf is encoded by itself; two neighbours
are joined by encoding anew a window around their boundary. The window grows until it
begins and ends at a *fixed cut*: a space between two letters, where the splitting pattern
ends a match whatever stands further away. So the tokens outside the window cannot change.
A window without such cuts grows to all of both parts, which is right as well, only slower.
Decoding concatenates the tokens' bytes up the same kind of tree.

Defined results: a null text is empty and has no tokens; repeated rows are encoded alike;
an empty table gives an empty table; the text column may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from logscope.llm.support import importable

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF = 4096
WINDOW = 32


class Codec:
    """Encodes and decodes by one rank table."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.flat = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.flat(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._encode(text, a, m), self._encode(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        begin, end = self._cut_before(text, a, m), self._cut_after(text, m, b)
        kept = len(left) - self._count(reversed(left), len(text[begin:m].encode()))
        gone = self._count(iter(right), len(text[m:end].encode()))
        return left[:kept] + self.flat(text[begin:end]) + right[gone:]

    def _count(self, ids: Iterator[int], size: int) -> int:
        """How many tokens make up so many bytes."""
        n = 0
        while size > 0:
            size -= len(self.tokens[next(ids)])
            n += 1
        if size:
            raise AssertionError("a fixed cut inside a token")
        return n

    def _cut_before(self, text: str, a: int, m: int) -> int:
        at = m - self.window
        while (at := text.rfind(" ", a, max(a, at))) > a:
            if _fixed(text, at) and at + 1 < m:
                return at
        return a

    def _cut_after(self, text: str, m: int, b: int) -> int:
        at = m + self.window
        while 0 <= (at := text.find(" ", at, b)) < b - 1:
            if _fixed(text, at):
                return at
            at += 1
        return b

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.tokens[i] for i in ids])
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


def _fixed(text: str, at: int) -> bool:
    """Whether the space at ``at`` stands between two letters, of old and settled blocks."""
    return all(c < "ɐ" and c.isalpha() for c in (text[at - 1], text[at + 1]))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN,
            key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``(key, ids, decoded)``: the tokens and what they decode to; or only their digests."""
    importable(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pattern)
        for batch in batches:
            out = []
            for body in batch["text"]:
                ids = own.encode(body or "")
                back = own.decode(ids)
                out.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                            hashlib.sha256(back).hexdigest()) if digests else (ids, back))
            yield pd.DataFrame({"key": batch["key"], **dict(zip(
                names, zip(*out) if out else [[] for _ in names], strict=True))})

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    types = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else (
        "ids array<int>, decoded binary")
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInPandas(run, f"key {kind}, {types}").withColumnRenamed("key", key)


def op4(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path(RANKS), digests=True)
